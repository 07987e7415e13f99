"""Crawls by rounds: links of the newest pages that no one has seen yet are the next frontier."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.durable import materialize


@dataclass
class Crawl:
    """Pages ``(url, round, parent, error)``, one row each; a row of what became of the crawl; a dict a round."""

    pages: DataFrame
    status: DataFrame
    rounds: list[dict] = field(default_factory=list)


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], max_rounds: int = 200, max_pages: int = 0) -> Crawl:
    """Everything that ``seeds(url)`` lead to.

    ``fetch`` takes a table of urls and gives ``(url, links array<string>, error)``; a url that it doesn't give
    has failed, as has one with an error, and no link of it is followed. A page's parent is the least url of
    the round before that links to it. A round is a durable table. ``max_rounds`` or ``max_pages``
    (0: none) reached with links left mark the crawl as truncated; it is completed if nothing failed or is left.
    """
    spark = seeds.sparkSession
    frontier = materialize(seeds.where("url IS NOT NULL").select("url", F.lit(None).cast("string").alias("parent")).distinct(), "crawl")
    seen, parts, rounds, asked, truncated = frontier.select("url"), [], [], 0, False
    waiting = frontier.count()
    for at in range(max_rounds + 1):
        if not waiting:
            break
        if at == max_rounds or (max_pages and asked + waiting > max_pages):
            truncated = True
            break
        got = fetch(frontier.select("url")).groupBy("url").agg(F.max(F.struct("links", "error")).alias("g"))
        error = F.when(F.col("g").isNull(), "no answer").otherwise(F.col("g.error"))
        done = materialize(frontier.join(got, "url", "left").select("url", F.lit(at).alias("round"), "parent", error.alias("error"), F.when(error.isNull(), F.col("g.links")).alias("links")), "crawl")
        parts.append(done)
        asked += waiting
        links = done.select(F.col("url").alias("parent"), F.explode("links").alias("url")).where("url IS NOT NULL").groupBy("url").agg(F.min("parent").alias("parent"))
        frontier = materialize(links.join(seen, "url", "left_anti"), "crawl")
        rounds.append({"round": at, "pages": waiting, "failed": done.where("error IS NOT NULL").count()})
        waiting = frontier.count()
        rounds[-1]["new"] = waiting
        seen = seen.unionByName(frontier.select("url"))
    pages = spark.createDataFrame([], "url string, round int, parent string, error string")
    for part in parts:
        pages = pages.unionByName(part.drop("links"))
    failed = sum(r["failed"] for r in rounds)
    status = spark.createDataFrame([(asked, failed, waiting if truncated else 0, truncated, not failed and not truncated)], "pages long, failed long, left_over long, truncated boolean, completed boolean")
    return Crawl(pages, status, rounds)
