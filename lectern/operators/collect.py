"""Many queries as one run: shared scans, retries, stitched results, fused records and screening."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalize, similarity, tokens, year_of
from lectern.operators import keyword, vector
from lectern.operators.durable import materialize, ranked, shared_dir
from lectern.operators.fusion import last_wins, retained
from lectern.plans.query import Query

#: Likeness of the words of two queries from which they are one family.
ALIKE = 0.62
# Venues whose records a photonic term doesn't bring back.
NOT_RESCUED = ["science", "science advances"]
RESULTS = "query_pos int, query_id string, family string, role string, mode string, rank int, position long, similarity double, matched_fields array<string>"


@dataclass
class Run:
    """Stitched results of a run (RESULTS) and one summary a query: id, status, seconds, results, error."""

    results: DataFrame
    summary: list[dict] = field(default_factory=list)

    @property
    def completed(self) -> int:
        return sum(s["status"] == "completed" for s in self.summary)


def group_queries(queries: Sequence[Query]) -> list[list[int]]:
    """Places of queries that share one scan: those of one semantic mode and number of hits to fetch; each literal query alone."""
    groups: dict[tuple, list[int]] = {}
    for at, q in enumerate(queries):
        groups.setdefault((q.mode, q.limit, _filtered(q)) if q.mode == "lite" else (q.mode, at), []).append(at)
    return sorted(groups.values())


def _filtered(q: Query) -> bool:
    """Whether hits are left out after the search, so that more of them must be fetched."""
    return bool(q.keyword.years or q.keyword.venues)


def query_families(queries: DataFrame) -> DataFrame:
    """``(query_pos, family)`` of ``queries(query_pos, mode, family, titles, dois, authors, text)``, one specification's list.

    A query's own family counts, then identity (titles or DOIs) and authors. Others follow, in order,
    the first lead of their kind whose words are alike (ALIKE); one without such a lead leads a family itself. Queries that
    are alike meet by rare words; those whose earlier ones are all decided are decided in each round.
    """
    kind = F.when(F.col("mode") == "keyword", "keyword").otherwise("semantic")
    given = F.coalesce(
        F.when(F.col("family") != "", F.col("family")), F.when((F.size("titles") > 0) | (F.size("dois") > 0), "identity"),
        F.when(F.size("authors") > 0, F.concat(F.lit("author:"), normalize(F.array_join("authors", " ")))),
    )
    rows = materialize(queries.select("query_pos", given.alias("given"), kind.alias("kind"), tokens("text").alias("words")), "asked")
    free = rows.where("given is null").select("query_pos", "kind")
    alike = materialize(_alike_queries(rows.where("given is null and size(words) > 0")), "alike")
    leads, others = free.join(alike.select(F.col("later").alias("query_pos")), "query_pos", "left_anti"), free
    leads = materialize(leads, "leads")
    while True:
        # followers have a lead before them; of the others, those with none but followers before them lead
        led = alike.join(leads.select(F.col("query_pos").alias("earlier")), "earlier")
        others = materialize(others.join(leads, "query_pos", "left_anti").join(led.select(F.col("later").alias("query_pos")), "query_pos", "left_anti"), "undecided")
        if others.isEmpty():
            break
        waiting = alike.join(others.select(F.col("query_pos").alias("earlier")), "earlier").select(F.col("later").alias("query_pos"))
        leads = materialize(leads.unionByName(others.join(waiting, "query_pos", "left_anti")), "leads")
    named = ranked(leads, [F.col("query_pos")]).select(F.col("query_pos").alias("lead"), F.concat("kind", F.lit(":"), F.col("rank").cast("string")).alias("name"))
    first = led.groupBy("later").agg(F.min("earlier").alias("lead")).withColumnRenamed("later", "query_pos").unionByName(leads.select("query_pos", F.col("query_pos").alias("lead")))
    return rows.join(first.join(named, "lead"), "query_pos", "left").select("query_pos", F.coalesce("given", "name").alias("family"))


def _alike_queries(rows: DataFrame) -> DataFrame:
    """``(earlier, later)`` of ``rows(query_pos, kind, words)``: pairs of a kind whose words are alike.

    At least ALIKE of the smaller set is in the larger one, so one of its first words is, rare ones first.
    """
    each = rows.select("query_pos", "kind", F.size("words").alias("n"), F.explode("words").alias("word"))
    counted = each.join(each.groupBy("kind", "word").agg(F.count("*").alias("times")), ["kind", "word"])
    order = Window.partitionBy("query_pos").orderBy("times", "word")
    few = counted.withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * ALIKE - 1e-9) + 1)
    small = few.select("kind", "word", F.col("query_pos").alias("a")).join(rows.select(F.col("query_pos").alias("a"), F.col("words").alias("x")), "a")
    large = each.select("kind", "word", F.col("query_pos").alias("b")).join(rows.select(F.col("query_pos").alias("b"), F.col("words").alias("y")), "b")
    met = small.join(large, ["kind", "word"]).where((F.col("a") != F.col("b")) & (F.size("x") <= F.size("y")))
    met = met.where(similarity(F.col("x"), F.col("y")) >= ALIKE)
    return met.select(F.least("a", "b").alias("earlier"), F.greatest("a", "b").alias("later")).distinct()


def infer_families(spark: SparkSession, queries: Sequence[Query]) -> list[Query]:
    """``queries`` with the families that ``query_families`` gives them."""
    words = lambda q: " ".join([q.text, q.keyword.expression, *q.keyword.all_terms, *q.keyword.any_terms])
    rows = [(at, q.mode, q.family, list(q.keyword.titles), list(q.keyword.dois), list(q.keyword.authors), words(q)) for at, q in enumerate(queries)]
    schema = "query_pos int, mode string, family string, titles array<string>, dois array<string>, authors array<string>, text string"
    named = {r["query_pos"]: r["family"] for r in query_families(spark.createDataFrame(rows, schema)).collect()}
    return [replace(q, family=named[at]) for at, q in enumerate(queries)]


def run_queries(
    papers: DataFrame, vectors: DataFrame, queries: Sequence[Query], encode: Callable[[list[str]], list[list[float]]], rerank: Callable[[DataFrame, Query], DataFrame] | None = None, retries: int = 1
) -> Run:
    """All queries over ``papers(position, ...)`` and ``vectors(position, embedding)``, results in declared order.

    Literal fields are normalised once for all literal queries, and queries of one group are one
    scan of the vectors. A group that fails is run again query by query; a query that
    still fails after ``retries`` more attempts has no results and the status failed.
    """
    spark, queries = papers.sparkSession, infer_families(papers.sparkSession, queries)
    read = {n for q in queries if q.mode in ("keyword", "filtered_lite") for n in keyword.fields_of(q.keyword)}
    table = materialize(keyword.search_table(papers, tuple(sorted(read))), "search") if read else papers
    parts: list[DataFrame] = []
    notes: dict[int, dict] = {}

    def asked(places: list[int]) -> DataFrame:
        rows = [(at, [float(x) for x in v]) for at, v in zip(places, encode([queries[at].text for at in places]))]
        return spark.createDataFrame(rows, "query_id int, query_vector array<double>")

    def semantic(places: list[int]) -> DataFrame:
        first = queries[places[0]]  # all of a group fetch as many hits
        k = vector.over_fetch(first.limit, _filtered(first))
        hits = materialize(vector.top_k_many(vectors, asked(places), k, position="position"), "hits")
        named = hits.select(F.col("query_id").alias("query_pos"), "position", "similarity").join(papers, "position")
        if _filtered(first):
            limits = [(at, *(queries[at].keyword.years or (None, None)), list(queries[at].keyword.venues)) for at in places]
            named = named.join(F.broadcast(spark.createDataFrame(limits, "query_pos int, _from int, _to int, _venues array<string>")), "query_pos")
            in_years = F.col("_from").isNull() | year_of(F.col("year").cast("string")).between(F.col("_from"), F.col("_to"))
            named = named.where(in_years & ((F.size("_venues") == 0) | F.array_contains("_venues", F.col("venue"))))
        return named.select("query_pos", "position", "similarity", F.lit(None).cast("array<string>").alias("matched_fields"))

    def one(places: list[int]) -> DataFrame:
        q = queries[places[0]]
        if q.mode == "keyword":
            found = keyword.search(table, q.keyword, q.limit)
            order = [F.desc("exact_score"), F.desc("year"), F.desc(F.lower("title")), F.col("position")]
            numbered = found.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(places[0])).orderBy(*order)))
            return numbered.select(F.lit(places[0]).alias("query_pos"), "position", F.lit(None).cast("double").alias("similarity"), "matched_fields", "rank")
        if q.mode == "filtered_lite":
            found = keyword.match(keyword.within(table, q.keyword.years, q.keyword.venues), q.keyword).select("position", "matched_fields")
            hits = vector.top_k(found.join(vectors, "position"), list(encode([q.text])[0]), q.limit, position="position")
            hits = hits.select(F.lit(places[0]).alias("query_pos"), "position", "similarity", "matched_fields")
        else:
            hits = semantic(places)
            if q.mode == "pro" and rerank is not None:
                return rerank(hits.join(papers, "position"), q).select("query_pos", "position", "similarity", "matched_fields", "rank")
        ranks = Window.partitionBy("query_pos").orderBy(F.desc("similarity"), "position")
        return hits.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= q.limit)

    def attempt(places: list[int], times: int) -> str:
        error = ""
        for _ in range(times):
            began = time.monotonic()
            try:
                parts.append(materialize(one(places), "query"))
            except Exception as e:  # noqa: BLE001 - a failed query must not end the others
                error = str(e).strip().split("\n")[0][:300]
                continue
            for at in places:
                notes[at] = {"query_id": queries[at].query_id, "status": "completed", "seconds": round(time.monotonic() - began, 3), "error": ""}
            return ""
        for at in places:
            notes[at] = {"query_id": queries[at].query_id, "status": "failed", "seconds": 0.0, "error": error}
        return error

    for places in group_queries(queries):
        if attempt(places, 1):
            for at in places:
                attempt([at], retries)
    meta = [(at, q.query_id, q.family, q.role, q.mode) for at, q in enumerate(queries)]
    names = F.broadcast(spark.createDataFrame(meta, "query_pos int, query_id string, family string, role string, mode string"))
    if not parts:
        return Run(spark.createDataFrame([], RESULTS), [notes[at] | {"results": 0} for at in range(len(queries))])
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    results = union.join(names, "query_pos").select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in RESULTS.split(", ")))
    counts = {r["query_pos"]: r["count"] for r in results.groupBy("query_pos").count().collect()}
    return Run(results, [notes[at] | {"results": counts.get(at, 0)} for at in range(len(queries))])


def write_by_query(results: DataFrame, folder: str | None = None) -> str:
    """Results in one folder a query (``query_id=...``), each commit whole."""
    path = folder or f"{shared_dir(results.sparkSession)}/collected"
    results.write.mode("overwrite").partitionBy("query_id").json(path)
    return path


def legacy_entries(keywords: Sequence[str] = (), texts: Sequence[str] = (), **selectors) -> list[dict]:
    """Entries of a specification from plain arguments; selectors alone are one literal query."""
    entries = [{"query_id": f"keyword-{i}", "mode": "keyword", "expression": k, **selectors} for i, k in enumerate(keywords, 1)]
    entries += [{"query_id": f"lite-{i}", "mode": "lite", "text": t} for i, t in enumerate(texts, 1)]
    if not entries and selectors:
        entries = [{"query_id": "keyword-1", "mode": "keyword", **selectors}]
    return entries


def pro_order(hits: DataFrame, scores: DataFrame, window: int, limit: int, key: str = "position") -> DataFrame:
    """Reranked hits by score and similarity, then the others by similarity; score falls back to 100 similarity.

    hits: a limited list with ``rank`` by similarity; scores: (key, llm_score, llm_reason).
    """
    joined = hits.join(F.broadcast(scores.select(key, "llm_score", "llm_reason")), key, "left")
    inside = F.col("rank") <= window
    joined = joined.withColumn("llm_score", F.when(inside, F.coalesce(F.col("llm_score").cast("double"), F.round(100 * F.col("similarity")))))
    joined = joined.withColumn("llm_reason", F.when(inside, F.coalesce("llm_reason", F.lit("similarity"))))
    return joined.orderBy(F.desc(inside), F.desc("llm_score"), F.desc("similarity"), key).limit(limit)


def pro_search(
    papers: DataFrame, vectors: DataFrame, text: str, encode: Callable, models: Sequence[str], score: Callable[[str, DataFrame], DataFrame],
    limit: int = 50, window: int = 30, condition: Column | None = None, expand: Callable[[str], str] | None = None,
) -> tuple[DataFrame, list[dict]]:
    """Similar records, the first ``window`` reranked by the first model that answers; and the log of attempts.

    Fallback models get 25 candidates at most. ``score(model, hits)`` gives (position, llm_score, llm_reason).
    """
    names = list(dict.fromkeys(m.strip() for m in models if m and m.strip()))
    if not names:
        raise ValueError("a pro search needs a model")
    query = list(encode([expand(text) if expand else text])[0])
    k = max(120, min(400, limit)) if condition is None else max(1000, min(5000, 20 * limit))
    hits = vector.top_k(vectors, query, k, position="position").select("position", "similarity").join(papers, "position")
    hits = (hits if condition is None else hits.where(condition)).orderBy(F.desc("similarity"), "position").limit(max(limit, window))
    hits = materialize(hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity"), "position"))), "pro")
    log: list[dict] = []
    for at, model in enumerate(names):
        some = window if not at else min(window, 25)
        try:
            scores = materialize(score(model, hits.where(F.col("rank") <= some)), "pro-scores")
        except Exception as e:  # noqa: BLE001 - the next model may answer
            log.append({"model": model, "status": "failed", "rerank_limit": some, "error": str(e)[:300]})
            continue
        log.append({"model": model, "status": "completed", "rerank_limit": some})
        return pro_order(hits, scores, some, limit), log
    raise RuntimeError(f"no model answered: {json.dumps(log)}")


def fuse_metadata(records: DataFrame, key: str = "key", position: str = "position", fill: Sequence[str] = ("doi", "venue", "year"), longest: str = "abstract") -> DataFrame:
    """One row a publication: fields from the first retrieval that has them, the longest abstract, the
    greatest similarity, matched fields in the order in which they were first seen."""
    text = lambda c: F.nullif(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(""))
    first = [F.min_by(c, F.when(text(c).isNotNull(), F.col(position))).alias(c) for c in fill]
    best = F.max_by(longest, F.struct(F.length(F.coalesce(longest, F.lit(""))), -F.col(position))).alias(longest)
    once = records.select(key, position, F.posexplode(F.coalesce("matched_fields", F.array().cast("array<string>"))).alias("place", "name"))
    once = once.groupBy(key, "name").agg(F.min(F.struct(position, "place")).alias("seen"))
    names = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seen", "name"))).alias("f")).select(key, F.transform("f", lambda x: x["name"]).alias("matched_fields"))
    merged = records.groupBy(key).agg(*first, best, F.max("similarity").alias("similarity"), F.min(position).alias(position))
    return merged.join(names, key, "left").withColumn("matched_fields", F.coalesce("matched_fields", F.array().cast("array<string>")))


def with_screening(records: DataFrame, decisions: DataFrame, key: str = "key", position: str = "position") -> DataFrame:
    """Records with the last decision on their key (``decisions(key, position, decision, reason)``)."""
    last = last_wins(decisions.select(key, position, "decision", "reason"), [key], position).drop(position)
    return records.join(last, key, "left")


def screening_summary(screened: DataFrame) -> DataFrame:
    """``(decision, n, retained)``: records by decision; missing ones count as unscreened."""
    each = F.coalesce(F.nullif(F.trim("decision"), F.lit("")), F.lit("unscreened"))
    return screened.groupBy(each.alias("decision")).agg(F.count("*").alias("n"), F.count_if(retained(F.col("decision"))).alias("retained"))


def retained_yield(retrievals: DataFrame, screened: DataFrame) -> DataFrame:
    """For each query: retained publications and retained families that no earlier query had found.

    retrievals: (query_pos, key); screened: (key, decision, family_id).
    """
    kept = retrievals.select("query_pos", "key").distinct().join(screened.where(retained(F.col("decision"))).select("key", "family_id"), "key")
    new = lambda c: F.min("query_pos").over(Window.partitionBy(c))
    marked = kept.withColumns({"_k": new("key"), "_f": new("family_id")})
    per = marked.groupBy("query_pos").agg(
        F.countDistinct(F.when(F.col("_k") == F.col("query_pos"), F.col("key"))).alias("new_retained"),
        F.countDistinct(F.when(F.col("_f") == F.col("query_pos"), F.col("family_id"))).alias("new_retained_families"),
    )
    return retrievals.select("query_pos").distinct().join(per, "query_pos", "left").na.fill(0, ["new_retained", "new_retained_families"])


def uncovered(declared: DataFrame, covered: DataFrame) -> DataFrame:
    """Values of each dimension that the scope declares and no query covers: ``(dimension, value)``."""
    return declared.select("dimension", "value").distinct().join(covered.select("dimension", "value").distinct(), ["dimension", "value"], "left_anti")


def should_rescue(title: Column, relevant: Column, venue: Column, hardware: Sequence[str], photonic: Sequence[str]) -> Column:
    """Relevant records, those with a hardware term in the title and, outside of NOT_RESCUED, those with a photonic one."""
    t = F.lower(F.coalesce(title, F.lit("")))
    has = lambda terms: F.exists(F.lit(list(terms)), lambda x: F.contains(t, x)) if terms else F.lit(False)
    return relevant | has(hardware) | (has(photonic) & ~F.lower(F.trim(F.coalesce(venue, F.lit("")))).isin(NOT_RESCUED))


def without_axes(audited: DataFrame) -> DataFrame:
    """Retained records that lack evidence: ``(publication_key, title, missing_axes)`` from ``axes map<string, string>``."""
    missing = F.map_keys(F.map_filter("axes", lambda k, v: v != "evidenced"))
    some = audited.where(retained(F.col("decision"))).select("publication_key", "title", F.array_sort(missing).alias("missing_axes"))
    return some.where(F.size("missing_axes") > 0)


def empty_results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULTS)
