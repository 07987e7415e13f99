"""Registered queries of the inverted index, bucketed tables and corpus-wide families."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.functions import keys, text
from lectern.operators import family, index
from lectern.operators.durable import materialize, shared_dir
from lectern.operators.intervals import interval_join
from lectern.operators.vectorstore import VectorStore
from lectern.plans.catalogue import ORACLE_SQL, N, P, T, papers, query, table
from lectern.plans.query import KeywordQuery
from lectern.sources.crawl import crawl
from lectern.streaming import ingest as streaming


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(ORACLE_SQL["keyword_and_or"])
def indexed_and_or(spark, sf_dir):
    """The flagship search, from postings."""
    records, folder = papers(spark, sf_dir), _folder(spark, "index")
    index.build(records, folder, ("title", "abstract"), 10_000)
    q = KeywordQuery.build(expression="the/der, was/with", fields="title,abstract", years=(2003, 2020))
    return index.search(records, folder, q, 200).select("position", "year", "exact_score", "title")


@query(ORACLE_SQL["keyword_structured"])
def indexed_after_update(spark, sf_dir):
    """An index of an older state of the records (some missing, some with other texts, some to be removed), brought up to date."""
    records, folder = papers(spark, sf_dir), _folder(spark, "index")
    older = F.when(F.col("position") % 11 == 3, F.reverse("abstract")).otherwise(F.col("abstract"))
    old = records.where("position % 11 <> 5").withColumn("abstract", older).unionByName(records.where("position % 11 = 7").withColumn("position", -1 - F.col("position")))
    index.build(old, folder, ("title", "abstract"), 1000)
    index.update(folder, records.where("position % 11 IN (3, 5)"), old.where("position < 0"))
    q = KeywordQuery.build(all_terms=["the", "and"], any_terms=["of the"], fields="title,abstract", venues=["src0", "src1", "src2"])
    return index.search(records, folder, q).select("position", F.array_join(F.transform("matched_fields", lambda f: F.concat(f, F.lit(","))), "").alias("fields"))


@query(f"""SELECT x.position, count(y.position) AS found FROM (SELECT *, {N('title')} AS t FROM {P} WHERE position % 50 = 0) x LEFT JOIN (SELECT position, {N('title')} AS t FROM {P}) y ON x.t = y.t AND x.t <> '' GROUP BY x.position""")
def identity_postings(spark, sf_dir):
    """How many records share the title of each fiftieth one, from the postings of whole titles."""
    records = papers(spark, sf_dir)
    whole = index.postings(records, ("title",)).where("field = 'title='").select("term", F.col("position").alias("other"))
    wanted = records.where("position % 50 = 0").select("position", text.normalize("title").alias("term"))
    return wanted.join(whole, "term", "left").groupBy("position").agg(F.count("other").alias("found"))


@query("""WITH o AS (SELECT 'k' || (o_orderkey % 5000) AS key, o_orderkey, o_totalprice, o_orderdate FROM orders)
SELECT key, coalesce(arg_min(o_totalprice, o_orderkey) FILTER (o_orderdate >= DATE '1995-01-01'), arg_min(o_totalprice, o_orderkey)) AS price, (SELECT max(o_orderdate)::DATE::VARCHAR FROM orders WHERE o_orderdate < DATE '1998-01-01') AS covered_to FROM o WHERE o_orderdate < DATE '1998-01-01' GROUP BY key""")
def committed_windows(spark, sf_dir):
    """Three windows of orders upserted with their checkpoint, one of them twice and one incomplete."""
    target = _folder(spark, "orders")
    o = table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    keyed = o.select(F.concat(F.lit("k"), (F.col("o_orderkey") % 5000).cast("string")).alias("key"), F.col("o_orderkey").alias("position"), F.col("o_totalprice").alias("price"), "day")
    first = lambda where: streaming.first_wins(keyed.where(where), ["key"], "position").drop("day")
    to = keyed.where("day < '1998-01-01'").agg(F.max("day").cast("string")).first()[0]
    early, late = first("day < '1995-01-01'"), first("day >= '1995-01-01' AND day < '1998-01-01'")
    streaming.commit_window(spark, target, early, "orders", "1994-12-31")
    streaming.commit_window(spark, target, late, "orders", to)
    streaming.commit_window(spark, target, late, "orders", "1996-01-01")
    streaming.commit_window(spark, target, late, "orders", "1998-06-30", complete=False)
    return streaming.current(spark, target).select("key", "price", F.lit(streaming.checkpoints(spark, target)["orders"]).alias("covered_to"))


# --- families -----------------------------------------------------------------------------

#: Records with a DOI of their own, and two authors of whom one is frequent.
_RECORDS = f"(SELECT position, 'doi:10.5/' || position AS key, {N('title')} AS t, {T('title')} AS w, year AS y, [{N("venue || ' Smith'")}, {N("'A. ' || keywords")}] AS f FROM {P})"
_LINK = "((a.t <> '' AND a.t = b.t) OR (len(list_intersect(a.f, b.f)) > 0 AND abs(a.y - b.y) <= 5 AND len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) >= 0.85 * least(len(a.w), len(b.w)) AND len(list_intersect(a.w, b.w)) >= 0.62 * len(list_distinct(a.w || b.w))))"


def family_records(spark, sf_dir):
    p = papers(spark, sf_dir).withColumn("year", F.col("year").cast("string")).withColumn("doi", F.concat(F.lit("10.5/"), F.col("position").cast("string")))
    return p.withColumn("authors", F.array(F.concat("venue", F.lit(" Smith")), F.concat(F.lit("A. "), "keywords")))


@query(f"""WITH RECURSIVE r AS (SELECT * FROM {_RECORDS}), e AS (SELECT a.key AS a, b.key AS b FROM r a JOIN r b ON a.key <> b.key AND {_LINK}),
g(key, round) AS (SELECT key, 0 FROM r WHERE position % 20 = 0 UNION SELECT e.b, g.round + 1 FROM g JOIN e ON e.a = g.key WHERE g.round < 12) SELECT key, min(round)::INT AS round FROM g GROUP BY key""")
def family_closure(spark, sf_dir):
    """Families of each twentieth record among all others, with the round that each member came in."""
    p = family_records(spark, sf_dir)
    return family.closure(p.where("position % 20 = 0"), p.where("position % 20 <> 0")).select("key", "round")


@query(f"""WITH r AS (SELECT * FROM {_RECORDS}), s AS (SELECT unnest(f) AS author, count(*) AS n FROM r GROUP BY 1), l AS (SELECT list(author) AS few FROM s WHERE n <= 55), x AS (SELECT r.*, list_intersect(f, coalesce(few, [])) AS small FROM r, l)
SELECT DISTINCT b.key FROM x a JOIN x b ON a.position % 50 = 0 AND ((a.t <> '' AND a.t = b.t) OR len(list_intersect(a.small, b.small)) > 0 OR len(list_intersect(a.f, b.f)) >= 2)""")
def literal_family_candidates(spark, sf_dir):
    """Candidates of each fiftieth record: its title, an author of at most 55 records, or two of its authors."""
    rows = materialize(family.prepare(family_records(spark, sf_dir)), "prepared")
    frontier = rows.where(F.substr("key", F.lit(10), F.lit(20)).cast("long") % 50 == 0)
    blocks = family.literal_blocks(rows, family.author_sizes(rows), 55)
    return family.literal_candidates(frontier, blocks, blocks)


@query(f"""WITH r AS (SELECT * FROM {_RECORDS}) SELECT author, count(*) AS candidate_count FROM (SELECT unnest(f) AS author, position FROM r) GROUP BY author HAVING count(*) > 55 AND count(*) FILTER (position % 50 = 0) > 0""")
def skipped_family_authors(spark, sf_dir):
    rows = materialize(family.prepare(family_records(spark, sf_dir)), "prepared")
    frontier = rows.where(F.substr("key", F.lit(10), F.lit(20)).cast("long") % 50 == 0)
    return family.skipped_authors(frontier, rows, family.author_sizes(rows), 55)


@query()
def corpus_families(spark, sf_dir):
    """Families of each twentieth record within the whole corpus, by literal blocks and by the nearest vectors."""
    p = family_records(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("doi:10.5/"), F.col("vec_id").cast("string")).alias("key"), "embedding")
    found = family.corpus_closure(p.where("position % 20 = 0"), p, family.vector_neighbours(vectors, 20), 55, strict=True)
    return found.members


# --- intervals and vectors ----------------------------------------------------------------


@query("""WITH t AS (SELECT s_suppkey, (s_suppkey % 40)::DOUBLE AS low, (s_suppkey % 40 + s_nationkey / 5.0)::DOUBLE AS high FROM supplier), m AS (SELECT l_quantity::DOUBLE AS low, l_quantity + l_linenumber AS high FROM lineitem)
SELECT s_suppkey, count(*) AS n, sum(CASE WHEN m.high = t.low OR m.low = t.high THEN 1 ELSE 0 END)::BIGINT AS ends FROM t JOIN m ON m.low <= t.high AND t.low <= m.high GROUP BY s_suppkey""")
def mention_targets(spark, sf_dir):
    """Bands of all mentions (line items) that meet each target band (suppliers), joined by bins."""
    targets = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 40).cast("double").alias("low"), (F.col("s_suppkey") % 40 + F.col("s_nationkey") / 5.0).cast("double").alias("high"))
    mentions = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("low"), (F.col("l_quantity") + F.col("l_linenumber")).cast("double").alias("high"))
    # equal mentions meet the same targets: they are counted before the join
    met = interval_join(targets, mentions.groupBy("low", "high").agg(F.count("*").alias("times")), 2.0)
    ends = (F.col("b.high") == F.col("a.low")) | (F.col("b.low") == F.col("a.high"))
    return met.groupBy("a.s_suppkey").agg(F.sum("b.times").alias("n"), F.sum(F.when(ends, F.col("b.times")).otherwise(0)).alias("ends"))


@query("""WITH v AS (SELECT DISTINCT ON (vec_id % 1500) 'f' || (vec_id % 1500) AS fingerprint, 2000 + vec_id % 7 AS year FROM embeddings ORDER BY vec_id % 1500, 2000 + vec_id % 7)
SELECT year::INT AS year, count(*) AS n FROM v WHERE year IN (2001, 2004) GROUP BY year""")
def scoped_vectors(spark, sf_dir):
    """Vectors of two years in a store that was filled in two appends and compacted."""
    store = VectorStore(spark, _folder(spark, "vectors"), 16)
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("f"), (F.col("vec_id") % 1500).cast("string")).alias("fingerprint"), (2000 + F.col("vec_id") % 7).cast("int").alias("year"), "embedding")
    least = e.groupBy("fingerprint").agg(F.min(F.struct("year", "vec_id", "embedding")).alias("v")).select("fingerprint", "v.*")
    store.append(least.where("vec_id % 3 = 0"), "model")
    store.append(least, "model")
    store.compact(1)
    return store.read("model", [2001, 2004]).groupBy("year").agg(F.count("*").alias("n"))


# --- crawls and whole records -------------------------------------------------------------


@query("""WITH RECURSIVE n AS (SELECT page_id, page_id % 7 = 3 AS broken FROM pages), g(page_id, round) AS (SELECT page_id, 0 FROM n WHERE page_id BETWEEN 1 AND 3
  UNION SELECT m.page_id, g.round + 1 FROM g JOIN n ON n.page_id = g.page_id AND NOT n.broken JOIN n m ON m.page_id IN (2 * g.page_id, 2 * g.page_id + 1, g.page_id - 1) WHERE g.round < 40)
SELECT 'p' || g.page_id AS url, min(round)::INT AS round, any_value(CASE WHEN broken THEN 'broken' END) AS error FROM g JOIN n USING (page_id) GROUP BY g.page_id""")
def crawled_pages(spark, sf_dir):
    """A crawl over the pages, each with links to the pages of twice its number, the one behind, and the one before its own; some are broken."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("url"))
    known = pages.select("url")
    others = F.array(2 * F.col("page_id"), 2 * F.col("page_id") + 1, F.col("page_id") - 1)
    links = pages.select("url", F.explode(F.transform(others, lambda x: F.concat(F.lit("p"), x.cast("string")))).alias("to")).join(known.withColumnRenamed("url", "to"), "to").groupBy("url").agg(F.collect_list("to").alias("links"))
    site = pages.join(links, "url", "left").select("url", F.coalesce("links", F.array().cast("array<string>")).alias("links"), F.when(F.col("page_id") % 7 == 3, "broken").alias("error"))
    return crawl(pages.where("page_id BETWEEN 1 AND 3").select("url"), lambda frontier: site.join(frontier, "url")).pages.select("url", "round", "error")


@query(f"""SELECT count(*) AS n, count(DISTINCT title || '|' || trim(regexp_replace(abstract, '\\s+', ' ', 'g'))) AS signatures FROM (SELECT regexp_replace(title, '\\s+', ' ', 'g') AS title, abstract FROM {P})""")
def record_signatures(spark, sf_dir):
    p = papers(spark, sf_dir).select("title", "abstract")
    return p.select(keys.record_signature(dict(p.dtypes)).alias("s")).agg(F.count("*").alias("n"), F.countDistinct("s").alias("signatures"))
