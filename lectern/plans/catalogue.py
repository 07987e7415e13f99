"""Registered queries of the retrieval and curation engine, with DuckDB SQL for each.

The driver's tables stand in for a library: documents are records (title: the first
sentence or line, venue: source, keyword: lang, year: 2000 + doc_id % 25),
embeddings the vector store, events arrivals and user actions, labels screening decisions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import dates, keys, scoring, text
from lectern.operators import conflicts, family, filters, fusion, ingest, keyword, snapshot, stats, vector
from lectern.operators.durable import spread
from lectern.plans.query import KeywordQuery
from lectern.sources import readers, sinks
from lectern.streaming import ingest as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of the library."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("position"), F.regexp_extract("text", "^[^\n.!?]*", 0).alias("title"), F.col("text").alias("abstract"), F.col("source").alias("venue"),
        F.col("lang").alias("keywords"), (2000 + F.col("doc_id") % 25).cast("int").alias("year"), F.lit("").alias("doi"),
    )


# The same records, and the search form of a text, in SQL.
P = "(SELECT doc_id AS position, regexp_extract(text, '^[^\\n.!?]*') AS title, text AS abstract, source AS venue, lang AS keywords, (2000 + doc_id % 25)::INT AS year FROM documents)"


def N(c: str) -> str:  # noqa: N802
    spaced = f"regexp_replace(regexp_replace(strip_accents({c}), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace(lower({spaced}), '[^a-z0-9+]+', ' ', 'g'))"


def T(c: str) -> str:  # noqa: N802
    """Token set in SQL."""
    stop = ", ".join(f"'{w}'" for w in text.STOPWORDS)
    return f"list_filter(list_distinct(string_split({N(c)}, ' ')), lambda t: length(t) > 1 AND t NOT IN ({stop}))"


# --- scalar functions ------------------------------------------------------------------


@query(f"SELECT doc_id, {N('text')} AS normal FROM documents")
def normalize_text(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", text.normalize("text").alias("normal"))


@query("SELECT page_id, trim(regexp_replace(lower(trim(url)), '^https?://(www\\.|m\\.|blog\\.)?', '')) AS selector, length(trim(url)) AS n FROM pages")
def url_selector(spark, sf_dir):
    c = F.regexp_replace(text.doi_selector("url"), r"^https?://(www\.|m\.|blog\.)?", "")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(c).alias("selector"), F.length(F.trim("url")).cast("long").alias("n"))


@query("SELECT page_id, coalesce(try_cast(nullif(regexp_extract(html, '[0-9]{4}'), '') AS INT), 0) AS year FROM pages")
def extract_year(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.year_of("html").alias("year"))


@query(f"SELECT position, to_json(list_sort({T('title')})) AS tokens, len({T('title')})::INT AS n FROM {P}")
def title_tokens(spark, sf_dir):
    w = text.tokens("title")
    return papers(spark, sf_dir).select("position", F.to_json(F.array_sort(w)).alias("tokens"), F.size(w).alias("n"))


@query(f"""SELECT position, CASE WHEN {N('title')} <> '' THEN 'title_year:' || {N('title')} || '|' || year ELSE 'metadata' END AS key,
  CASE WHEN title <> '' THEN sha1(trim(title || ' ' || abstract)) ELSE sha1(trim(abstract)) END AS fingerprint FROM {P}""")
def identity_keys(spark, sf_dir):
    p = papers(spark, sf_dir).withColumn("authors", F.array().cast("array<string>"))
    k = keys.publication_key(year="year")
    return p.withColumn("year", F.col("year").cast("string")).select("position", F.when(k.startswith("metadata:"), "metadata").otherwise(k).alias("key"), keys.fingerprint().alias("fingerprint"))


@query("""SELECT o_orderkey, (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::INT AS score, (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + 1)::INT AS month_score FROM orders""")
def source_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", dates.date_score(F.date_format("o_orderdate", "d MMM yyyy")).alias("score"), dates.date_score(F.date_format("o_orderdate", "MMMM, yyyy")).alias("month_score"))


@query("""SELECT p_partkey, p_size + CASE WHEN 2000 + p_size > 1900 AND 2026 - (1990 + p_size) < 10 THEN 10 - (2026 - (1990 + p_size)) ELSE 0 END
  + CASE WHEN p_partkey % 1000 > 0 THEN least(15.0::DOUBLE, log10(p_partkey % 1000 + 1) * 6) ELSE 0.0 END AS score FROM part""")
def paper_score(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", scoring.paper_score(F.col("p_size"), 1990 + F.col("p_size"), F.col("p_partkey") % 1000, 2026).alias("score"))


RULES = [
    scoring.VenueRule(("promo", "polished tin"), "Promotion", "S", 90), scoring.VenueRule(("steel",), "Steel", "A", 80, excluded=("economy",)),
    scoring.VenueRule(("brass", "copper"), "Red metals", "B", 70), scoring.VenueRule(("small", "medium"), "Sized", "B", 60),
]


def _rule_sql(r: scoring.VenueRule) -> str:
    one = [f"regexp_matches(lower(p_type), '\\b{k}\\b')" if len(k) <= 6 else f"contains(lower(p_type), '{k}')" for k in r.keywords]
    return f"WHEN ({' OR '.join(one)})" + "".join(f" AND NOT contains(lower(p_type), '{x}')" for x in r.excluded)


@query(f"""SELECT p_partkey, CASE {' '.join(f"{_rule_sql(r)} THEN '{r.name}'" for r in RULES)} ELSE 'Other' END AS venue,
  CASE {' '.join(f"{_rule_sql(r)} THEN {r.score}" for r in RULES)} ELSE 50 END AS score FROM part""")
def venue_rules(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    named = p.select("p_type").distinct().withColumn("v", scoring.venue_of("p_type", RULES))
    return p.join(named, "p_type").select("p_partkey", F.col("v.name").alias("venue"), F.col("v.score").alias("score"))


@query("""SELECT doc_id, regexp_replace(text, '(?i)\\b(of[^A-Za-z0-9+]*the)\\b', '[\\1]', 'g') AS marked FROM documents WHERE lang = 'en'""")
def highlight(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", text.highlight("text", "of the", "[", "]").alias("marked"))


@query("""SELECT doc_id, regexp_replace(text, '(?i)\\b(of[^A-Za-z0-9+]*the)\\b', '[\\1]', 'g') AS marked FROM documents""")
def highlight_all(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.highlight("text", "of the", "[", "]").alias("marked"))


# --- literal search --------------------------------------------------------------------


def _has(normal: str, term: str) -> str:
    return f"regexp_matches({normal}, '\\b{term}\\b')"


@query(f"""WITH n AS (SELECT *, {N('title')} AS nt, {N('abstract')} AS na FROM {P}), m AS (
  SELECT *, ({_has('nt', 'the')} OR {_has('nt', 'der')} OR {_has('nt', 'was')} OR {_has('nt', 'with')}) AS mt,
    ({_has('na', 'the')} OR {_has('na', 'der')} OR {_has('na', 'was')} OR {_has('na', 'with')}) AS ma FROM n
  WHERE year BETWEEN 2003 AND 2020 AND ({_has('nt', 'the')} OR {_has('na', 'the')} OR {_has('nt', 'der')} OR {_has('na', 'der')}) AND ({_has('nt', 'was')} OR {_has('na', 'was')} OR {_has('nt', 'with')} OR {_has('na', 'with')})
), r AS (
  SELECT position, year, title,
    (({_has('nt', 'the')}) OR (NOT {_has('na', 'the')} AND {_has('nt', 'der')}) OR {_has('nt', 'was')} OR (NOT {_has('na', 'was')} AND {_has('nt', 'with')}))::INT * 100
    + (({_has('na', 'the')}) OR (NOT {_has('nt', 'the')} AND {_has('na', 'der')}) OR {_has('na', 'was')} OR (NOT {_has('nt', 'was')} AND {_has('na', 'with')}))::INT * 25 AS exact_score FROM m)
SELECT position, year, exact_score::INT AS exact_score, title FROM r ORDER BY exact_score DESC, year DESC, lower(title) DESC, position LIMIT 200""")
def keyword_and_or(spark, sf_dir):
    q = KeywordQuery.build(expression="the/der, was/with", fields="title,abstract", years=(2003, 2020))
    return keyword.search(papers(spark, sf_dir), q, 200).select("position", "year", "exact_score", "title")


@query(f"""WITH n AS (SELECT *, {N('title')} AS nt, {N('abstract')} AS na, {N('venue')} AS nv FROM {P})
SELECT position, (CASE WHEN {_has('nt', 'the')} OR {_has('nt', 'and')} OR (contains(' ' || nt || ' ', ' of the ') AND NOT 1 = 0) THEN 'title,' ELSE '' END) || (CASE WHEN {_has('na', 'the')} OR {_has('na', 'and')} OR contains(' ' || na || ' ', ' of the ') THEN 'abstract,' ELSE '' END) AS fields
FROM n WHERE ({_has('nt', 'the')} OR {_has('na', 'the')}) AND ({_has('nt', 'and')} OR {_has('na', 'and')}) AND (contains(' ' || nt || ' ', ' of the ') OR contains(' ' || na || ' ', ' of the ')) AND venue IN ('src0', 'src1', 'src2')""")
def keyword_structured(spark, sf_dir):
    q = KeywordQuery.build(all_terms=["the", "and"], any_terms=["of the"], fields="title,abstract", venues=["src0", "src1", "src2"])
    found = keyword.match(spread(keyword.within(papers(spark, sf_dir), None, q.venues)), q)
    return found.select("position", F.array_join(F.transform("matched_fields", lambda f: F.concat(f, F.lit(","))), "").alias("fields"))


@query(f"SELECT position, title, year FROM {P} WHERE year BETWEEN 2005 AND 2012 AND venue IN ('src1', 'src4') ORDER BY position LIMIT 100")
def browse_filter_limit(spark, sf_dir):
    return keyword.within(papers(spark, sf_dir), (2005, 2012), ("src1", "src4")).orderBy("position").limit(100).select("position", "title", "year")


@query(f"SELECT position, substr(abstract, 1, 200) AS abstract, length(abstract) > 200 AS abstract_truncated FROM {P}")
def compact_projection(spark, sf_dir):
    return keyword.compact(papers(spark, sf_dir), 200).select("position", "abstract", "abstract_truncated")


def _any_in(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, '\\b{w}\\b')" if w.isalnum() and len(w) <= 4 else f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


# Titles of every kind that the rules name, dealt over the records; the SQL decides by the kind of title.
_JUNK_TITLES = [
    ("Table of Contents", "junk"), ("IEEE Open Access Publishing", "junk"), ("Ceda Currents: IEEE News", "junk"), ("The Editor's Note", "junk"), ("SRP 2020", "soft"), ("Srprise in circuits", "text"),
    ("Guest Editorial on Radar", "soft"), ("A Tutorial on Filters", "useful"), ("Special Issue on Chips", "both"), ("New associate editor!", "junk"), ("A low-noise amplifier", "text"), ("Contributors", "junk"),
]


@query("""WITH t AS (SELECT doc_id AS position, ['junk', 'junk', 'junk', 'junk', 'soft', 'text', 'both', 'useful', 'both', 'junk', 'text', 'junk'][1 + (doc_id % 12)] AS kind, doc_id % 5 = 0 AS with_doi,
  lower(trim(regexp_replace(CASE WHEN doc_id % 7 = 0 THEN 'N/A' ELSE text END, '\\s+', ' ', 'g'))) AS a FROM documents)
SELECT position, CASE WHEN kind = 'junk' THEN true WHEN with_doi AND kind IN ('useful', 'both') AND a <> '' AND a NOT IN ('na', 'n/a', 'no abstract available.', 'no abstract') AND length(a) >= 30 THEN false
  WHEN kind IN ('soft', 'both') THEN true ELSE length(a) < 50 OR a IN ('', 'na', 'n/a', 'no abstract available.', 'no abstract') END AS junk FROM t""")
def junk_filter(spark, sf_dir):
    p = spread(papers(spark, sf_dir)).withColumn("title", F.element_at(F.lit([t for t, _ in _JUNK_TITLES]), (F.col("position") % 12 + 1).cast("int")))
    p = p.withColumn("abstract", F.when(F.col("position") % 7 == 0, "N/A").otherwise(F.col("abstract"))).withColumn("doi", F.when(F.col("position") % 5 == 0, "10.1/x").otherwise(""))
    return p.select("position", filters.is_junk("title", "abstract", "doi").alias("junk"))


SCOPES = {"articles": {"any": ["the of", "la de"]}, "titles": {"title": ["the", "der"], "title_all": ["and", "und"], "without": ["that"]}}


@query(f"""WITH t AS (SELECT position, lower(title) AS t, lower(title || ' ' || abstract) AS w FROM {P})
SELECT position, CASE WHEN contains(w, 'idiot') THEN '' ELSE concat_ws(',', CASE WHEN contains(w, 'the of') OR contains(w, 'la de') THEN 'articles' END,
  CASE WHEN (contains(t, 'the') OR contains(t, 'der')) AND (contains(t, 'and') OR contains(t, 'und')) AND NOT contains(t, 'that') THEN 'titles' END) END AS labels FROM t""")
def relevance_labels(spark, sf_dir):
    return papers(spark, sf_dir).select("position", F.array_join(filters.labels("title", F.col("abstract"), SCOPES, ["idiot"]), ",").alias("labels"))


# --- vectors ---------------------------------------------------------------------------

_COS = "list_cosine_similarity(embedding::DOUBLE[], {q}::DOUBLE[])"


def _vec(spark, sf_dir, vec_id: int) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else []


@query(f"""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) SELECT vec_id, label, round({_COS.format(q='q')}, 6) AS similarity FROM embeddings, q ORDER BY {_COS.format(q='q')} DESC, vec_id LIMIT 25""")
def cosine_topk(spark, sf_dir):
    return vector.top_k(table(spark, sf_dir, "embeddings"), _vec(spark, sf_dir, 7), 25).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id IN (3, 50, 111, 400)), s AS (SELECT query_id, vec_id, {_COS.format(q='q')} AS s FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM s) SELECT query_id, vec_id, rank, round(s, 6) AS similarity FROM r WHERE rank <= 10""")
def cosine_topk_many(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.where(F.col("vec_id").isin(3, 50, 111, 400)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vector.top_k_many(e, asked, 10).select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, {_COS.format(q='q')} AS s FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM s) SELECT query_id, vec_id, rank, round(s, 6) AS similarity FROM r WHERE rank <= 10""")
def cosine_topk_all(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vector.top_k_many(e, asked, 10).select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 11), h AS (SELECT vec_id, label, {_COS.format(q='q')} AS s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 200)
SELECT vec_id, label, round(s, 6) AS similarity FROM h WHERE label % 3 = 0 ORDER BY s DESC, vec_id LIMIT 20""")
def fetch_then_filter(spark, sf_dir):
    hits = vector.fetch_then_filter(table(spark, sf_dir, "embeddings"), _vec(spark, sf_dir, 11), 20, F.col("label") % 3 == 0)
    return hits.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 11), c AS (SELECT doc_id AS vec_id FROM documents WHERE lang = 'de')
SELECT vec_id, round({_COS.format(q='q')}, 6) AS similarity FROM embeddings JOIN c USING (vec_id), q ORDER BY {_COS.format(q='q')} DESC, vec_id LIMIT 20""")
def filter_then_rank(spark, sf_dir):
    some = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("doc_id").alias("vec_id"))
    return vector.filter_then_rank(some, table(spark, sf_dir, "embeddings"), _vec(spark, sf_dir, 11), 20).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 5), h AS (SELECT vec_id, {_COS.format(q='q')} AS s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 40),
p AS (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id)::INT AS place FROM h), j AS (SELECT p.*, l.quality * 50 + l.toxic * 25 AS score FROM p LEFT JOIN labels l ON l.doc_id = vec_id)
SELECT vec_id, place, CASE WHEN place <= 30 THEN coalesce(score::DOUBLE, round(100 * s)) END AS rerank_score FROM j ORDER BY place <= 30 DESC, rerank_score DESC NULLS LAST, s DESC, vec_id LIMIT 40""")
def rerank_with_fallback(spark, sf_dir):
    hits = vector.top_k(table(spark, sf_dir, "embeddings"), _vec(spark, sf_dir, 5), 40)
    scores = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), (F.col("quality") * 50 + F.col("toxic") * 25).alias("score"))
    return vector.rerank(hits, scores, 30, 40).select("vec_id", "place", "rerank_score")


@query(f"""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 9), s AS (SELECT {_COS.format(q='q')} AS s FROM embeddings, q)
SELECT count(*) FILTER (s >= 0.6) AS rare, count(*) FILTER (s >= 0.4 AND s < 0.6) AS perfect, count(*) FILTER (s >= 0.25 AND s < 0.4) AS valuable, count(*) FILTER (s < 0.25) AS other FROM s""")
def relevance_buckets(spark, sf_dir):
    q = F.lit([float(x) for x in _vec(spark, sf_dir, 9)])
    return stats.relevance_buckets(table(spark, sf_dir, "embeddings").select(vector.cosine(F.col("embedding"), q).alias("similarity")))


@query("""WITH f AS (SELECT doc_id, sha1(text) AS fingerprint FROM documents), s AS (SELECT DISTINCT fingerprint FROM f WHERE doc_id % 3 = 0) SELECT doc_id, fingerprint FROM f WHERE fingerprint NOT IN (SELECT fingerprint FROM s)""")
def missing_vectors(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("fingerprint"))
    store = f.where("doc_id % 3 = 0").select("fingerprint", F.lit("m").alias("model"))
    return vector.missing_vectors(f, store, "m").select("doc_id", "fingerprint")


@query("""WITH f AS (SELECT doc_id, sha1(text) AS f FROM documents), w AS (SELECT f, count(*) AS w FROM f GROUP BY f), h AS (SELECT f, count(*) AS s FROM f WHERE doc_id % 2 = 0 GROUP BY f),
t AS (SELECT sum(coalesce(w, 0))::BIGINT AS rows, sum(coalesce(s, 0))::BIGINT AS stored, sum(least(coalesce(w, 0), coalesce(s, 0)))::BIGINT AS reusable FROM w FULL JOIN h USING (f))
SELECT CASE WHEN stored = 0 THEN 'none' WHEN reusable = rows AND stored = rows THEN 'exact' WHEN reusable = stored THEN 'append' WHEN reusable > 0 THEN 'partial' ELSE 'none' END AS state, rows, stored, reusable FROM t""")
def vector_cache_state(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("fingerprint"))
    return vector.cache_state(f, f.where("doc_id % 2 = 0"))


# --- statistics ------------------------------------------------------------------------


@query(f"SELECT year, count(*) AS n FROM {P} WHERE year > 1900 GROUP BY year")
def year_histogram(spark, sf_dir):
    return stats.year_histogram(papers(spark, sf_dir))


@query(f"""SELECT venue, sum((year = 2022)::INT)::BIGINT AS y2022, sum((year = 2023)::INT)::BIGINT AS y2023, sum((year = 2024)::INT)::BIGINT AS y2024, sum((year < 2022)::INT)::BIGINT AS earlier, count(*) AS total FROM {P} GROUP BY venue HAVING count(*) >= 30""")
def taxonomy_matrix(spark, sf_dir):
    return stats.taxonomy_matrix(papers(spark, sf_dir), [2022, 2023, 2024], 30)


@query(f"WITH v AS (SELECT keywords FROM {P} GROUP BY keywords HAVING count(*) < 150) SELECT position, keywords AS venue FROM {P} WHERE keywords IN (SELECT keywords FROM v)")
def purge_low_volume(spark, sf_dir):
    return stats.purge_set(papers(spark, sf_dir).withColumn("venue", F.col("keywords")), 150).select("position", "venue")


@query("""SELECT event_type, max(ts) AS last_time, sum(user_id)::BIGINT AS rows, count(DISTINCT event_id) AS files, arg_min(event_id, (-epoch_us(ts), event_id)) AS last_file FROM events GROUP BY event_type""")
def latest_updates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return stats.latest_updates(e, "event_type", "ts", "event_id", "user_id").select("event_type", "last_time", "rows", "files", "last_file")


@query("""WITH y AS (SELECT year(o_orderdate)::INT AS y, count(*) AS c FROM orders GROUP BY 1) SELECT sum(c)::BIGINT AS n, min(y) AS first_year, max(y) AS last_year, arg_max(c, y) AS in_last_year FROM y""")
def coverage_stats(spark, sf_dir):
    return stats.coverage(table(spark, sf_dir, "orders"), F.year("o_orderdate"))


# --- identity, merging, fusion ---------------------------------------------------------


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) SELECT doc_id, source, lang FROM r WHERE n = 1")
def exact_dedup_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("k", F.sha2(F.col("text").cast("binary"), 256))
    return fusion.first_wins(d.select("k", "doc_id", "source", "lang"), ["k"], "doc_id").select("doc_id", "source", "lang")


@query(f"""WITH p AS (SELECT {N('title')} AS k, * FROM {P}), r AS (SELECT k, min(position) AS position, arg_min(venue, position) AS venue, arg_max(abstract, (length(abstract), -position)) AS abstract FROM p GROUP BY k)
SELECT position, venue, length(abstract) AS n, sha1(abstract) AS abstract FROM r""")
def merge_longest(spark, sf_dir):
    p = papers(spark, sf_dir).withColumn("k", text.normalize("title"))
    m = fusion.merge_records(p, "k", "position", ["venue"], "abstract")
    return m.select("position", "venue", F.length("abstract").cast("long").alias("n"), F.sha1(F.col("abstract").cast("binary")).alias("abstract"))


_RET = """(WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS s FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s) SELECT query_id AS query_pos, vec_id AS key, round(s, 6) AS similarity FROM r WHERE rank <= 60)"""


def _retrievals(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    hits = vector.top_k_many(e, asked, 60)
    return hits.select(F.col("query_id").alias("query_pos"), F.col("vec_id").alias("key"), F.round("similarity", 6).alias("similarity"), (F.col("query_id") % 3).alias("family"), (F.col("query_id") % 4).alias("mode"), F.lit(2020).alias("year"), (F.col("query_id") % 100 == 0).cast("int").alias("literal"))


@query(f"""WITH t AS (SELECT *, query_pos % 3 AS family, query_pos % 4 AS mode, (query_pos % 100 = 0)::INT AS literal FROM {_RET}),
a AS (SELECT key, count(*) AS retrievals, count(DISTINCT family) AS families, count(DISTINCT mode) AS modes, max(literal) AS literal, max(similarity) AS similarity FROM t GROUP BY key)
SELECT key, retrievals, families, modes, similarity, row_number() OVER (ORDER BY families DESC, modes DESC, literal DESC, similarity DESC, key)::INT AS rank FROM a""")
def fusion_rank(spark, sf_dir):
    return fusion.fuse(_retrievals(spark, sf_dir)).select("key", "retrievals", "families", "modes", "similarity", "rank")


@query(f"""WITH t AS (SELECT *, min(query_pos) OVER (PARTITION BY key) AS first FROM {_RET}) SELECT query_pos, count(*) AS raw_results, count(DISTINCT key) AS distinct_keys, count(*) FILTER (query_pos = first) AS new_unique FROM t GROUP BY query_pos""")
def new_unique_yield(spark, sf_dir):
    return fusion.query_yield(_retrievals(spark, sf_dir)).select("query_pos", "raw_results", "distinct_keys", "new_unique")


@query("""WITH y AS (SELECT user_id % 7 AS family, user_id % 50 AS query_pos, count(*) FILTER (event_type = 'purchase') AS new_unique FROM events GROUP BY 1, 2),
t AS (SELECT count(DISTINCT family) AS families, count(DISTINCT CASE WHEN new_unique > 0 THEN family END) AS productive, count(*) FILTER (query_pos > (SELECT coalesce(max(query_pos), -1) FROM y WHERE new_unique > 0)) AS tail FROM y)
SELECT families, productive, CASE WHEN families >= 4 AND productive >= 2 AND tail >= 2 THEN 'strong' WHEN families >= 3 AND tail >= 1 THEN 'moderate' WHEN families >= 1 THEN 'weak' ELSE 'insufficient' END AS signal FROM t""")
def saturation_signal(spark, sf_dir):
    y = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 7).alias("family"), (F.col("user_id") % 50).alias("query_pos")).agg(F.count_if(F.col("event_type") == "purchase").alias("new_unique"))
    one = y.agg(F.countDistinct("family").alias("families"), F.countDistinct(F.when(F.col("new_unique") > 0, F.col("family"))).alias("productive"))
    tail = fusion.zero_yield_tail(y).first()[0]
    return one.select("families", "productive", fusion.saturation(F.col("families"), F.col("productive"), F.lit(tail)).alias("signal"))


@query("""WITH c AS (SELECT doc_id AS key FROM labels WHERE quality = 1 AND toxic = 0), p AS (SELECT doc_id AS key FROM documents WHERE lang = 'en'),
j AS (SELECT c.key IS NOT NULL AS now, p.key IS NOT NULL AS before FROM c FULL JOIN p USING (key))
SELECT count(*) FILTER (now AND before) AS retained, count(*) FILTER (now AND NOT before) AS added, count(*) FILTER (before AND NOT now) AS removed, round(count(*) FILTER (now AND before) / nullif(count(*) FILTER (before), 0)::DOUBLE, 6) AS retention_rate FROM j""")
def set_compare(spark, sf_dir):
    now = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("key"))
    before = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("key"))
    return fusion.compare_sets(now, before).select("retained", "added", "removed", "retention_rate")


_OLD = "SELECT o_orderkey AS key, o_orderstatus || '|' || CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE o_orderpriority END AS fingerprint FROM orders WHERE o_orderkey % 7 <> 0"
_NEW = "SELECT o_orderkey AS key, o_orderstatus || '|' || o_orderpriority AS fingerprint FROM orders WHERE o_orderkey % 5 <> 0"


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    mark = lambda c: F.concat_ws("|", "o_orderstatus", c)
    old = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("key"), mark(F.when(F.col("o_orderkey") % 10 == 0, F.lit("x")).otherwise(F.col("o_orderpriority"))).alias("fingerprint"))
    return old, o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("key"), mark("o_orderpriority").alias("fingerprint"))


@query(f"""WITH a AS ({_OLD}), b AS ({_NEW}) SELECT key, CASE WHEN a.fingerprint IS NULL THEN 'added' WHEN b.fingerprint IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (key) WHERE a.fingerprint IS DISTINCT FROM b.fingerprint""")
def snapshot_diff(spark, sf_dir):
    return snapshot.diff(*_versions(spark, sf_dir))


@query(f"""WITH a AS ({_OLD}), b AS ({_NEW}), u AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE key NOT IN (SELECT key FROM b)) SELECT * FROM u WHERE key % 11 <> 0""")
def apply_delta(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    gone = table(spark, sf_dir, "orders").where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("key"))
    return snapshot.apply_delta(old, new, gone)


@query(f"""WITH p AS (SELECT position AS id, {N('title')} AS title_key, year FROM {P}), y AS (SELECT title_key, year, count(DISTINCT id) AS n, min(id) AS k FROM p WHERE title_key <> '' GROUP BY ALL), t AS (SELECT title_key, count(DISTINCT id) AS n, min(id) AS k FROM p WHERE title_key <> '' GROUP BY ALL)
SELECT p.id, CASE WHEN coalesce(y.n, t.n) = 1 THEN coalesce(y.k, t.k) END AS key, CASE WHEN coalesce(y.n, t.n) = 1 THEN 'found' WHEN coalesce(y.n, t.n) > 1 THEN 'ambiguous' ELSE 'missing' END AS status
FROM (SELECT id, title_key, CASE WHEN id % 2 = 0 THEN year ELSE 1900 END AS year FROM p) p LEFT JOIN y ON y.title_key = p.title_key AND y.year = p.year LEFT JOIN t ON t.title_key = p.title_key""")
def hydrate_lookup(spark, sf_dir):
    p = papers(spark, sf_dir).select(F.col("position").alias("id"), text.normalize("title").alias("title_key"), "year", F.lit("").alias("doi_key"), F.col("position").alias("key"))
    wanted = p.select("id", "doi_key", "title_key", F.when(F.col("id") % 2 == 0, F.col("year")).otherwise(1900).alias("year"))
    return ingest.hydrate(wanted, p)


@query(f"""WITH RECURSIVE p AS (SELECT position, {N('title')} AS t, year FROM {P}), k AS (SELECT CASE WHEN t <> '' THEN 'title_year:' || t || '|' || year ELSE 'position:' || position END AS key, t FROM p),
g AS (SELECT k.key, CASE WHEN t <> '' THEN min(k.key) OVER (PARTITION BY t) ELSE k.key END AS root FROM k) SELECT substr(sha1(root), 1, 12) AS family, count(*) AS size FROM g GROUP BY root""")
def family_components(spark, sf_dir):
    p = papers(spark, sf_dir).withColumn("year", F.col("year").cast("string")).withColumn("authors", F.array().cast("array<string>"))
    # records without a title are told apart by their position
    p = p.withColumn("doi", F.lit("")).withColumn("abstract", F.when(text.normalize("title") == "", F.col("position").cast("string")).otherwise(F.col("abstract")))
    named = family.assign_families(p.where(text.normalize("title") != ""))
    rest = p.where(text.normalize("title") == "").select(F.substr(F.sha1(F.concat(F.lit("position:"), F.col("position").cast("string")).cast("binary")), F.lit(1), F.lit(12)).alias("family"), F.lit(1).cast("long").alias("size"))
    return named.groupBy(F.substr("work_family_id", F.lit(4), F.lit(12)).alias("family")).agg(F.count("*").alias("size")).unionByName(rest)


@query(f"""WITH p AS (SELECT trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS title_key, year FROM {P}), g AS (SELECT title_key, list_sort(list_distinct(list(year::VARCHAR))) AS years FROM p WHERE title_key <> '' GROUP BY title_key)
SELECT 'title_year::' || title_key AS id, 'same_title_different_year' AS kind, array_to_string(years, ', ') AS signals FROM g WHERE len(years) > 1""")
def conflict_groups(spark, sf_dir):
    return conflicts.year_conflicts(papers(spark, sf_dir))


# --- evidence, dates, pages, streams ---------------------------------------------------


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, least(l_quantity, l_quantity * l_discount * 20) AS lo, greatest(l_quantity, l_quantity * l_discount * 20) AS hi FROM lineitem), o AS (SELECT *, greatest(0.0, least(hi, 30.0) - greatest(lo, 10.0)) AS overlap FROM b)
SELECT l_orderkey, l_linenumber, round(overlap, 6) AS overlap, CASE WHEN overlap = 0 AND (hi = 10 OR lo = 30) THEN 'endpoint_only' WHEN overlap = 0 THEN 'outside' WHEN lo <= 10 AND hi >= 30 THEN 'full_cover' WHEN lo >= 10 AND hi <= 30 THEN 'inside_target' ELSE 'partial_overlap' END AS relation FROM o""")
def band_overlap(spark, sf_dir):
    x = F.col("l_quantity") * F.col("l_discount") * 20
    lo, hi, a, b = F.least("l_quantity", x), F.greatest("l_quantity", x), F.lit(10.0), F.lit(30.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(scoring.band_overlap(lo, hi, a, b), 6).alias("overlap"), scoring.band_relation(lo, hi, a, b).alias("relation"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity::INT::DOUBLE AS low, (l_quantity::INT + l_linenumber)::DOUBLE AS high, (l_suppkey % 300 + 1)::DOUBLE AS kelvin,
  CASE WHEN l_suppkey % 300 + 1 <= 4.2 THEN '<=4.2K' WHEN l_suppkey % 300 + 1 <= 20 THEN '4.2-20K' WHEN l_suppkey % 300 + 1 <= 77 THEN '20-77K' WHEN l_suppkey % 300 + 1 <= 120 THEN '77-120K' ELSE '>120K' END AS bucket FROM lineitem""")
def mention_extract(spark, sf_dir):
    said = F.concat_ws("", F.lit("measured "), F.col("l_quantity").cast("int"), F.lit("-"), F.col("l_quantity").cast("int") + F.col("l_linenumber"), F.lit(" GHz at "), F.col("l_suppkey") % 300 + 1, F.lit(" K"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", said.alias("said")).withColumns({"f": F.get(scoring.frequency_mentions("said"), F.lit(0)), "t": F.get(scoring.temperature_mentions("said"), F.lit(0))})
    return rows.select("l_orderkey", "l_linenumber", F.col("f.low").alias("low"), F.col("f.high").alias("high"), F.col("t").alias("kelvin"), scoring.temperature_bucket(F.col("t")).alias("bucket"))


@query("""SELECT i::INT AS window, greatest(DATE '2021-03-31' - (i * 90)::INT - 89, DATE '2019-01-15')::VARCHAR AS first, (DATE '2021-03-31' - (i * 90)::INT)::VARCHAR AS last FROM range(0, 9) t(i) WHERE DATE '2021-03-31' - (i * 90)::INT >= DATE '2019-01-15'""")
def date_windows(spark, sf_dir):
    w = dates.date_windows(spark, "2019-01-15", "2021-03-31", 90)
    return w.select("window", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::INT AS links, len(list_distinct(regexp_extract_all(html, '<a href="(/[^"?#]*)', 1)))::INT AS distinct_links FROM pages""")
def html_title_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(links).alias("links"), F.size(readers.article_links("html", "/")).alias("distinct_links"))


@query("SELECT event_type, user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY event_type, user_id")
def incremental_upsert(spark, sf_dir):
    """State after all daily batches: the last event of a key wins."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "ts", "event_id")
    return fusion.last_wins(e.withColumn("o", F.struct("ts", "event_id")), ["event_type", "user_id"], "o").drop("o")


@query("""SELECT user_id::VARCHAR AS state_key, count(*) AS search_count, array_to_string(list_sort(list_distinct(list(event_type) FILTER (value >= 0.25))), ',') AS queries FROM events GROUP BY user_id""")
def user_state_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("state_key"), F.col("value").alias("similarity"), F.col("event_type").alias("query"))
    return streaming.search_counters(e).select("state_key", "search_count", F.array_join("queries", ",").alias("queries"))


@query("""SELECT user_id % 20 AS source, max(CASE WHEN event_type <> 'error' THEN ts::DATE END)::VARCHAR AS last_checked FROM events GROUP BY 1""")
def advance_checkpoints(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("source"), (F.col("event_type") != "error").alias("complete"), F.to_date("ts").alias("covered_to"))
    control = e.select("source").distinct().withColumn("last_checked", F.lit(None).cast("date"))
    return streaming.advance_checkpoints(control, e).withColumn("last_checked", F.col("last_checked").cast("string"))


@query(f"""SELECT position, '@ARTICLE{{' || 'Author' || year || upper(substr(w, 1, 1)) || lower(substr(w, 2)) || ',' || chr(10) || '  author={{A. Author}},' || chr(10) || '  journal={{' || trim(venue) || '}}' || CASE WHEN t <> '' THEN ',' || chr(10) || '  title={{' || t || '}}' ELSE '' END
  || ',' || chr(10) || '  year={{' || year || '}},' || chr(10) || '  pages={{3-9}},' || chr(10) || '  keywords={{LNA;' || keywords || ';lna}}' || chr(10) || '}}' || chr(10) AS entry
FROM (SELECT *, string_split_regex(trim(regexp_replace(t, '[^a-zA-Z0-9\\s]', '', 'g')), '\\s+')[1] AS w FROM (SELECT *, trim(title) AS t FROM {P}))""")
def bibtex_export(spark, sf_dir):
    p = papers(spark, sf_dir)
    extra = {n: F.lit("") for n in ("article_number", "document_identifier", "pages", "volume", "number", "issue")}
    p = p.withColumns(extra | {"start_page": F.lit("3"), "end_page": F.lit("9")})
    p = p.withColumn("authors", F.array(F.lit("A. Author"))).withColumn("ieee_terms", F.array(F.lit("LNA"))).withColumn("keywords", F.array(F.col("keywords"), F.lit("lna"), F.lit("LNA")))
    return p.select("position", sinks.bibtex().alias("entry"))


@query(f"""SELECT position, row_number() OVER (ORDER BY lower(venue), year, lower(title), position)::INT AS number FROM {P}""")
def report_order(spark, sf_dir):
    return sinks.report_order(papers(spark, sf_dir)).select("position", "number")


@query("""WITH b AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents), a AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE doc_id % 2 = 0)
SELECT a.doc_id AS candidate, b.doc_id AS position FROM a JOIN b ON a.text = b.text AND a.n = b.n""")
def consume_candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), F.sha2(F.col("text").cast("binary"), 256).alias("match_key"))
    return ingest.consume_candidates(d.where("position % 2 = 0"), d).select("candidate", "position")




# --- more identity, deltas, runs, streams ----------------------------------------------


@query(f"""WITH p AS (SELECT position, {N('title')} AS title_key, CASE WHEN position % 4 = 0 THEN year ELSE 2020 END AS year, CASE WHEN position % 3 = 0 THEN '10.1/' || position % 40 ELSE '' END AS doi FROM {P}),
y AS (SELECT title_key, year, count(DISTINCT doi) AS n, min(doi) AS d FROM p WHERE doi <> '' GROUP BY ALL), t AS (SELECT title_key, count(DISTINCT doi) AS nt, min(doi) AS dt, max(CASE WHEN year = 0 THEN doi END) AS d0 FROM p WHERE doi <> '' GROUP BY ALL)
SELECT position, coalesce('doi:' || CASE WHEN doi <> '' THEN doi WHEN n = 1 THEN d WHEN n IS NULL AND nt = 1 AND (p.year = 0 OR d0 IS NOT NULL) THEN dt END, 'title|' || p.title_key || '|' || p.year) AS publication
FROM p LEFT JOIN y ON y.title_key = p.title_key AND y.year = p.year LEFT JOIN t ON t.title_key = p.title_key""")
def resolve_publications(spark, sf_dir):
    p = papers(spark, sf_dir)
    year = F.when(F.col("position") % 4 == 0, F.col("year")).otherwise(2020)
    doi = F.when(F.col("position") % 3 == 0, F.concat(F.lit("10.1/"), (F.col("position") % 40).cast("string"))).otherwise("")
    rows = p.select("position", text.normalize("title").alias("title_key"), year.alias("year"), doi.alias("doi"))
    return fusion.resolve_publications(rows).select("position", "publication")


@query("""WITH c AS (SELECT event_type AS dimension, (user_id % 5)::VARCHAR AS value, event_id % 9 AS query_id FROM events) SELECT dimension, value, array_to_string(list_sort(list_distinct(list(query_id))), ',') AS queries FROM c GROUP BY ALL""")
def coverage_map(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    q = e.select((F.col("event_id") % 9).alias("query_id"), F.create_map(F.col("event_type"), F.array((F.col("user_id") % 5).cast("string"))).alias("covers"))
    return fusion.coverage(q).select("dimension", "value", F.array_join("queries", ",").alias("queries"))


@query(f"""WITH s AS (SELECT doc_id AS position FROM labels WHERE toxic = 1), g AS (SELECT title FROM {P} WHERE position IN (SELECT position FROM s) AND title <> '') SELECT position, venue FROM {P} WHERE position NOT IN (SELECT position FROM s) AND title NOT IN (SELECT title FROM g)""")
def purge_selected(spark, sf_dir):
    p = papers(spark, sf_dir).withColumn("key", F.col("position").cast("string"))
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("position"))
    return snapshot.purge(p, p.join(bad, "position").select("key", "title")).select("position", "venue")


@query(f"""WITH k AS (SELECT position, venue, {N('title')} AS t FROM {P}) SELECT position, venue FROM k WHERE venue = 'src2' AND t NOT IN (SELECT t FROM k WHERE venue <> 'src2')""")
def uncovered_source(spark, sf_dir):
    k = papers(spark, sf_dir).select("position", "venue", text.normalize("title").alias("key"))
    return snapshot.uncovered(k.where("venue = 'src2'"), k.where("venue <> 'src2'")).select("position", "venue")


@query(f"""WITH a AS ({_OLD}), b AS ({_NEW}) SELECT count(*) FILTER (a.key IS NULL) AS inserted, count(*) FILTER (a.fingerprint <> b.fingerprint) AS replaced, count(*) FILTER (a.fingerprint = b.fingerprint) AS skipped FROM b LEFT JOIN a ON a.key = b.key""")
def delta_counts(spark, sf_dir):
    return snapshot.delta_counts(*_versions(spark, sf_dir))


@query("""WITH t AS (SELECT p_partkey AS id, p_size AS revision, p_name AS name, p_brand AS note FROM part WHERE p_partkey % 3 <> 0), c AS (SELECT p_partkey AS id, 25 AS revision, upper(p_name) AS name, 'own' AS note FROM part WHERE p_partkey % 4 <> 0)
SELECT id, CASE WHEN t.id IS NULL THEN c.revision WHEN c.id IS NULL OR t.revision > c.revision THEN t.revision ELSE c.revision END AS revision, CASE WHEN t.id IS NULL THEN c.name WHEN c.id IS NULL OR t.revision > c.revision THEN t.name ELSE c.name END AS name,
  CASE WHEN c.id IS NULL THEN t.note ELSE c.note END AS note FROM t FULL JOIN c USING (id)""")
def registry_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("revision"), F.col("p_name").alias("name"), F.col("p_brand").alias("note"))
    c = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("id"), F.lit(25).alias("revision"), F.upper("p_name").alias("name"), F.lit("own").alias("note"))
    return snapshot.merge_registry(t, c, ["note"])


@query("""WITH i AS (SELECT user_id AS run_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'pending' ELSE 'completed' END AS status FROM events),
r AS (SELECT run_id, count(*) AS n, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS waiting FROM i GROUP BY run_id)
SELECT run_id, CASE WHEN completed = n THEN 'completed' WHEN waiting > 0 AND completed + failed > 0 THEN 'running' WHEN waiting = n THEN 'queued' ELSE 'partial' END AS state, completed, failed FROM r""")
def run_states(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "pending").otherwise("completed")
    return streaming.run_state(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), status.alias("status")))


@query("""WITH r AS (SELECT doc_id % 300 AS position, text FROM documents WHERE doc_id % 2 = 1), k AS (SELECT trim(regexp_replace(lower(regexp_extract(text, '^[^\\n.!?]*')), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t, doc_id FROM documents),
c AS (SELECT t, count(DISTINCT doc_id) AS n, min(doc_id) AS target FROM k WHERE t <> '' AND doc_id % 2 = 0 GROUP BY t)
SELECT k.doc_id AS position, CASE WHEN c.n = 1 THEN c.target END AS target, CASE WHEN c.n = 1 THEN 'matched' WHEN c.n > 1 THEN 'ambiguous' ELSE 'missing' END AS status FROM k LEFT JOIN c USING (t) WHERE k.doc_id % 2 = 1 AND k.t <> ''""")
def enrich_lookup(spark, sf_dir):
    p = papers(spark, sf_dir).withColumn("year", F.lit(""))
    return ingest.enrich_targets(p.where("position % 2 = 1"), p.where("position % 2 = 0")).select("position", "target", "status")


@query("""SELECT event_type || '|' || user_id AS key, min(event_id) AS position, arg_min(value, event_id) AS value FROM events GROUP BY 1""")
def stream_upsert(spark, sf_dir):
    """The events as a file stream, upserted by key in one available-now run."""
    import uuid

    from lectern.operators.durable import shared_dir

    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "events").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")
    keyed = lambda df: df.select(F.concat_ws("|", "event_type", "user_id").alias("key"), F.col("event_id").alias("position"), "value")
    streaming.ingest_files(spark, f"{sf_dir}/event[s].parquet", source, f"{where}/out", f"{where}/log", clean=keyed).awaitTermination()
    return streaming.current(spark, f"{where}/out").select("key", "position", "value")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts)::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def windowed_counts(spark, sf_dir):
    counts = streaming.windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "1 hour", ["event_type"])
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n")


from lectern.plans import catalogue_index, catalogue_more  # noqa: E402, F401 - register their queries
