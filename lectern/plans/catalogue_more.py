"""More registered queries: keys, dates, cards, runs, sources, merging and evidence, with DuckDB SQL.

Records are documents with a made-up DOI for every second one, authors from source and
language, and the year as text. SQL states its own values; none is taken from the library.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import dates, keys, scope, scoring, text
from lectern.operators import cards, collect, conflicts, control, evidence as evidences, family, filters, fusion, ingest, keyword, snapshot, stats, vector
from lectern.operators.durable import dealt_by, materialize, shared_dir
from lectern.plans.catalogue import N, P, T, papers, query, table
from lectern.plans.query import FIELDS, KeywordQuery, Query
from lectern.sources import readers, sinks
from lectern.streaming import ingest as streaming

R = f"""(SELECT position, title, abstract, venue, keywords, year::VARCHAR AS year, CASE WHEN position % 2 = 0 THEN 'https://doi.org/10.1000/X' || (position % 40) ELSE '' END AS doi,
  [venue || ' Smith', 'A. ' || keywords] AS authors FROM {P})"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir).withColumn("year", F.col("year").cast("string"))
    doi = F.when(F.col("position") % 2 == 0, F.concat(F.lit("https://doi.org/10.1000/X"), (F.col("position") % 40).cast("string"))).otherwise("")
    return p.withColumn("doi", doi).withColumn("authors", F.array(F.concat("venue", F.lit(" Smith")), F.concat(F.lit("A. "), "keywords")))


def squeeze_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def loose_sql(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g'))"






D = "regexp_replace(lower(trim(doi)), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '')"

# --- identity keys ---------------------------------------------------------------------


@query(f"""SELECT position, CASE WHEN doi <> '' THEN 'doi:' || {D} WHEN {N('title')} <> '' THEN 'title_year:' || {N('title')} || '|' || year
  ELSE 'metadata:' || substr(sha1(authors[1] || ';' || authors[2] || '|' || venue || '|' || year || '|' || abstract), 1, 16) END AS key FROM {R}""")
def publication_keys(spark, sf_dir):
    return records(spark, sf_dir).select("position", keys.publication_key().alias("key"))


@query(f"""SELECT position, sha1(coalesce(array_to_string(list_filter([CASE WHEN doi <> '' THEN 'doi::' || lower({squeeze_sql('doi')}) END, CASE WHEN {loose_sql('title')} <> '' THEN 'title_year::' || {loose_sql('title')} || '::' || year END,
  CASE WHEN {loose_sql('title')} <> '' THEN 'title::' || {loose_sql('title')} END], lambda x: x IS NOT NULL), chr(10)), '')) AS levels,
  CASE WHEN doi <> '' THEN 'doi::' || lower(doi) WHEN {loose_sql('title')} <> '' THEN 'title_year::' || {loose_sql('title')} || '::' || year ELSE '' END AS key FROM {R}""")
def identity_level_keys(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.select("position", F.sha1(F.array_join(keys.identity_levels(), "\n").cast("binary")).alias("levels"), keys.identity_key().alias("key"))


@query(f"""SELECT position, CASE WHEN doi <> '' AND venue <> 'src1' THEN 'doi::' || lower(doi) WHEN {loose_sql('title')} <> '' THEN 'title_year::' || {loose_sql('title')} || '::' || year ELSE '' END AS snapshot_key,
  CASE WHEN doi <> '' THEN 'doi:' || upper(doi) WHEN {squeeze_sql('title')} <> '' THEN 'title_year:' || lower({squeeze_sql('title')}) || '|' || year ELSE 'fingerprint:f' END AS match_key FROM {R}""")
def snapshot_and_match_keys(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("venue", F.when(F.col("venue") == "src1", "A Textbook").otherwise(F.col("venue"))).withColumn("fingerprint", F.lit("f"))
    return r.select("position", keys.snapshot_key().alias("snapshot_key"), keys.match_key().alias("match_key"))


@query(f"""SELECT position, CASE WHEN doi <> '' THEN 'doi:' || {D} ELSE 'title_year:' || {N('title')} || '|' || year END AS detail_key,
  CASE WHEN doi <> '' THEN 'doi:' || lower(doi) WHEN position % 3 = 0 THEN 'url:http://u/' || position ELSE 'title:' || {loose_sql('title')} || '|' || year END AS staging_key,
  CASE WHEN doi <> '' THEN upper(doi) WHEN {squeeze_sql('title')} <> '' THEN {squeeze_sql('title')} || '|' || year ELSE '' END AS state_key,
  CASE WHEN doi <> '' THEN 'doi::' || lower(doi) ELSE 'title::' || {loose_sql('title')} END AS curation_key FROM {R}""")
def detail_staging_state_keys(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("url", F.when(F.col("position") % 3 == 0, F.concat(F.lit("HTTP://U/"), F.col("position").cast("string"))).otherwise(""))
    return r.select("position", keys.detail_key().alias("detail_key"), keys.staging_key().alias("staging_key"), keys.state_key().alias("state_key"), keys.curation_key().alias("curation_key"))


@query("SELECT position, sha1(trim(title || ' ' || abstract)) AS fingerprint, sha1('{\"keywords\":\"' || keywords || '\",\"position\":' || position || ',\"venue\":\"' || venue || '\"}') AS record FROM " + P)
def record_fingerprints(spark, sf_dir):
    return papers(spark, sf_dir).select("position", keys.fingerprint().alias("fingerprint"), keys.record_fingerprint(["venue", "position", "keywords"]).alias("record"))


# --- scalar functions ------------------------------------------------------------------


@query(f"SELECT page_id, {squeeze_sql('regexp_replace(html, $$<[^>]+>$$, $$ $$, $$g$$)')} AS plain, {squeeze_sql('url')} AS squeezed FROM pages".replace("$$", "'"))
def clean_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags("html").alias("plain"), text.squeeze("url").alias("squeezed"))


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_type, ' ', ';') || '; ;' || lower(p_type), ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts,
  array_to_string(string_split(p_type, ' '), '|') AS once, array_to_string(string_split(p_type, ' '), ' ') AS joined FROM part""")
def split_and_join_values(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    parts = text.split_values(F.concat(F.replace("p_type", F.lit(" "), F.lit(";")), F.lit("; ;"), F.lower("p_type")))
    twice = F.concat(F.split("p_type", " "), F.split(F.lower("p_type"), " "))
    return p.select("p_partkey", F.array_join(parts, "|").alias("parts"), F.array_join(text.distinct_values(twice), "|").alias("once"), text.join_values(F.concat(F.split("p_type", " "), F.array(F.lit(" "), F.lit("")))).alias("joined"))


@query("""SELECT p_partkey, 'https://doi.org/10.1/' || replace(replace(lower(p_brand), '#', '%23'), ' ', '%20') || '(' || p_size || ')' AS link FROM part""")
def doi_links(spark, sf_dir):
    doi = F.concat(F.lit("https://doi.org/10.1/"), "p_brand", F.lit("("), F.col("p_size").cast("string"), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", text.doi_link(doi).alias("link"))


@query("""SELECT event_id, CASE WHEN v >= 0.6 THEN 'Rare' WHEN v >= 0.4 THEN 'Perfect' WHEN v >= 0.25 THEN 'Highly Valuable' WHEN v >= 0.15 THEN 'Relevant' ELSE 'Noise' END AS badge, 'Rare' AS browsed
FROM (SELECT event_id, (event_id % 100) / 100.0::DOUBLE AS v FROM events)""")
def badges(spark, sf_dir):
    v = (F.col("event_id") % 100) / F.lit(100.0)
    return table(spark, sf_dir, "events").select("event_id", scoring.badge(v).alias("badge"), scoring.badge(v, False).alias("browsed"))


_ST = f"(SELECT position, {T('title')} AS a, {T('abstract')} AS b FROM {P})"


@query(f"""SELECT position, CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE, 9) END AS jaccard,
  CASE WHEN least(len(a), len(b)) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / least(len(a), len(b))::DOUBLE, 9) END AS containment FROM {_ST}""")
def token_similarity(spark, sf_dir):
    a, b = text.tokens("title"), text.tokens("abstract")
    return papers(spark, sf_dir).select("position", F.round(text.jaccard(a, b), 9).alias("jaccard"), F.round(text.containment(a, b), 9).alias("containment"))


_SPACED = "regexp_replace(venue, '([a-z])([0-9])', '\\1 \\2')"


@query(f"SELECT position, {_SPACED} || ' smith|a ' || keywords || '|smith|' || keywords AS loose, length({_SPACED} || ' Smith') + length('A. ' || keywords) + 8 * len(regexp_extract_all({_SPACED} || ' Smith A. ' || keywords, '[A-Za-z]{{3,}}')) - 4 AS richness FROM {P}")
def author_names(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("authors", F.array(F.concat(F.regexp_replace("venue", "([a-z])([0-9])", "$1 $2"), F.lit(" Smith")), F.concat(F.lit("A. "), "keywords")))
    return r.select("position", F.array_join(text.author_keys(F.col("authors"), loose=True), "|").alias("loose"), text.author_richness(F.col("authors")).alias("richness"))


@query("""SELECT p_partkey, (CASE WHEN p_size % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 20 ELSE 0 END + 10 + CASE WHEN p_size % 5 <> 0 THEN 10 ELSE 0 END + 2)::INT AS points FROM part""")
def completeness_points(spark, sf_dir):
    n = F.col("p_size")
    fields = {"volume": F.when(n % 2 == 0, "7"), "issue": F.lit(""), "number": F.when(n % 3 == 0, "1"), "start_page": F.lit("5"), "end_page": F.lit(" "), "pages": F.when(n % 5 == 0, "1-1").otherwise("5-9"), "publisher": F.lit("P")}
    p = table(spark, sf_dir, "part").withColumns(fields)
    return p.select("p_partkey", scoring.completeness(lambda c: F.col(c) if c in fields else F.lit("")).alias("points"))


@query("""SELECT p_partkey, CASE WHEN p_size >= 20 THEN 20.0 END::DOUBLE AS low, CASE WHEN p_size >= 20 THEN p_size + 0.5 END::DOUBLE AS high FROM part""")
def parsed_bands(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("b", scoring.parse_band(F.concat(F.lit("from 20 to "), F.col("p_size").cast("string"), F.lit(".5 GHz"))))
    return p.select("p_partkey", F.col("b.low").alias("low"), F.col("b.high").alias("high"))


@query("""SELECT l_orderkey, l_linenumber, least(l_quantity, 400.0) AS kelvin, CASE WHEN l_quantity <= 4.2 THEN '<=4.2K' WHEN l_quantity <= 20 THEN '4.2-20K' WHEN l_quantity <= 77 THEN '20-77K' WHEN l_quantity <= 120 THEN '77-120K' ELSE '>120K' END AS bucket FROM lineitem""")
def temperatures(spark, sf_dir):
    line = F.concat(F.lit("cooled to "), F.col("l_quantity").cast("string"), F.lit(" K, not 999 K"))
    found = scoring.temperature_mentions(line)
    t = table(spark, sf_dir, "lineitem").withColumn("t", F.get(found, F.lit(0)))
    return t.select("l_orderkey", "l_linenumber", F.col("t").alias("kelvin"), scoring.temperature_bucket(F.col("t")).alias("bucket"))


@query("""SELECT o_orderkey, (CASE WHEN g >= 2 THEN d ELSE d + 1 END)::VARCHAR AS from_checked, (coalesce(CASE WHEN g = 0 THEN d END, DATE '2026-01-31' - 30))::VARCHAR AS from_lookback FROM (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 4 AS g FROM orders)""")
def start_dates(spark, sf_dir):
    none_date, none_int = F.lit(None).cast("date"), F.lit(None).cast("int")
    d, g, today = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4, F.lit("2026-01-31").cast("date")
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", dates.start_date(d, g, none_date, none_int, none_int, today).cast("string").alias("from_checked"), dates.start_date(none_date, g, F.when(g == 0, d), F.lit(30), none_int, today).cast("string").alias("from_lookback"))


@query("""WITH m AS (SELECT o_orderkey, least(date_trunc('month', o_orderdate)::DATE + INTERVAL 1 MONTH, DATE '1998-03-01')::DATE AS s, o_orderkey % 3 = 0 AS c FROM orders)
SELECT o_orderkey, (CASE WHEN c THEN date_trunc('year', s)::DATE ELSE s END)::VARCHAR AS first, (CASE WHEN c THEN (date_trunc('year', s) + INTERVAL 12 MONTH - INTERVAL 1 DAY)::DATE ELSE last_day(s) END)::VARCHAR AS last FROM m""")
def month_batches(spark, sf_dir):
    a, b = dates.next_month_window(F.col("o_orderdate").cast("date"), F.lit("1998-03-15").cast("date"), F.col("o_orderkey") % 3 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", a.cast("string").alias("first"), b.cast("string").alias("last"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name || ' (IF 2.5, Q1)' WHEN s_suppkey % 3 = 1 THEN s_name || ' (Conference)' ELSE s_name END AS display FROM supplier""")
def venue_displays(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    s = scoring.venue_display(F.col("s_name"), F.when(k == 1, "Conference").otherwise("Journal"), F.when(k == 0, F.lit(2.5)), F.when(k == 0, "Q1"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", s.alias("display"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || '|x' ELSE '' END AS found FROM customer""")
def json_arrays(spark, sf_dir):
    answer = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('Sure: ["'), "c_mktsegment", F.lit('", "x"] there.'))).otherwise("no list [ here")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(text.first_json_array(answer), "|").alias("found"))


@query("""WITH t AS (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part), l AS (SELECT p_partkey, w, list_transform(w, lambda x: lower(x)) AS low FROM t)
SELECT p_partkey, array_to_string(list_filter(w || (CASE WHEN list_has_any(low, ['iron alloy', 'steel', 'stainless']) THEN ['iron alloy', 'steel', 'stainless'] ELSE [] END)
  || (CASE WHEN list_has_any(low, ['copper', 'brass', 'BRASS']) THEN ['copper', 'brass', 'BRASS'] ELSE [] END), lambda x, i: list_position(w || (CASE WHEN list_has_any(low, ['iron alloy', 'steel', 'stainless']) THEN ['iron alloy', 'steel', 'stainless'] ELSE [] END)
  || (CASE WHEN list_has_any(low, ['copper', 'brass', 'BRASS']) THEN ['copper', 'brass', 'BRASS'] ELSE [] END), x) = i), '|') AS terms FROM l""")
def expanded_terms(spark, sf_dir):
    found = scoring.expand_terms(F.split("p_type", " "), [("iron alloy", ["steel", "stainless"]), ("copper", ["brass", "BRASS"])])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, "|").alias("terms"))


_RT = f"(SELECT position, ' ' || {N('title')} || ' ' AS t, ' ' || {N('abstract')} || ' ' AS x FROM {P})"


@query(f"""SELECT position, CASE WHEN contains(t, ' and ') AND (contains(t, ' the ') OR contains(x, ' the ')) THEN 'container_with_focus' WHEN contains(t, ' the ') THEN 'focus' WHEN contains(t, ' and ') AND contains(x, ' was ') THEN 'container_with_frontend'
  WHEN contains(t, ' and ') THEN 'container_to_verify' WHEN contains(t, ' der ') THEN 'device' ELSE 'unclassified' END AS kind FROM {_RT}""")
def record_types(spark, sf_dir):
    kind = scoring.record_type(text.normalize("title"), text.normalize("abstract"), [" the "], [" and "], [" der "], [" was "])
    return papers(spark, sf_dir).select("position", kind.alias("kind"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, l_suppkey % 300 + 1 AS k, CASE WHEN l_partkey % 3 = 0 THEN 'SiGe' WHEN l_partkey % 3 = 1 THEN 'GaAs' END AS t, l_partkey % 5 = 0 AS c, l_partkey % 2 = 0 AS f FROM lineitem),
m AS (SELECT *, greatest(0.0, least(q + l_linenumber, 30.0) - greatest(q, 20.0)) AS o1, CASE WHEN f THEN 3.0 ELSE 0.0 END AS o2 FROM x)
SELECT l_orderkey, l_linenumber, coalesce(t, '') AS technology, CASE WHEN k <= 4.2 THEN '<=4.2K' WHEN k <= 20 THEN '4.2-20K' WHEN k <= 77 THEN '20-77K' WHEN k <= 120 THEN '77-120K' ELSE '>120K' END AS bucket, CASE WHEN q > 25 THEN 'measured' ELSE 'simulation_only' END AS measurement,
  CASE WHEN o1 >= o2 THEN q ELSE 22 END::DOUBLE AS low, greatest(o1, o2)::DOUBLE AS overlap, 1 + f::INT AS mentions, 'suspected_corrupted_frequency_range_separator' AS quality, CASE WHEN q > 25 THEN '' ELSE 'simulation_only' END AS credibility,
  concat_ws(',', CASE WHEN t IS NULL THEN 'technology' END, CASE WHEN k > 120 THEN 'cryogenic' END, CASE WHEN NOT c THEN 'circuit' END, CASE WHEN greatest(o1, o2) = 0 THEN 'frequency' END) AS missing FROM m""")
def evidence_snapshots(spark, sf_dir):
    q, n, part = F.col("l_quantity").cast("int"), F.col("l_linenumber"), F.col("l_partkey")
    said = F.concat_ws("", F.when(q > 25, "Measured ").otherwise("Simulation of "), q, F.lit(" 每 "), q + n, F.lit(" GHz at "), F.col("l_suppkey") % 300 + 1, F.lit(" K"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    rows = dealt_by(lines, "l_orderkey", "l_linenumber").select(
        F.struct("l_orderkey", "l_linenumber").alias("line"), said.alias("abstract"), F.when(part % 5 == 0, "A Low-Noise amplifier").otherwise("An antenna").alias("title"),
        F.when(part % 3 == 0, "SiGe").when(part % 3 == 1, "GaAs").alias("technology_process"), F.when(part % 2 == 0, "22-25").alias("lna_band_ghz"),
    )
    s = evidences.snapshot(rows, (20, 30), key="line")
    return s.select(
        "line.*", F.array_join("technologies", ",").alias("technology"), F.array_join("temperature_buckets", ",").alias("bucket"), "measurement", F.col("best.low").alias("low"), F.col("best.overlap").alias("overlap"),
        F.size("frequencies").alias("mentions"), F.array_join("quality_flags", ",").alias("quality"), F.array_join("credibility_flags", ",").alias("credibility"), F.array_join("missing", ",").alias("missing"),
    )


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, greatest(0.0, least(l_quantity + 5, 30.0) - greatest(l_quantity, 20.0)) AS o, l_quantity AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN q > 25 THEN 'evidenced' ELSE 'unknown' END AS technology, CASE WHEN q < 10 THEN 'evidenced' ELSE 'unknown' END AS cryogenic, CASE WHEN o > 0 THEN 'evidenced' ELSE 'contradicted' END AS frequency,
  CASE WHEN o = 0 AND (q + 5 = 20 OR q = 30) THEN 'endpoint_only' WHEN o = 0 THEN 'outside' WHEN q <= 20 AND q + 5 >= 30 THEN 'full_cover' WHEN q >= 20 AND q + 5 <= 30 THEN 'inside_target' ELSE 'partial_overlap' END AS relation FROM x""")
def evidence(spark, sf_dir):
    q = F.col("l_quantity")
    axes = scoring.evidence_axes(F.when(q > 25, F.array(F.lit("cmos"))).otherwise(F.array().cast("array<string>")), q < 10, F.lit(False), F.array(scoring.band_overlap(q, q + 5, F.lit(20.0), F.lit(30.0))))
    rows = table(spark, sf_dir, "lineitem").withColumn("a", axes)
    return rows.select("l_orderkey", "l_linenumber", *(F.col("a")[n].alias(n) for n in ("technology", "cryogenic", "frequency")), scoring.band_relation(q, q + 5, F.lit(20.0), F.lit(30.0)).alias("relation"))


@query(f"SELECT position, (title <> '' AND {squeeze_sql('abstract')} <> '' AND {squeeze_sql('abstract')} <> 'NA') AS importable FROM {P}".replace("title <> ''", f"{squeeze_sql('title')} <> ''"))
def import_guard(spark, sf_dir):
    return papers(spark, sf_dir).select("position", filters.importable("title", "abstract").alias("importable"))


# --- cards, orders, views, responses -----------------------------------------------------

_HIT = f"(SELECT position, title, abstract, venue, year::INT AS year, doi, authors, round((position * 37 % 100) / 100.0, 2)::DOUBLE AS similarity FROM {R})"


def _hits(spark, sf_dir) -> DataFrame:
    return records(spark, sf_dir).withColumn("similarity", F.round((F.col("position") * 37 % 100) / F.lit(100.0), 2))


@query(f"SELECT position, year, similarity, row_number() OVER (ORDER BY year DESC, similarity DESC, position)::INT AS place FROM {_HIT} ORDER BY place LIMIT 300")
def order_by_year(spark, sf_dir):
    ordered = cards.result_order(_hits(spark, sf_dir), "year").limit(300).withColumn("year", F.col("year").cast("int"))
    return ordered.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("year"), F.desc("similarity"), "position"))).select("position", "year", "similarity", "place")


@query(f"""SELECT position, round(60 + CASE WHEN 2026 - year < 10 THEN 10 - (2026 - year) ELSE 0 END + CASE WHEN position % 50 > 0 THEN least(15.0, log10(position % 50 + 1) * 6) ELSE 0 END, 6)::DOUBLE AS comp_score
FROM {_HIT} WHERE similarity >= 0.25 ORDER BY comp_score DESC, position LIMIT 200""")
def order_comprehensive(spark, sf_dir):
    score = F.round(scoring.paper_score(F.lit(60), F.col("year").cast("int"), F.col("position") % 50, 2026), 6)
    return cards.result_order(_hits(spark, sf_dir), "comprehensive", score).limit(200).select("position", F.col("comp_score").cast("double").alias("comp_score"))


@query(f"""WITH c AS (SELECT 'HTTPS://DOI.ORG/10.1000/X' || (p_partkey % 40) AS d, max(p_size) AS n FROM part WHERE p_partkey % 4 = 0 GROUP BY 1), u AS (SELECT doc_id, quality, toxic FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) AS k FROM labels) WHERE k = 1)
SELECT r.position, coalesce(c.n, 0) AS citation_count, coalesce('rated ' || u.quality, 'Unrated') AS rating, coalesce(u.toxic, 0) AS open_count FROM {R} r LEFT JOIN c ON c.d = upper(r.doi) LEFT JOIN u ON u.doc_id = r.position AND r.doi = ''""")
def citations_and_states(spark, sf_dir):
    r = records(spark, sf_dir)
    some = table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(F.concat(F.lit("https://doi.org/10.1000/x"), (F.col("p_partkey") % 40).cast("string")).alias("doi"), F.col("p_size").alias("citations"))
    first = fusion.first_wins(table(spark, sf_dir, "labels").withColumn("o", F.struct("quality", "toxic")), ["doc_id"], "o").select(F.col("doc_id").alias("position"), "quality", "toxic")
    own = r.where("doi = ''").withColumn("title", F.concat(F.lit("t"), F.col("position").cast("string")))
    states = own.join(first, "position").select(keys.state_key().alias("state_key"), F.concat(F.lit("rated "), F.col("quality").cast("string")).alias("rating"), F.lit("").alias("comments"), F.col("toxic").alias("open_count"), F.lit(0).alias("search_count"))
    r = r.withColumn("title", F.concat(F.lit("t"), F.col("position").cast("string")))
    return cards.with_user_state(cards.with_citations(r, some), states).select("position", "citation_count", "rating", "open_count")


@query(f"""SELECT position AS rank, regexp_replace(title, '(?i)\\b(the|of)\\b', '<mark>\\1</mark>', 'g') AS title_html, authors[1] || ', ' || authors[2] AS authors_html, printf('%.1f', similarity * 100) AS similarity_percent,
  CASE WHEN similarity >= 0.6 THEN 'Rare' WHEN similarity >= 0.4 THEN 'Perfect' WHEN similarity >= 0.25 THEN 'Highly Valuable' WHEN similarity >= 0.15 THEN 'Relevant' ELSE 'Noise' END AS badge FROM {_HIT}""")
def result_cards(spark, sf_dir):
    h = _hits(spark, sf_dir).withColumns({"rank": F.col("position"), "venue_score": F.lit(60), "citation_count": F.lit(0)})
    return cards.cards(h, ["the", "of"], 2026).select("rank", "title_html", "authors_html", "similarity_percent", "badge")


@query(f"SELECT position AS rank, title, similarity, venue, year FROM {_HIT}")
def titles_view(spark, sf_dir):
    h = _hits(spark, sf_dir).select(F.col("position").alias("rank"), "title", "abstract", "similarity", "venue", F.col("year").cast("int").alias("year"))
    return cards.view(h, "titles")


@query(f"""WITH h AS (SELECT position, venue FROM {_HIT} ORDER BY position LIMIT 5)
SELECT '{{"mode":"keyword","query":"q","result_view":"standard","filters":{{"venues":"src1"}},"candidate_count":9,"result_count":' || count(*) || ',"results":[' || string_agg('{{"rank":' || position || ',"venue":"' || venue || '"}}', ',' ORDER BY position) || ']}}' AS document FROM h""")
def response_json(spark, sf_dir):
    h = _hits(spark, sf_dir).orderBy("position").limit(5).select(F.col("position").alias("rank"), "venue")
    return cards.response_document(h, "q", "keyword", {"venues": "src1"}, 9)


@query(f"SELECT position AS id, substr(abstract, 1, 900) AS abstract, keywords, round(similarity, 4) AS semantic_similarity FROM {_HIT.replace('authors, round', 'keywords, authors, round')} WHERE position <= 30")
def rerank_projection(spark, sf_dir):
    h = _hits(spark, sf_dir).withColumns({"rank": F.col("position"), "keywords": F.array("keywords"), "ieee_terms": F.array().cast("array<string>")})
    return cards.rerank_candidates(h, 30).select("id", "abstract", "keywords", "semantic_similarity")


@query(f"SELECT position, authors[1] || ', ' || authors[2] AS authors, substr(abstract, 1, 220) AS abstract_preview, CASE WHEN abstract <> '' THEN 'source_abstract' ELSE 'missing' END AS abstract_kind, CASE WHEN doi = '' THEN '' ELSE 'https://doi.org/10.1000/x' || (position % 40) END AS doi_link FROM {R}")
def provenance_items(spark, sf_dir):
    r = records(spark, sf_dir).withColumns({"source_file": F.col("venue"), "row_number": F.col("position"), "source_in_current_corpus": F.lit(True), "pdf_link": F.lit(""), "url": F.lit("")})
    item = cards.conflict_item(r.withColumn("title", F.col("title")))
    own = r.select("position", cards.authors_display(r).alias("authors"), cards.provenance().alias("p"))
    return own.join(item.select(F.col("row_number").alias("position"), "abstract_preview"), "position").select("position", "authors", "abstract_preview", "p.abstract_kind", "p.doi_link")


@query(f"""SELECT position AS rank, '## ' || title || chr(10) || '- **Authors:** ' || authors[1] || ', ' || authors[2] || chr(10) || '- **Venue & Year:** ' || venue || ' (' || year || ')' || chr(10) || '- **My Rating:** Unrated' || chr(10)
  || CASE WHEN position % 2 = 0 THEN '- **My Comments:** good' || chr(10) ELSE '' END || '### Abstract' || chr(10) || abstract || chr(10) || chr(10) || '---' || chr(10) AS section FROM {R}
UNION ALL SELECT 0 AS rank, '# Papers Context for ''all''' || chr(10) AS section""")
def context_pack_sections(spark, sf_dir):
    r = records(spark, sf_dir).withColumns({"rank": F.col("position"), "rating": F.lit(None).cast("string"), "comments": F.when(F.col("position") % 2 == 0, "good").otherwise("")})
    return cards.context_pack(r, "all").withColumn("rank", F.col("rank").cast("long"))


# --- scopes, coverage, screening, runs ---------------------------------------------------


@query(f"""WITH y AS (SELECT DISTINCT year FROM {P} ORDER BY year DESC LIMIT 3) SELECT 'latest_year' AS preset, max(year)::VARCHAR AS years FROM y
UNION ALL SELECT 'latest_three_years', string_agg(year::VARCHAR, ',' ORDER BY year DESC) FROM y UNION ALL SELECT 'full_library', ''""")
def scope_preset_years(spark, sf_dir):
    return scope.scope_presets(papers(spark, sf_dir)).select("preset", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"))


@query(f"SELECT position, year FROM {P} WHERE year IN (SELECT DISTINCT year FROM {P} ORDER BY year DESC LIMIT 3) OR year IN (2001, 2004)")
def years_in_scope(spark, sf_dir):
    p = papers(spark, sf_dir)
    return scope.latest_years(p, 3).unionByName(scope.within_years(p, [2001, 2004])).select("position", "year").distinct()


@query("""WITH s AS (SELECT 'm' || (p_partkey % 4) AS model, CASE p_size % 3 WHEN 0 THEN 'latest_year' WHEN 1 THEN 'full_library' ELSE 'other' END AS scope, p_size % 5 <> 0 AS ready FROM part), g AS (SELECT DISTINCT model, scope, CASE scope WHEN 'full_library' THEN 1 WHEN 'latest_year' THEN 2 END AS p
  FROM s WHERE ready AND scope <> 'other' AND model <> 'm0') SELECT model, arg_min(scope, p) AS scope, CASE model WHEN 'm3' THEN 1 WHEN 'm2' THEN 2 WHEN 'm1' THEN 3 END::INT AS priority FROM g GROUP BY model""")
def ready_store_suggestions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    s = p.select(F.concat(F.lit("m"), (F.col("p_partkey") % 4).cast("string")).alias("model"), F.when(F.col("p_size") % 3 == 0, "latest_year").when(F.col("p_size") % 3 == 1, "full_library").otherwise("other").alias("scope"), (F.col("p_size") % 5 != 0).alias("ready"))
    return scope.ready_stores(s, ["full_library", "latest_year"], ["m3", "m2", "m1", "m0"], "m0")


@query("""SELECT c_mktsegment AS dimension, n_name AS value FROM (SELECT DISTINCT c_mktsegment, n_name FROM customer, nation) EXCEPT SELECT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0""")
def uncovered_scope(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    declared = c.select(F.col("c_mktsegment").alias("dimension")).distinct().join(F.broadcast(n.select(F.col("n_name").alias("value"))))
    covered = c.where("c_custkey % 2 = 0").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("dimension"), F.col("n_name").alias("value"))
    return collect.uncovered(declared, covered)


_DEC = "(SELECT doc_id AS key, arg_max(CASE quality + 2 * toxic WHEN 0 THEN 'exclude' WHEN 1 THEN ' Included' WHEN 2 THEN '' ELSE 'maybe' END, (quality, toxic)) AS decision FROM labels GROUP BY doc_id)"


def _screened(spark, sf_dir) -> DataFrame:
    code = F.col("quality") + 2 * F.col("toxic")
    decision = F.when(code == 0, "exclude").when(code == 1, " Included").when(code == 2, "").otherwise("maybe")
    d = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.struct("quality", "toxic").alias("position"), decision.alias("decision"), F.lit("").alias("reason"))
    return collect.with_screening(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), (F.col("doc_id") % 20).alias("family_id")), d)


@query(f"""SELECT CASE WHEN trim(coalesce(decision, '')) = '' THEN 'unscreened' ELSE trim(decision) END AS decision, count(*) AS n, count(*) FILTER (lower(trim(coalesce(decision, ''))) IN ('include', 'included', 'retain', 'retained')) AS retained
FROM documents LEFT JOIN {_DEC} ON key = doc_id GROUP BY 1""")
def screening(spark, sf_dir):
    return collect.screening_summary(_screened(spark, sf_dir))


@query(f"""WITH r AS (SELECT DISTINCT vec_id % 6 AS query_pos, vec_id // 2 AS key FROM embeddings), s AS (SELECT key, key % 20 AS family FROM {_DEC} WHERE lower(trim(decision)) = 'included'), k AS (SELECT query_pos, r.key, family FROM r JOIN s USING (key)),
m AS (SELECT *, min(query_pos) OVER (PARTITION BY key) AS a, min(query_pos) OVER (PARTITION BY family) AS b FROM k)
SELECT q.query_pos, count(DISTINCT key) FILTER (a = m.query_pos) AS new_retained, count(DISTINCT family) FILTER (b = m.query_pos) AS new_retained_families FROM (SELECT DISTINCT query_pos FROM r) q LEFT JOIN m ON m.query_pos = q.query_pos GROUP BY 1""")
def retained_yields(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 6).alias("query_pos"), F.floor(F.col("vec_id") / 2).cast("long").alias("key"))
    return collect.retained_yield(e, _screened(spark, sf_dir))


@query(f"""WITH r AS (SELECT key, key % 20 AS f, decision FROM {_DEC}) SELECT key AS publication_key, CASE WHEN key % 2 = 0 THEN 'circuit,technology' ELSE 'circuit' END AS missing FROM r WHERE lower(trim(decision)) = 'included'""")
def missing_axes(spark, sf_dir):
    axes = F.create_map(F.lit("technology"), F.when(F.col("key") % 2 == 0, "unknown").otherwise("evidenced"), F.lit("circuit"), F.lit("contradicted"), F.lit("frequency"), F.lit("evidenced"))
    a = _screened(spark, sf_dir).select(F.col("key").alias("publication_key"), F.lit("").alias("title"), "decision", axes.alias("axes"))
    return collect.without_axes(a).select("publication_key", F.array_join("missing_axes", ",").alias("missing"))


@query("""WITH r AS (SELECT vec_id // 3 AS key, vec_id AS position, CASE WHEN vec_id % 2 = 0 THEN '' ELSE 'd' || vec_id END AS doi, repeat('x', (vec_id * 7 % 11)::INT) AS abstract, (vec_id % 10) / 10.0::DOUBLE AS s FROM embeddings)
SELECT key, arg_min(doi, position) FILTER (doi <> '') AS doi, arg_max(abstract, (length(abstract), -position)) AS abstract, max(s) AS similarity, min(position) AS position,
  CASE min(position) % 2 WHEN 0 THEN 'title,abstract' ELSE 'abstract,title' END AS fields FROM r GROUP BY key HAVING count(*) > 1""")
def fused_metadata(spark, sf_dir):
    v = F.col("vec_id")
    fields = F.when(v % 2 == 0, F.array(F.lit("title"), F.lit("abstract"))).otherwise(F.array(F.lit("abstract"), F.lit("title")))
    r = table(spark, sf_dir, "embeddings").select(F.floor(v / 3).cast("long").alias("key"), v.alias("position"), F.when(v % 2 == 0, "").otherwise(F.concat(F.lit("d"), v.cast("string"))).alias("doi"), F.expr("repeat('x', cast(vec_id * 7 % 11 as int))").alias("abstract"), ((v % 10) / F.lit(10.0)).alias("similarity"), fields.alias("matched_fields"))
    several = r.groupBy("key").count().where("count > 1").select("key")
    return collect.fuse_metadata(r.join(several, "key", "left_semi"), fill=("doi",)).select("key", "doi", "abstract", "similarity", "position", F.array_join("matched_fields", ",").alias("fields"))


_MQ = """WITH v AS (SELECT vec_id AS position, embedding AS e FROM embeddings JOIN documents ON doc_id = vec_id), q AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS query_pos, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_pos, position, list_cosine_similarity(e::DOUBLE[], q::DOUBLE[]) AS s FROM v, q), r AS (SELECT query_pos, position, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_pos ORDER BY s DESC, position)::INT AS rank FROM s)"""


@query(f"""{_MQ}, n AS (SELECT position, year, title, {N('title')} AS t FROM {P}), k AS (SELECT (SELECT count(*)::INT FROM q) AS query_pos, position, NULL::DOUBLE AS similarity, row_number() OVER (ORDER BY year DESC, lower(title) DESC, position)::INT AS rank FROM n WHERE regexp_matches(t, '\\bthe\\b'))
SELECT query_pos, rank, position, similarity, CASE WHEN query_pos = (SELECT count(*) FROM q) THEN 'kw' ELSE 's' || query_pos END AS query_id FROM (SELECT query_pos, rank, position, similarity FROM r WHERE rank <= 12 UNION ALL SELECT query_pos, rank, position, similarity FROM k WHERE rank <= 20)""")
def collected_run(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("position"), "embedding")
    asked = {str(r["vec_id"]): list(r["embedding"]) for r in table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select("vec_id", "embedding").collect()}
    queries = [*(Query(f"s{at}", "lite", v, limit=12) for at, v in enumerate(sorted(asked, key=int))), Query("kw", "keyword", limit=20, keyword=KeywordQuery.build(expression="the", fields="title"))]
    p = papers(spark, sf_dir)
    own = v.join(p.select("position"), "position", "left_semi")
    run = collect.run_queries(p, own, queries, lambda texts: [asked[t] for t in texts])
    return run.results.select("query_pos", "rank", "position", F.round("similarity", 6).alias("similarity"), "query_id")


@query("""WITH v AS (SELECT vec_id AS position, embedding AS e FROM embeddings JOIN documents ON doc_id = vec_id), q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 4), s AS (SELECT position, list_cosine_similarity(e::DOUBLE[], q::DOUBLE[]) AS s FROM v, q ORDER BY s DESC, position LIMIT 20),
k AS (SELECT *, row_number() OVER (ORDER BY s DESC, position) AS rank FROM s) SELECT position, round(s, 6) AS similarity, CASE WHEN rank <= 10 THEN CASE WHEN position % 3 = 0 THEN (position % 97)::DOUBLE ELSE round(100 * s) END END AS llm_score FROM k
ORDER BY rank <= 10 DESC, llm_score DESC NULLS LAST, s DESC, position LIMIT 20""")
def pro_search_order(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("position"), "embedding")
    p = papers(spark, sf_dir).select("position", "title")
    q = table(spark, sf_dir, "embeddings").where("vec_id = 4").first()["embedding"]

    def score(model, hits):
        if model == "broken":
            raise RuntimeError("no answer")
        return hits.where("position % 3 = 0").select("position", (F.col("position") % 97).alias("llm_score"), F.lit("why").alias("llm_reason"))

    found, _ = collect.pro_search(p, v.join(p.select("position"), "position", "left_semi"), "q", lambda t: [list(q)], ["broken", "good"], score, limit=20, window=10)
    return found.select("position", F.round("similarity", 6).alias("similarity"), "llm_score")


# --- merging, relations, conflicts -----------------------------------------------------

_SRC = "(SELECT doc_id, doc_id % 3 = 0 AS hit, doc_id % 2 = 0 AS own FROM documents)"


def _library(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A corpus of the even documents, and source rows for every third one."""
    d, none = table(spark, sf_dir, "documents"), F.array().cast("array<string>")
    one = lambda **c: [F.col("doc_id").alias("position"), F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("doi"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"), F.lit("2020").alias("year"), *(v.alias(k) for k, v in c.items())]
    corpus = d.where("doc_id % 2 = 0").select(*one(abstract=F.col("lang"), venue=F.lit("old"), volume=F.lit("1"), publisher=F.lit(""), authors=F.array(F.lit("A. B")), keywords=F.array(F.lit("x"), F.lit("Y"))))
    source = d.where("doc_id % 3 = 0").select(*one(abstract=F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("source")), venue=F.lit("new"), volume=F.lit(""), publisher=F.lit("P"), authors=F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("Alice Brown"))).otherwise(none), keywords=F.array(F.lit("y"), F.lit("z"))))
    return corpus, source


@query(f"""SELECT 't' || s.doc_id AS title, CASE WHEN own AND s.doc_id % 9 = 0 THEN lang WHEN s.doc_id % 9 = 0 THEN '' ELSE source END AS abstract, 'new' AS venue, CASE WHEN own THEN '1' ELSE '' END AS volume, 'P' AS publisher,
  CASE WHEN s.doc_id % 5 = 0 THEN 'Alice Brown' WHEN own THEN 'A. B' ELSE '' END AS authors, CASE WHEN own THEN 'x|Y|z' ELSE 'y|z' END AS keywords FROM {_SRC} s JOIN documents d ON d.doc_id = s.doc_id WHERE hit""")
def library_sync(spark, sf_dir):
    m = ingest.sync(*_library(spark, sf_dir))
    return m.select("title", "abstract", "venue", "volume", "publisher", F.array_join("authors", "|").alias("authors"), F.array_join("keywords", "|").alias("keywords"))


@query(f"SELECT 't' || s.doc_id AS title, CASE WHEN hit THEN 'new' ELSE 'old' END AS venue, CASE WHEN hit THEN 'P' ELSE '' END AS publisher FROM {_SRC} s WHERE hit OR own")
def library_import(spark, sf_dir):
    return ingest.sync(*_library(spark, sf_dir), complete=False).select("title", "venue", "publisher")


# tested against a fold of one row at a time
@query()
def resolved_records(spark, sf_dir):
    return ingest.resolve_keys(records(spark, sf_dir)).select("position", "canonical")


# source rows without an abstract don't count
@query(f"""SELECT 't' || s.doc_id AS title, 'old' AS venue, CASE WHEN hit AND s.doc_id % 9 <> 0 THEN 'P' ELSE '' END AS publisher FROM {_SRC} s WHERE own""")
def library_enrich(spark, sf_dir):
    corpus, source = _library(spark, sf_dir)
    return ingest.enrich(corpus, source.withColumn("abstract", F.repeat("abstract", 20))).corpus.select("title", "venue", "publisher")


_REL = f"""(SELECT x.position, {T('x.title')} AS a, {T('y.title')} AS b, {N('x.title')} AS ta, {N('y.title')} AS tb, abs(x.year - y.year) AS gap, x.venue = y.venue AS v, x.keywords = y.keywords AS k FROM {P} x JOIN {P} y ON y.position = x.position + 5)"""


@query(f"""WITH r AS (SELECT *, v::INT + k::INT AS shared, len(list_intersect(a, b)) AS c, len(list_distinct(a || b)) AS u, least(len(a), len(b)) AS m FROM {_REL}), s AS (SELECT *, CASE WHEN u = 0 THEN 0.0 ELSE c / u::DOUBLE END AS j, CASE WHEN m = 0 THEN 0.0 ELSE c / m::DOUBLE END AS n FROM r)
SELECT position, CASE WHEN ta <> '' AND ta = tb THEN 'publication_variant' WHEN shared > 0 AND n >= 0.85 AND j >= 0.62 AND gap <= 5 THEN 'likely_extension' WHEN shared > 0 AND n >= 0.65 AND j >= 0.42 AND gap <= 7 THEN 'related_followup'
  WHEN shared >= 2 AND c >= 2 AND j >= 0.22 AND gap <= 7 THEN 'related_followup' ELSE 'unrelated' END AS relation, shared FROM s""")
def work_relations(spark, sf_dir):
    prepared = _prepared(records(spark, sf_dir).withColumn("doi", F.lit("")))
    a, b = prepared.select("position", F.col("p").alias("a")), prepared.select((F.col("position") - 5).alias("position"), F.col("p").alias("b"))
    return a.join(b, "position").select("position", family.relation()["relation"].alias("relation"), F.size(F.array_intersect("a.full", "b.full")).alias("shared"))


def _prepared(rows: DataFrame) -> DataFrame:
    """Prepared records beside their position."""
    from lectern.functions.text import author_keys, doi_selector, normalize, tokens, year_of

    none = F.array().cast("array<string>")
    p = F.struct(keys.publication_key().alias("key"), normalize("title").alias("t"), tokens("title").alias("w"), author_keys(F.coalesce("authors", none)).alias("full"), author_keys(F.coalesce("authors", none), loose=True).alias("loose"), doi_selector("doi").alias("d"), year_of("year").alias("y"))
    return rows.select("position", p.alias("p"))


@query("""WITH a AS (SELECT o_custkey AS c, o_orderkey AS k FROM orders), b AS (SELECT c FROM a GROUP BY c HAVING count(*) BETWEEN 2 AND 12) SELECT 'k' || x.k AS a_key, 'k' || y.k AS b_key FROM a x JOIN a y ON x.c = y.c JOIN b ON b.c = x.c WHERE 'k' || x.k < 'k' || y.k""")
def author_buckets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("key"), F.array(F.concat(F.lit("name"), F.col("o_custkey").cast("string")), F.lit("x")).alias("loose"))
    return family.candidate_pairs(o, 12)


@query(f"""WITH v AS (SELECT DISTINCT lower(doi) AS d, lower({squeeze_sql('abstract')}) AS a FROM {R} WHERE doi <> '' AND position < 4000 AND {squeeze_sql('abstract')} <> ''), t AS (SELECT *, list_filter(list_distinct(string_split({N('a')}, ' ')), lambda x: length(x) > 1) AS w FROM v),
p AS (SELECT x.d, CASE WHEN length(x.a) <= length(y.a) THEN x.a ELSE y.a END AS s, CASE WHEN length(x.a) <= length(y.a) THEN y.a ELSE x.a END AS l, x.w AS xw, y.w AS yw FROM t x JOIN t y ON x.d = y.d AND x.a < y.a)
SELECT DISTINCT 'doi_abstract::' || d AS id, 'same_doi_different_abstract' AS kind FROM p WHERE NOT (length(s) >= 120 AND contains(l, s)) AND len(list_intersect(xw, yw)) / greatest(len(list_distinct(xw || yw)), 1)::DOUBLE < 0.55""".replace(" AND position < 4000", ""))
def abstract_conflict_groups(spark, sf_dir):
    return conflicts.abstract_conflicts(records(spark, sf_dir))


@query()
def title_conflict_groups(spark, sf_dir):
    return conflicts.title_conflicts(records(spark, sf_dir))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name || ': ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS title FROM part""")
def comparable_titles(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", conflicts.comparable_title(F.concat("p_name", F.lit(": "), "p_type")).alias("title"))


@query(f"""WITH k AS (SELECT trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS k, year FROM {P}), g AS (SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT year) > 1) SELECT 'title_year::' || k AS id FROM g WHERE length(k) % 2 = 0""")
def open_conflict_ids(spark, sf_dir):
    found = conflicts.year_conflicts(papers(spark, sf_dir))
    dismissed = found.where(F.length("id") % 2 == 1).select("id").unionByName(spark.createDataFrame([("stale",)], "id string"))
    return conflicts.open_conflicts(found, dismissed).select("id")


# --- control: changes, runs, registry ----------------------------------------------------


@query("""SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 2 = 1 THEN 'added' WHEN doc_id % 5 = 0 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE (doc_id % 2 = 1 AND doc_id % 5 <> 0) OR (doc_id % 2 = 0 AND (doc_id % 5 = 0 OR doc_id % 7 = 0))""")
def changed_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), "doc_id")
    before = d.where("doc_id % 2 = 0").select("path", F.lit("a").alias("sha"))
    return control.changed_files(before, d.where("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 7 == 0, "b").otherwise("a").alias("sha")))


@query("""SELECT 'f' || doc_id AS path FROM documents WHERE doc_id % 2 = 0 AND doc_id % 5 <> 0 AND doc_id % 3 <> 0""")
def lost_source_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), "doc_id")
    before, present, valid = d.where("doc_id % 2 = 0"), d.where("doc_id % 5 <> 0"), d.where("doc_id % 3 = 0 and doc_id % 5 <> 0")
    return snapshot.lost_sources(before, present, valid)


@query("""SELECT user_id AS run_id, CASE WHEN count(*) FILTER (event_type <> 'click' OR value > 50) = count(*) THEN 'completed' WHEN count(*) FILTER (event_type <> 'click' OR value > 50) > 0 THEN 'partial' ELSE 'queued' END AS status, count(*) FILTER (event_type <> 'click' OR value > 50) AS fetched, count(*) AS items FROM events GROUP BY user_id""")
def resumed_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("item_id"), F.lit("fetched").alias("status"), ((F.col("event_type") != "click") | (F.col("value") > 50)).alias("has"))
    items = control.resumed_items(e.drop("has"), e.where("has").select("item_id"))
    return control.run_status(items)


@query("""SELECT arg_max(user_id, (ts, user_id)) AS run_id FROM events WHERE event_type = 'click'""")
def run_to_resume(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("ts").alias("started"), F.lit("s").alias("signature"), F.when(F.col("event_type") == "click", "partial").otherwise("completed").alias("status"))
    return control.resume(e, "s").select("run_id")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey = 7 THEN 'X' ELSE p_brand END AS provider FROM part WHERE (CASE WHEN p_partkey = 7 THEN 'X' ELSE p_brand END) IN ('X', 'Brand#11', 'Brand#12', 'Brand#13', 'Brand#23') AND p_size % 4 >= 3 OR p_partkey = 7 AND p_size % 4 >= 3""")
def registry_backfill(spark, sf_dir):
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("provider"), (F.col("p_size") % 4).alias("generation"), F.lit(True).alias("enabled"))
    r = control.replace_source(r, 7, provider="X", nothing=1)
    return control.backfill_sources(r, ["X", "Brand#11", "Brand#12", "Brand#13", "Brand#23"]).select("id", "provider")


@query("""SELECT (SELECT count(*) FROM documents) AS papers, (SELECT count(*) FROM part WHERE p_size > 10) AS valid_sources, (SELECT count(*) FROM part WHERE p_size <= 10) AS invalid_sources, (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem)) AS stores""")
def library_status(spark, sf_dir):
    m = table(spark, sf_dir, "part").select((F.col("p_size") > 10).alias("valid"))
    return control.content_status(table(spark, sf_dir, "documents"), m, table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("scope")))


@query("""SELECT page_id, NOT (page_id % 3 = 0 OR page_id % 5 = 0) AS safe FROM pages""")
def archive_members(spark, sf_dir):
    name = F.when(F.col("page_id") % 3 == 0, "../x").when(F.col("page_id") % 5 == 0, "C:\\x").otherwise(F.concat(F.lit("a..b/"), F.col("page_id").cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", control.safe_member(name).alias("safe"))


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 1.5 ELSE 0.5 END::DOUBLE AS v FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0""")
def recovered_items(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(0.5).alias("v"))
    return streaming.recover(e.where("vec_id % 2 = 0"), e.where("vec_id % 3 = 0").withColumn("v", F.lit(1.5)), "vec_id")


@query("SELECT vec_id, 'f' || vec_id AS fingerprint FROM embeddings")
def appended_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("f"), F.col("vec_id").cast("string")).alias("fingerprint"))
    return snapshot.append_vectors(e.where("vec_id % 4 > 0"), e.where("vec_id % 4 = 0"), e.where("vec_id % 4 > 0"))


# --- sources, sinks, searches ------------------------------------------------------------


@query("""SELECT n_name || ', "the" ' || n_regionkey AS title, 'A ' || n_nationkey || chr(10) || 'line' AS abstract, n_nationkey::VARCHAR AS year FROM nation""")
def csv_round_trip(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rows = n.select(F.concat("n_name", F.lit(', "the" '), F.col("n_regionkey").cast("string")).alias("Document Title"), F.concat(F.lit("A "), F.col("n_nationkey").cast("string"), F.lit("\nline")).alias("Abstract"), F.col("n_nationkey").cast("string").alias("Publication Year"))
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(rows, path)
    back = readers.read_csv(spark, path)
    return back.select(F.col("Document Title").alias("title"), F.col("Abstract").alias("abstract"), F.col("Publication Year").alias("year"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'ieee_xplore' WHEN 2 THEN 'web_grabber' WHEN 3 THEN 'generic_paper_source' ELSE 'unsupported' END AS kind FROM part""")
def header_kinds(spark, sf_dir):
    line = F.element_at(F.lit(['Abstract,"Title, of document"', 'Document Title,"Abstract",IEEE Terms', "Document Title, Abstract ,Source URL,Publication Year", '"Document Title",Abstract,"DOI"', "Document Title,Abstract"]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", readers.classify_headers(readers.header_names(line)).alias("kind"))


@query("""SELECT p_partkey AS id, p_name AS title, p_type AS venue, (1990 + p_size)::VARCHAR AS year, 'G ' || p_brand AS authors, 'https://doi.org/10.1/' || p_partkey AS url FROM part""")
def api_items(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    item = F.to_json(F.struct(
        F.array("p_name").alias("title"), F.array(F.concat(F.lit("<i>"), "p_type", F.lit("</i>"))).alias("container-title"), F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string")).alias("DOI"),
        F.array(F.struct(F.lit("G").alias("given"), F.col("p_brand").alias("family"))).alias("author"), F.struct(F.array(F.array(1990 + F.col("p_size"))).alias("date-parts")).alias("issued"),
    ))
    return readers.parse_items(p.select(item.alias("item"))).select(F.regexp_extract("doi", "[0-9]+$", 0).cast("long").alias("id"), "title", "venue", "year", F.array_join("authors", ";").alias("authors"), "url")


@query("""SELECT p_size AS url_id, max(p_partkey) AS position FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_size""")
def crawl_cache(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("u"), F.col("p_size").cast("string")).alias("url"), F.col("p_partkey").alias("position"), "p_size", F.when(F.col("p_partkey") % 3 == 0, " ").otherwise("t").alias("title"), F.lit("a").alias("abstract"))
    return readers.cached_articles(p).select(F.col("p_size").alias("url_id"), "position")


@query(f"""SELECT position, 'title' AS fields FROM {R} WHERE ({N('title')} <> '' AND {N('title')} IN (SELECT {N('title')} FROM {P} WHERE position IN (3, 17))) AND doi <> 'https://doi.org/10.1000/X4'
UNION ALL SELECT position, CASE WHEN {N('title')} <> '' AND {N('title')} IN (SELECT {N('title')} FROM {P} WHERE position IN (3, 17)) THEN 'title,doi' ELSE 'doi' END FROM {R} WHERE doi = 'https://doi.org/10.1000/X4'""")
def identity_search(spark, sf_dir):
    r = records(spark, sf_dir)
    titles = [row["title"] for row in r.where("position in (3, 17)").select("title").collect()]
    q = KeywordQuery.build(titles=titles, dois=["doi: 10.1000/x4"])
    return keyword.match(r, q).select("position", F.array_join("matched_fields", ",").alias("fields"))


@query(f"""WITH n AS (SELECT position, {N('title')} AS t, venue, keywords FROM {P}) SELECT position, CASE WHEN regexp_matches(t, '\\bthe\\b') THEN 'title,authors' ELSE 'authors' END AS fields FROM n WHERE venue = 'src2'""")
def author_search(spark, sf_dir):
    r = records(spark, sf_dir)
    q = KeywordQuery.build(authors=["Src2 SMITH"], any_terms=["the", "src 2"], fields="title,authors")
    m = keyword.match(r, q)
    return m.select("position", F.when(F.array_contains("matched_fields", "title"), "title,authors").otherwise("authors").alias("fields"))


@query(f"SELECT position, similarity, CASE WHEN similarity >= 0.25 AND similarity < 0.4 THEN true ELSE false END AS valuable, similarity >= 0.6 AS rare FROM {_HIT}")
def selected_hits(spark, sf_dir):
    h = cards.batch_select(_hits(spark, sf_dir), "valuable", True).withColumnRenamed("selected", "valuable")
    return cards.batch_select(h, "rare", True).withColumnRenamed("selected", "rare").select("position", "similarity", "valuable", "rare")


@query(f"""WITH n AS (SELECT position, lower(title) AS t, venue FROM {P}) SELECT position, (position % 4 = 0 OR contains(t, 'the') OR (contains(t, 'und') AND venue <> 'src1')) AS rescued FROM n""")
def rescued_rows(spark, sf_dir):
    p = papers(spark, sf_dir)
    venue = F.when(F.col("venue") == "src1", "Science Advances").otherwise(F.col("venue"))
    return p.select("position", collect.should_rescue(F.col("title"), F.col("position") % 4 == 0, venue, ["the"], ["und"]).alias("rescued"))


@query(f"SELECT position, CASE WHEN regexp_matches({N('title')}, '\\bof\\b') THEN 'title' END AS fields FROM {_HIT}")
def hit_details(spark, sf_dir):
    some = _hits(spark, sf_dir).withColumn("doi", F.concat(F.lit("10.1000/X"), F.col("position").cast("string")))
    found = keyword.match(some.drop("similarity"), KeywordQuery.build(expression="of", fields="title"))
    return cards.attach_details(some, found).select("position", F.nullif(F.array_join("matched_fields", ","), F.lit("")).alias("fields"))
