"""Identity resolution and merging of source rows into a corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.keys import identity_levels
from lectern.functions.scoring import completeness
from lectern.functions.text import author_richness, loose_title, squeeze
from lectern.operators.durable import materialize
from lectern.operators.filters import is_junk
from lectern.operators.graph import components

# Fields of a record.
CORE = ["title", "abstract", "year", "venue", "doi", "pdf_link"]
BIBLIOGRAPHIC = [
    "volume", "number", "issue", "start_page", "end_page", "pages", "issn", "isbn", "publisher", "document_identifier", "date_added_to_xplore", "online_date",
    "issue_date", "meeting_date", "funding_information", "article_citation_count", "patent_citation_count", "reference_count", "license", "article_number",
]
LISTS = ["keywords", "ieee_terms"]


#: Positions of a range in which the latest values of a record are looked up at once.
RANGE = 1_000_000


def _completed(rows: DataFrame) -> DataFrame:
    """``(position, record, key)``: the keys that a merged record holds after a row of ``rows(position, title, year, record)`` beside the row's own.

    A row with a title but no year (or the reverse) is completed from the latest
    row of its record that has one, by ranges of positions, so no record's rows meet in one task.
    """
    half = (F.col("title") == "") != (F.col("year") == "")
    held = rows.select("position", "record", *(F.nullif(c, F.lit("")).alias(c) for c in ("title", "year")), half.alias("half"), F.floor(F.col("position") / RANGE).alias("part"))
    held = held.join(held.where("half").select("record").distinct(), "record", "left_semi")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("position"))).alias(c)
    ends = held.groupBy("record", "part").agg(latest("title"), latest("year"))
    past = Window.partitionBy("record").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("record", "part", *(F.last(c, ignorenulls=True).over(past).alias(f"_{c}") for c in ("title", "year")))
    within = Window.partitionBy("record", "part").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    full = held.select("position", "record", "part", "half", *(F.last(c, ignorenulls=True).over(within).alias(c) for c in ("title", "year"))).where("half").join(ends, ["record", "part"])
    title, year = F.coalesce("title", "_title"), F.coalesce("year", "_year")
    return full.where(title.isNotNull() & year.isNotNull()).select("position", "record", F.concat_ws("::", F.lit("title_year"), title, year).alias("key"))


#: Levels of rows that are records by themselves, and of rows none of whose keys is held.
OWN, NONE = -1, 9


def _in_rounds(named: DataFrame, max_rounds: int) -> DataFrame:
    """``(position, canonical)`` by rounds of aggregations and joins, each of which decides all rows by what the last round decided.

    A key is held by the record of its first row. While it is held, a row that has it joins that record, unless a stronger key
    names another one: so only rows that a stronger key decides (or that are records by themselves, or complete a record's title
    and year) end a hold, and a row that finds none of its keys held ends none. What a row decides depends on earlier rows
    only, so what no round changes any more is what one row at a time gives; the number of rounds is that of
    holds that end one another, not of the rows of a key.
    """
    halves = not named.where("(title = '') <> (year = '')").isEmpty()
    keyed = named.select("position", F.posexplode("keys").alias("level", "key"))
    table = keyed.groupBy("key").agg(F.min(F.col("position") * 4 + F.col("level")).alias("kid"), F.count("*").alias("n"))
    # keys of one row decide nothing, but for those that a completed record may claim
    table = table.where((F.col("n") > 1) | (F.lit(halves) & F.col("key").startswith("title_year::"))).select("key", "kid")
    table = materialize(table, "keys")
    wanted = materialize(keyed.join(table, "key").select("position", "level", "kid"), "wanted")
    names = named.groupBy("name").agg(F.min("position").alias("record"))
    now = named.join(names, "name").select("position", "own", F.col("record").alias("name"), "record", F.when(F.col("own"), OWN).otherwise(NONE).alias("chosen"), F.lit(True).alias("changed"))
    now = materialize(now, "records")
    for _ in range(max_rounds):
        claims = wanted.join(now, "position").select("kid", "position", "record", (F.col("chosen") < F.col("level")).alias("ends"))
        if halves:
            completed = _completed(named.select("position", "title", "year").join(now.select("position", "record"), "position"))
            claims = claims.unionByName(completed.join(table, "key").select("kid", "position", "record", F.lit(True).alias("ends")))
        held = claims.groupBy("kid").agg(F.min("position").alias("since"), F.min_by("record", "position").alias("holder"))
        ended = claims.where("ends").join(held, "kid").where("record <> holder").groupBy("kid").agg(F.min("position").alias("until"))
        live = wanted.join(held.join(ended, "kid", "left"), "kid").where("since < position and (until is null or until >= position)")
        found = live.groupBy("position").agg(F.min("level").alias("_level"), F.min_by("holder", "level").alias("_record"))
        after = now.drop("changed").join(found, "position", "left")
        record = F.when(F.col("own"), F.col("record")).otherwise(F.coalesce("_record", "name"))
        chosen = F.when(F.col("own"), OWN).otherwise(F.coalesce("_level", F.lit(NONE)))
        changed = (record != F.col("record")) | (chosen != F.col("chosen"))
        now = materialize(after.select("position", "own", "name", record.alias("record"), chosen.alias("chosen"), changed.alias("changed")), "records")
        if now.where("changed").isEmpty():
            starts = now.groupBy("record").agg(F.min("position").alias("canonical"))
            return now.join(starts, "record").select("position", "canonical")
    raise RuntimeError(f"keys did not settle in {max_rounds} rounds")


def _in_order(named: DataFrame) -> DataFrame:
    """``(position, canonical)`` row by row; only the rows of one ``root`` are held together, as their keys."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        root, holder, records = None, {}, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["root"] != root:
                    root, holder, records = row["root"], {}, {}
                keys = row["keys"]
                name = keys[0] if row["own"] else next((holder[k] for k in keys if holder.get(k)), keys[0])
                start, title, year = records.get(name, (row["position"], "", ""))
                title, year = row["title"] or title, row["year"] or year
                records[name] = start, title, year
                for k in keys + [f"title_year::{title}::{year}"] * bool(title and year):
                    if holder.setdefault(k, name) != name:
                        holder[k] = None
                out.append((row["position"], start))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["position", "canonical"])

    held = named.select("root", "position", "title", "year", "keys", "own").repartition("root").sortWithinPartitions("root", "position")
    return held.mapInArrow(run, "position long, canonical long")


def resolve_keys(rows: DataFrame, own: Column | None = None, small: int = 10_000, max_rounds: int = 1000) -> DataFrame:
    """``rows`` with ``canonical``, the first position of the record that each row belongs to, rows taken in order of ``position``.

    A row belongs to the record that holds the first of its keys that is held; if none is, to the record named by its
    strongest key. A record holds the keys of its rows. A key that a second record claims is held by none from then on.
    Rows for which ``own`` holds are records by themselves, of which later ones with the same strongest key
    are left out, as are rows without any key.

    Rows that share no key, directly or through others, don't decide one another: groups of up to ``small`` rows are
    taken in order within a task, larger ones in rounds over all tasks, with the same result.
    """
    levels = identity_levels()
    named = rows.select("position", loose_title("title").alias("title"), squeeze("year").alias("year"), levels.alias("keys"), F.get(levels, F.lit(0)).alias("name"), (F.lit(False) if own is None else own).alias("own"))
    named = materialize(named.where("name is not null"), "keys")
    first = named.where("own").groupBy("name").agg(F.min("position").alias("position"))
    named = named.where("not own").unionByName(named.where("own").join(first, ["position", "name"], "left_semi"))
    each = named.select("position", F.explode("keys").alias("key"))
    lead = each.groupBy("key").agg(F.min("position").alias("a"))
    roots = components(each.join(lead, "key").where("a <> position").select("a", F.col("position").alias("b")))
    named = named.join(roots.withColumnRenamed("node", "position"), "position", "left")
    sizes = roots.groupBy("root").agg((F.count("*") > small).alias("large"))
    named = materialize(named.join(sizes, "root", "left"), "keys")
    found = named.where("root is null").select("position", F.col("position").alias("canonical")).unionByName(_in_order(named.where("not large")))
    large = named.where("large")
    if not large.isEmpty():
        found = found.unionByName(_in_rounds(large, max_rounds))
    return rows.join(found, "position")


def merge_sources(rows: DataFrame, allow_core: bool = True) -> DataFrame:
    """One record of each ``canonical``: a fold over its rows in order of ``position``.

    Core fields take the last filled value (or, without ``allow_core``, the first); authors
    the richest list; lists their union; bibliographic fields the incoming value if the
    current is empty or the incoming row ranks at least as high as what is merged so far.
    The state is one record, so groups of any size stream through in order; records of one row pass as they are.
    """
    from pyspark.sql.types import ArrayType, StringType

    names = [c for c in rows.columns if c not in ("position", "canonical")]
    ordered = rows.withColumn("_rank", completeness(lambda n: F.col(n) if n in names else F.lit(""))).withColumn("_rich", author_richness(F.coalesce("authors", F.array().cast("array<string>"))))
    ordered = ordered.repartition("canonical").sortWithinPartitions("canonical", "position")
    lists = {f.name for f in rows.schema.fields if isinstance(f.dataType, ArrayType)}
    schema = rows.select("canonical", "position", *names).schema

    def fold(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        state, rank, rich, out = None, 0, 0, []
        arrow = pa.schema([(f.name, pa.int64() if f.name in ("canonical", "position") else pa.list_(pa.string()) if f.name in lists else pa.string()) for f in schema.fields])
        assert all(isinstance(f.dataType, StringType | ArrayType) or f.name in ("canonical", "position") for f in schema.fields)
        for batch in batches:
            ids = batch.column("canonical").to_numpy()
            # rows at the ends of a batch may go on in another one
            alone = np.zeros(len(ids), bool)
            alone[1:-1] = (ids[1:-1] != ids[:-2]) & (ids[1:-1] != ids[2:])
            single = batch.filter(pa.array(alone))
            yield pa.RecordBatch.from_arrays([single.column(f.name).cast(f.type) for f in arrow], schema=arrow)
            for row in batch.filter(pa.array(~alone)).to_pylist():
                if state is None or row["canonical"] != state["canonical"]:
                    if state is not None:
                        out.append(state)
                    state, rank, rich = {n: row[n] for n in ("canonical", "position", *names)}, row["_rank"], row["_rich"]
                    continue
                for n in names:
                    new, old = row[n], state[n]
                    if n in LISTS:
                        seen = {x.lower() for x in old or []}
                        state[n] = (old or []) + [x for x in new or [] if x.lower() not in seen and not seen.add(x.lower())]
                    elif n == "authors":
                        if new and (not old or row["_rich"] > rich):
                            state[n], rich = new, row["_rich"]
                    elif not (new or "").strip():
                        continue
                    elif n in BIBLIOGRAPHIC:
                        if not (old or "").strip() or row["_rank"] >= rank:
                            state[n] = new
                    elif allow_core and n in CORE or not (old or "").strip():
                        state[n] = new
                rank = max(rank, row["_rank"])
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if state is not None:
            out.append(state)
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return ordered.select("canonical", "position", *names, "_rank", "_rich").mapInArrow(fold, schema)


def sync(corpus: DataFrame, sources: DataFrame, complete: bool = True) -> DataFrame:
    """The corpus after all source rows, in (file, row) order, have been merged into it.

    Records that no source row names are removed, unless a source was lost or unreadable
    (``complete`` false). Both tables carry ``position``; the corpus comes first.
    """
    last = corpus.agg(F.coalesce(F.max("position"), F.lit(-1)).alias("m")).first()["m"]
    both = corpus.withColumn("_own", F.lit(True)).unionByName(sources.withColumn("position", F.col("position") + last + 1).withColumn("_own", F.lit(False)))
    resolved = materialize(resolve_keys(both, F.col("_own")), "sync")
    named = resolved.groupBy("canonical").agg(F.min("_own").alias("only"))
    merged = merge_sources(resolved.drop("_own"))
    if complete:
        merged = merged.join(named.where("not only").select("canonical"), "canonical", "left_semi")
    return merged.select(*corpus.columns)


def enrich_targets(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """``(position, target, status)``: the one corpus record that a row's clear keys name."""
    own = corpus.select(F.col("position").alias("target"), F.explode(identity_levels()).alias("key"))
    clear = own.groupBy("key").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target"))
    each = rows.select("position", F.explode(identity_levels()).alias("key")).join(clear, "key", "left")
    found = each.groupBy("position").agg(F.collect_set(F.when(F.col("n") == 1, F.col("target"))).alias("t"), F.count_if(F.col("n") > 1).alias("unclear"))
    status = F.when(F.size("t") == 1, "matched").when((F.size("t") > 1) | (F.col("unclear") > 0), "ambiguous").otherwise("missing")
    return found.select("position", F.when(F.size("t") == 1, F.get("t", F.lit(0))).alias("target"), status.alias("status"))


@dataclass
class Enriched:
    """The corpus with filled fields, ``(position, target, status)`` of each source row, and the positions that changed."""

    corpus: DataFrame
    rows: DataFrame
    changed: DataFrame


def enrich(corpus: DataFrame, sources: DataFrame) -> Enriched:
    """Fill fields of the corpus from source rows in order: each row that names one record by its clear keys, and has a title and an abstract.

    Title, abstract, year, venue and DOI stay as they are. Both tables have the same columns, with ``position``.
    """
    usable = sources.where((squeeze("title") != "") & (squeeze("abstract") != "") & ~is_junk("title", "abstract"))
    rows = materialize(enrich_targets(usable, corpus), "enrich")
    last = corpus.agg(F.coalesce(F.max("position"), F.lit(-1)).alias("m")).first()["m"]
    named = usable.join(rows.where("status = 'matched'").select("position", F.col("target").alias("canonical")), "position")
    own = corpus.join(named.select(F.col("canonical").alias("position")).distinct(), "position", "left_semi").withColumn("canonical", F.col("position"))
    merged = merge_sources(own.unionByName(named.withColumn("position", F.col("position") + last + 1)), allow_core=False)
    merged = materialize(merged.withColumn("position", F.col("canonical")).select(*corpus.columns), "enrich")
    # a record has one position
    whole = corpus.join(merged.select("position"), "position", "left_anti").unionByName(merged)
    values = F.struct(*(c for c in corpus.columns if c != "position"))
    changed = corpus.select("position", values.alias("a")).join(merged.select("position", values.alias("b")), "position").where(~F.col("a").eqNullSafe(F.col("b"))).select("position")
    return Enriched(whole, rows, changed)


def hydrate(wanted: DataFrame, corpus: DataFrame) -> DataFrame:
    """``wanted(id, doi_key, title_key, year)`` with key and status of the corpus record.

    With a DOI only the DOI counts; else title and year, then the title alone. A lookup
    that names several records is ambiguous.
    """
    look = lambda *by: corpus.where(f"{by[0]} <> ''").groupBy(*by).agg(F.countDistinct("key").alias("n"), F.min("key").alias("k"))
    by_doi, by_year, by_title = look("doi_key"), look("title_key", "year"), look("title_key")
    j = (
        wanted.join(by_doi.select("doi_key", F.col("n").alias("n1"), F.col("k").alias("k1")), "doi_key", "left")
        .join(by_year.select("title_key", "year", F.col("n").alias("n2"), F.col("k").alias("k2")), ["title_key", "year"], "left")
        .join(by_title.select("title_key", F.col("n").alias("n3"), F.col("k").alias("k3")), "title_key", "left")
    )
    n = F.when(F.col("doi_key") != "", F.col("n1")).otherwise(F.coalesce("n2", "n3"))
    k = F.when(F.col("doi_key") != "", F.col("k1")).otherwise(F.when(F.col("n2").isNotNull(), F.col("k2")).otherwise(F.col("k3")))
    return j.select("id", F.when(n == 1, k).alias("key"), F.when(n == 1, "found").when(n > 1, "ambiguous").otherwise("missing").alias("status"))


def consume_candidates(candidates: DataFrame, corpus: DataFrame, key: str = "match_key", position: str = "position") -> DataFrame:
    """Pairs of candidates and corpus rows of the same key, each row used once, in order."""
    number = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(position)))
    return number(candidates.select(key, position)).withColumnRenamed(position, "candidate").join(number(corpus), [key, "_n"]).drop("_n")
