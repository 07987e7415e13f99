"""Work families: related publications by titles and authors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.keys import publication_key
from lectern.functions.text import author_keys, doi_selector, normalize, tokens, year_of
from lectern.operators.durable import dealt_by, materialize
from lectern.operators.graph import components
from lectern.operators.vector import top_k_many

#: Author buckets over this size propose no pairs.
BUCKET = 80
#: Authors of more records than this propose no candidates alone.
CANDIDATES = 200
# Least Jaccard similarity of the titles of an extension, and of a follow-up.
EXTENSION, FOLLOWUP = 0.62, 0.22
LINKING = ("publication_variant", "likely_extension")


def prepare(papers: DataFrame) -> DataFrame:
    """Key, title, tokens, authors, DOI and year of each record, as relations need them."""
    return papers.select(
        publication_key().alias("key"), normalize("title").alias("t"), tokens("title").alias("w"), author_keys(F.coalesce("authors", F.array().cast("array<string>"))).alias("full"),
        author_keys(F.coalesce("authors", F.array().cast("array<string>")), loose=True).alias("loose"), doi_selector("doi").alias("d"), year_of(F.col("year").cast("string")).alias("y"),
    )


def relation(a: str = "a", b: str = "b") -> Column:
    """Struct (relation, confidence) of two prepared records."""
    left, right = (lambda n, s=s: F.col(f"{s}.{n}") for s in (a, b))  # noqa: B023
    common, union = F.size(F.array_intersect(left("w"), right("w"))), F.size(F.array_union(left("w"), right("w")))
    shared = F.size(F.array_intersect(left("full"), right("full")))
    jac = F.coalesce(F.try_divide(common, union), F.lit(0.0))
    cont = F.coalesce(F.try_divide(common, F.least(F.size(left("w")), F.size(right("w")))), F.lit(0.0))
    gap = F.when((left("y") > 0) & (right("y") > 0), F.abs(left("y") - right("y")))
    near = lambda n: gap.isNull() | (gap <= n)
    row = lambda name, c: F.struct(F.lit(name).alias("relation"), F.round(c, 4).alias("confidence"))
    return (
        F.when((left("d") != "") & (left("d") == right("d")), row("same_publication", F.lit(1.0)))
        .when((left("t") != "") & (left("t") == right("t")), row("publication_variant", F.when(shared > 0, 1.0).otherwise(0.95)))
        .when((shared > 0) & (cont >= 0.85) & (jac >= 0.62) & near(5), row("likely_extension", F.least(F.lit(0.98), 0.55 + 0.25 * cont + 0.15 * jac + 0.03 * shared)))
        .when((shared > 0) & (cont >= 0.65) & (jac >= 0.42) & near(7), row("related_followup", F.least(F.lit(0.88), 0.4 + 0.22 * cont + 0.15 * jac + 0.02 * shared)))
        .when((shared >= 2) & (common >= 2) & (jac >= 0.22) & near(7), row("related_followup", F.least(F.lit(0.84), 0.36 + 0.05 * shared + 0.12 * cont + 0.12 * jac)))
        .otherwise(row("unrelated", F.lit(0.0)))
    )


def candidate_pairs(prepared: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs of keys that share an author bucket of at most ``bucket`` records."""
    each = prepared.select("key", F.explode("loose").alias("author")).where(F.length("author") > 3).distinct()
    # the bound is part of the operator: larger buckets name no one in particular
    small = each.groupBy("author").count().where(F.col("count").between(2, bucket)).select("author")
    held = each.join(small, "author")
    return held.alias("x").join(held.alias("y"), "author").where("x.key < y.key").select(F.col("x.key").alias("a_key"), F.col("y.key").alias("b_key")).distinct()


def family_edges(prepared: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) of equal titles, as stars, and of variants and extensions."""
    titled = prepared.where("t <> ''")
    least = titled.groupBy("t").agg(F.min("key").alias("a"))
    same = titled.join(least, "t").where("a <> key").select("a", F.col("key").alias("b"))
    one = F.struct(*prepared.columns)
    rows = prepared.select("key", one.alias("r")).dropDuplicates(["key"])
    pairs = candidate_pairs(prepared, bucket).join(rows.select(F.col("key").alias("a_key"), F.col("r").alias("a")), "a_key").join(rows.select(F.col("key").alias("b_key"), F.col("r").alias("b")), "b_key")
    related = pairs.where(relation()["relation"].isin(*LINKING)).select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))
    return same.unionByName(related).distinct()


def assign_families(papers: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``papers`` with ``work_family_id`` and ``work_family_size`` (rows of the family)."""
    keyed = papers.withColumn("_key", publication_key())
    roots = components(family_edges(prepare(papers), bucket))
    named = keyed.join(roots.select(F.col("node").alias("_key"), "root"), "_key", "left").withColumn("_root", F.coalesce("root", "_key")).drop("root")
    sizes = named.groupBy("_root").agg(F.count("*").alias("work_family_size"))
    digest = F.concat(F.lit("wf:"), F.substr(F.sha1(F.col("_root").cast("binary")), F.lit(1), F.lit(12)))
    return named.join(sizes, "_root").withColumn("work_family_id", digest).drop("_root", "_key")


def expand_seed(seed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates related to the one record of ``seed``, best relation first."""
    one = prepare(seed).limit(1).first()
    if one is None:
        return candidates.limit(0).select("*", F.lit("").alias("relation"), F.lit(0.0).alias("confidence"))
    literal = F.struct(*(F.lit(list(one[n]) if isinstance(one[n], (list, tuple)) else one[n]).cast(t).alias(n) for n, t in prepare(seed).dtypes))
    keyed = candidates.withColumn("_key", publication_key())
    rows = prepare(candidates).dropDuplicates(["key"])
    near = rows.select("key", literal.alias("a"), F.struct(*rows.columns).alias("b")).where(F.col("key") != one["key"]).select(F.col("key").alias("_key"), relation().alias("r")).where("r.relation <> 'unrelated'")
    found = keyed.dropDuplicates(["_key"]).join(near, "_key").select(*candidates.columns, "r.relation", "r.confidence")
    return found.orderBy(F.desc(F.col("relation") == "publication_variant"), F.desc(F.col("relation") == "likely_extension"), F.desc("confidence"), F.desc(year_of(F.col("year").cast("string"))))


def _distinct_keys(rows: DataFrame) -> DataFrame:
    """One prepared row a key: the least, whatever the order of rows."""
    rest = [c for c in rows.columns if c != "key"]
    return rows.groupBy("key").agg(F.min(F.struct(*rest)).alias("r")).select("key", "r.*")


def _signs(words: Column) -> list[Column]:
    """Parities of the words in 128 buckets, as two longs: two sets differ in at least as many words as their bits."""
    at = lambda x: F.xxhash64(x)
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), at(x).bitwiseAND(63).cast("int"))
    half = lambda i: F.aggregate(words, F.lit(0).cast("long"), lambda acc, x: F.when(at(x).bitwiseAND(64) == 64 * i, acc.bitwiseXOR(bit(x))).otherwise(acc))
    return [half(0), half(1)]


def with_rare_words(rows: DataFrame) -> DataFrame:
    """Prepared ``rows`` with ``rare``: the words of each title, those of the fewest titles first; ``alike``: a digest of title, authors and
    year, by which rows relate to others; ``signs`` of the words."""
    each = rows.select("key", F.explode("w").alias("word"))
    ranked = each.join(each.groupBy("word").agg(F.count("*").alias("n")), "word").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("r"))
    found = rows.join(ranked.select("key", F.transform("r", lambda x: x["word"]).alias("rare")), "key", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>")))
    alike = F.unhex(F.md5(F.concat_ws("|", F.col("y").cast("string"), "t", "full").cast("binary")))  # no bar is in a search form
    return found.withColumns({"alike": alike, "signs": F.array(*_signs(F.col("rare")))})


def _author_words(rows: DataFrame, least: float, *facts: Column | str) -> DataFrame:
    """``(key, author, word)``, and ``facts``: two records with a common author and a Jaccard similarity of titles of ``least`` share one.

    Such titles share one of the first words of each, in a common order, rare ones first; so records
    of a frequent author meet by rare words only.
    """
    prefix = F.size("rare") - F.ceil(F.lit(least) * F.size("rare") - 1e-9).cast("int") + 1
    some = rows.where(F.size("rare") > 0).withColumn("word", F.explode(F.slice("rare", F.lit(1), prefix)))
    return some.withColumn("author", F.explode("full")).select("key", "author", "word", *facts)


def _tokens(rows: DataFrame, least: float) -> DataFrame:
    """``(token, alike, n, y, title, s0, s1)`` of authors and words; n to s1 tell which titles can't be similar."""
    facts = ["alike", F.size("rare").alias("n"), "y", F.xxhash64("t").alias("title"), F.col("signs")[0].alias("s0"), F.col("signs")[1].alias("s1")]
    each = _author_words(rows, least, *facts).select(F.xxhash64("author", "word").alias("token"), "alike", "n", "y", "title", "s0", "s1")
    return each


def _small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df``, marked for broadcast only if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _may_relate(least: float, years: int) -> Column:
    """False only for records x and y whose titles are equal or can't have the similarity, or whose years are too far apart."""
    of = lambda side, name: F.col(f"{side}.{name}")
    both = lambda name: (of("x", name), of("y", name))
    differ = sum((F.bit_count(of("x", s).bitwiseXOR(of("y", s))) for s in ("s0", "s1")), F.lit(0))
    sizes = (F.least(*both("n")) >= least * F.greatest(*both("n")) - 1e-9) & (differ <= (1 - least) / (1 + least) * (of("x", "n") + of("y", "n")) + 1e-6)
    near = (F.least(*both("y")) <= 0) | (F.abs(of("x", "y") - of("y", "y")) <= years)
    return (of("x", "title") != of("y", "title")) & sizes & near


#: Years that records of a relation lie apart at most.
YEARS = {"likely_extension": 5, "related_followup": 7}


def related_pairs(reached: DataFrame, rest: DataFrame, least: float, kinds: tuple[str, ...]) -> DataFrame:
    """``(key, parent, relation, confidence)``: the most confident of ``kinds``, of titles that differ, for rows of ``rest`` that stand in one to rows
    of ``reached``; ties to the last key.

    Rows of equal title, authors and year relate alike: they meet once, and the last key of ``reached`` stands for its own.
    Where tokens meet, sizes, signs and years leave out pairs that can't relate, so records travel only for pairs that mostly do.
    """
    once = lambda df: df.dropDuplicates(["token", "alike"])
    own = materialize(once(_tokens(reached, least)), "tokens")
    # late rounds have few new tokens: then no others are shuffled
    others = once(_tokens(rest, least).join(_small(own.select("token").distinct()), "token", "left_semi"))
    met = own.alias("x").join(others.alias("y"), (F.col("x.token") == F.col("y.token")) & _may_relate(least, max(YEARS[k] for k in kinds)))
    pairs = materialize(met.select(F.col("x.alike").alias("p"), F.col("y.alike").alias("q")).distinct(), "pairs")
    needed = F.struct("t", "w", "full", "d", "y")

    def one(df: DataFrame, name: str, side: str) -> DataFrame:
        wanted = df.withColumnRenamed("alike", name).join(_small(pairs.select(name).distinct()), name, "left_semi")
        return wanted.groupBy(name).agg(F.max("key").alias(f"{name}_key"), F.first(needed).alias(side))

    judged = pairs.join(one(reached, "p", "a").withColumnRenamed("p_key", "parent"), "p").join(one(rest, "q", "b"), "q")
    found = judged.select("q", "parent", relation().alias("r")).where(F.col("r.relation").isin(list(kinds))).select("q", "parent", "r.relation", "r.confidence")
    best = found.groupBy("q").agg(F.max_by(F.struct("parent", "relation", "confidence"), F.struct("confidence", "parent")).alias("m"))
    return rest.select("key", F.col("alike").alias("q")).join(best, "q").select("key", "m.*")


def best_links(reached: DataFrame, rest: DataFrame) -> DataFrame:
    """For each of ``rest`` that is a variant or extension of one of ``reached``: key, parent, relation and confidence of
    the most confident link, ties to the last key. Equal titles need no pairs: the last key of a title, and of a title and author, stands for all."""
    link = lambda df, confidence: df.select("key", "parent", F.lit("publication_variant").alias("relation"), F.lit(confidence).alias("confidence"))
    titled, wanted = reached.where("t <> ''"), rest.where("t <> ''")
    of_both = titled.select("t", F.explode("full").alias("author"), "key").groupBy("t", "author").agg(F.max("key").alias("parent"))
    found = link(wanted.select("key", "t", F.explode("full").alias("author")).join(of_both, ["t", "author"]), 1.0)
    found = found.unionByName(link(wanted.join(titled.groupBy("t").agg(F.max("key").alias("parent")), "t"), 0.95))
    found = found.unionByName(related_pairs(reached, rest, EXTENSION, ("likely_extension",)))
    best = found.groupBy("key").agg(F.max_by(F.struct("parent", "relation", "confidence"), F.struct("confidence", "parent")).alias("m"))
    return best.select("key", "m.*")


def _grow(rows: DataFrame, chosen: DataFrame, max_rounds: int) -> DataFrame:
    """``chosen`` (key, parent, relation, confidence, round) and all that its newest members reach among ``rows``, a durable table a round."""
    newest, first = chosen, chosen.agg(F.max("round")).first()[0] or 0
    for at in range(first + 1, first + max_rounds + 1):
        reached = rows.join(newest.select("key"), "key", "left_semi")
        rest = rows.join(chosen.select("key"), "key", "left_anti")
        newest = materialize(best_links(reached, rest).withColumn("round", F.lit(at)), "closure")
        if newest.isEmpty():
            return chosen
        chosen = materialize(chosen.unionByName(newest), "closure")
    raise RuntimeError(f"the family still grows after {max_rounds} rounds")


def _seeded(own: DataFrame) -> DataFrame:
    return own.select("key", F.lit(None).cast("string").alias("parent"), F.lit("seed").alias("relation"), F.lit(1.0).alias("confidence"), F.lit(0).alias("round"))


COLUMNS = ["doi", "title", "year", "authors", "venue", "abstract"]


def closure(seeds: DataFrame, candidates: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Keys reached from the seeds by variants and extensions: key, parent, relation, confidence, round.

    Each round joins the newest members with the rest; it ends when a round adds nothing.
    """
    rows = _distinct_keys(prepare(seeds.select(*COLUMNS).unionByName(candidates.select(*COLUMNS))))
    rows = materialize(with_rare_words(rows), "closure")
    return _grow(rows, materialize(_seeded(prepare(seeds).select("key").distinct()), "closure"), max_rounds)


def related_suggestions(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each candidate that is no member, the best follow-up relation to one: key, parent, relation, confidence, most confident first."""
    rows = materialize(with_rare_words(_distinct_keys(prepare(members.select(*COLUMNS).unionByName(candidates.select(*COLUMNS))))), "related")
    own = prepare(members).select("key").distinct()
    found = related_pairs(rows.join(own, "key", "left_semi"), rows.join(own, "key", "left_anti"), FOLLOWUP, ("related_followup",))
    best = found.groupBy("key").agg(F.max_by(F.struct("parent", "relation", "confidence"), F.struct("confidence", "parent")).alias("m")).select("key", "m.*")
    return best.orderBy(F.desc("confidence"), "key")


# --- candidates from a corpus -------------------------------------------------------------


def author_sizes(rows: DataFrame) -> DataFrame:
    """``(author, n)``: prepared records of each full author."""
    return rows.select("key", F.explode("full").alias("author")).groupBy("author").agg(F.count("*").alias("n"))


def literal_blocks(rows: DataFrame, sizes: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """``(key, block)``: a record's title, its authors of at most ``limit`` records, and each two of its other authors.

    Records that share a block are candidates for each other: equal titles, a common author that names
    someone in particular, or two common authors. A block of two frequent authors stands for the
    pairs of records that no bucket of one author needs to give.
    """
    known = rows.select("key", F.explode("full").alias("author")).join(sizes, "author", "left")
    some = lambda large: F.sort_array(F.collect_set(F.when((F.coalesce("n", F.lit(0)) > limit) == F.lit(large), F.col("author"))))
    held = known.groupBy("key").agg(some(False).alias("small"), some(True).alias("large"))
    one = F.transform("small", lambda x: F.concat(F.lit("a:"), x))
    two = F.flatten(F.transform("large", lambda x, i: F.transform(F.slice("large", i + 2, F.size("large")), lambda y: F.concat(F.lit("p:"), x, F.lit("|"), y))))
    titles = rows.where("t <> ''").select("key", F.concat(F.lit("t:"), "t").alias("block"))
    return held.select("key", F.explode(F.concat(one, two)).alias("block")).unionByName(titles)


def literal_candidates(frontier: DataFrame, blocks: DataFrame, own: DataFrame) -> DataFrame:
    """Distinct keys of ``blocks`` that share a block with the ``own`` blocks of the ``frontier``'s keys. No pairs are formed."""
    wanted = own.join(frontier.select("key"), "key", "left_semi").select("block").distinct()
    return blocks.join(wanted, "block", "left_semi").select("key").distinct()


def skipped_authors(frontier: DataFrame, rows: DataFrame, sizes: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """``(author, candidate_count)``: authors of the frontier who have too many records to name candidates alone."""
    own = rows.join(frontier.select("key"), "key", "left_semi").select(F.explode("full").alias("author")).distinct()
    return own.join(sizes.where(F.col("n") > limit), "author").select("author", F.col("n").alias("candidate_count"))


def vector_neighbours(vectors: DataFrame, k: int) -> Callable[[DataFrame], DataFrame]:
    """The semantic leg: keys of the ``k`` vectors of ``vectors(key, embedding)`` nearest to each key of a frontier, by blocks of queries."""
    # numbers as they lie in the files, which settle ties; dealt over all cores, whatever the row groups of the files
    numbered = materialize(dealt_by(vectors.select("key", "embedding", F.monotonically_increasing_id().alias("vec_id")), "vec_id"), "vectors")

    def near(frontier: DataFrame) -> DataFrame:
        asked = numbered.join(frontier.select("key"), "key", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vector"))
        return top_k_many(numbered.select("vec_id", "embedding"), asked, k).select("vec_id").distinct().join(numbered, "vec_id").select("key")

    return near


def extension_links(rows: DataFrame) -> DataFrame:
    """``(p, q, confidence)``, in both directions: the digests ``alike`` of rows that are extensions of each other and differ in their titles.

    Found once for a whole corpus, as rows that are alike relate alike; growth then only follows links.
    """
    held = materialize(_tokens(rows, EXTENSION).dropDuplicates(["token", "alike"]), "tokens")
    met = held.alias("x").join(held.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.alike") < F.col("y.alike")) & _may_relate(EXTENSION, YEARS["likely_extension"]))
    pairs = materialize(met.select(F.col("x.alike").alias("p"), F.col("y.alike").alias("q")).distinct(), "pairs")

    def one(name: str, side: str) -> DataFrame:
        wanted = rows.withColumnRenamed("alike", name).join(_small(pairs.select(name).distinct()), name, "left_semi")
        return wanted.groupBy(name).agg(F.first(F.struct("t", "w", "full", "d", "y")).alias(side))

    judged = pairs.join(one("p", "a"), "p").join(one("q", "b"), "q").select("p", "q", relation().alias("r"))
    found = judged.where("r.relation = 'likely_extension'").select("p", "q", "r.confidence")
    back = F.struct(F.col("q").alias("p"), F.col("p").alias("q"), "confidence")
    return materialize(found.select(F.inline(F.array(F.struct("p", "q", "confidence"), back))), "links")


def _nodes(rows: DataFrame) -> DataFrame:
    """``(key, alike, title, written)``: digests by which rows link: of all, of the title (null without one), and of the title with each author."""
    digest = lambda c: F.unhex(F.md5(c.cast("binary")))
    titled = F.col("t") != ""
    written = F.when(titled, F.transform("full", lambda x: digest(F.concat_ws("|", "t", x))))  # no bar is in a search form
    return rows.select("key", "alike", F.when(titled, digest(F.col("t"))).alias("title"), written.alias("written"))


#: Newest members of a round that are sent to every task, instead of dealing all nodes anew.
NEWEST = 100_000


def _follow(nodes: DataFrame, links: DataFrame, chosen: DataFrame, max_rounds: int, fresh: DataFrame | None = None) -> DataFrame:
    """As ``_grow``, along ``links`` and equal titles of ``nodes``; only digests and keys are joined.

    ``fresh``: the only nodes that ``chosen`` may reach in the first round, if all others are known to be out of its reach.
    """
    newest, first, n = chosen, chosen.agg(F.max("round")).first()[0] or 0, chosen.count()
    row = lambda df, name, confidence: df.select("key", F.struct(F.col("parent"), F.lit(name).alias("relation"), confidence.alias("confidence")).alias("m"))
    for at in range(first + 1, first + max_rounds + 1):
        sent = F.broadcast if n <= NEWEST else (lambda df: df)
        to = nodes if fresh is None or at > first + 1 else fresh
        reached = materialize(nodes.join(sent(newest.select("key")), "key", "left_semi"), "reached")
        last = lambda df, by: sent(df.where(F.col(by).isNotNull()).groupBy(by).agg(F.max("key").alias("parent")))  # noqa: B023, E731
        each = lambda df: df.select("key", F.explode("written").alias("by"))
        found = row(each(to).join(last(each(reached), "by"), "by"), "publication_variant", F.lit(1.0))
        found = found.unionByName(row(to.join(last(reached, "title"), "title"), "publication_variant", F.lit(0.95)))
        near = links.join(last(reached.select("key", F.col("alike").alias("p")), "p"), "p").groupBy("q").agg(F.max_by(F.struct("parent", "confidence"), F.struct("confidence", "parent")).alias("r"))
        near = to.join(sent(near), F.col("alike") == F.col("q")).select("key", "r.*")
        found = found.unionByName(row(near, "likely_extension", F.col("confidence")))
        best = found.join(chosen.select("key"), "key", "left_anti").groupBy("key").agg(F.max_by("m", F.struct("m.confidence", "m.parent")).alias("m"))
        newest = materialize(best.select("key", "m.*", F.lit(at).alias("round")), "closure")
        n = newest.count()
        if not n:
            return chosen
        chosen = materialize(chosen.unionByName(newest), "closure")
    raise RuntimeError(f"the family still grows after {max_rounds} rounds")


@dataclass
class CorpusClosure:
    """Members as of ``closure``; candidates that were met; authors too frequent to name candidates; a dict a round; warnings."""

    members: DataFrame
    candidates: DataFrame
    skipped: DataFrame
    rounds: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def corpus_closure(seeds: DataFrame, corpus: DataFrame, neighbours: Callable[[DataFrame], DataFrame] | None = None, limit: int = CANDIDATES, max_rounds: int = 50, strict: bool = False) -> CorpusClosure:
    """Families of the seeds within a whole corpus, as a fixed point.

    A round meets candidates of the newest members, by literal blocks and by ``neighbours`` (frontier keys to
    keys of the corpus), and lets the family grow among all candidates so far; it ends when no
    member is new. Each round is a durable table. A leg that fails is an error, with one exception: unless ``strict``,
    ``neighbours`` that raises an ``OSError`` itself (a service out of reach) is left out from then on, and a warning says so.
    """
    every = materialize(_distinct_keys(prepare(corpus.select(*COLUMNS))), "corpus")
    own = prepare(seeds.select(*COLUMNS))
    rows = materialize(with_rare_words(_distinct_keys(every.unionByName(own))), "corpus")
    sizes = materialize(author_sizes(every), "corpus")
    blocks = materialize(literal_blocks(every, sizes, limit), "corpus")
    own_blocks = materialize(literal_blocks(rows, sizes, limit), "corpus")
    nodes, links = materialize(_nodes(rows), "corpus"), extension_links(rows)
    seed_keys = materialize(own.select("key").distinct(), "corpus")
    members, met, frontier = materialize(_seeded(seed_keys), "corpus"), seed_keys, seed_keys
    done = CorpusClosure(members, met, sizes)
    for at in range(1, max_rounds + 1):
        found = literal_candidates(frontier, blocks, own_blocks)
        if neighbours is not None:
            try:
                asked = neighbours(frontier)
            except OSError as e:
                if strict:
                    raise
                done.warnings.append(f"semantic candidates are left out after a failure: {(str(e).strip() or type(e).__name__).splitlines()[0][:300]}")
                neighbours = None
            else:  # what fails in Spark is no matter of a service, and ends the run
                near = materialize(asked.select("key").distinct(), "neighbours")
                found = found.unionByName(near.join(every, "key", "left_semi")).distinct()
        fresh = materialize(found.join(met, "key", "left_anti"), "candidates")
        met, added = met.unionByName(fresh), fresh.count()
        # older candidates that are no members are out of the members' reach, so only new ones can join first
        if added:
            among = materialize(nodes.join(met, "key", "left_semi"), "nodes")
            grown = _follow(among, links, members, max_rounds, None if at == 1 else among.join(fresh, "key", "left_semi"))
        else:
            grown = members
        frontier = materialize(grown.join(members, "key", "left_anti").select("key"), "frontier")
        new = frontier.count()
        done.rounds.append({"round": at, "new_candidates": added, "members": grown.count(), "new_members": new})
        members = grown
        if not new:
            break
    else:
        raise RuntimeError(f"the family still grows after {max_rounds} rounds")
    done.candidates = met
    done.skipped = skipped_authors(members, rows, sizes, limit)
    # paths and rounds as of one closure over all candidates, of which it reaches the members and no others
    among = materialize(nodes.join(members.select("key"), "key", "left_semi"), "nodes")
    done.members = _follow(among, links, materialize(_seeded(seed_keys), "corpus"), max_rounds)
    return done
