"""What the texts of records say about technology, temperature, circuit and frequency, with their target band."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.scoring import RANGE_SEPARATOR, band_overlap, band_relation, evidence_axes, frequency_mentions, parse_band, temperature_bucket, temperature_mentions
from lectern.functions.text import normalize, text_of
from lectern.operators.cards import evidence_text

# Technologies and their words, words of circuits, and the patterns of the normalised text.
TECHNOLOGIES = {
    "InP": ["inp", "indium phosphide", "ingaas", "inalas"], "SiGe": ["sige", "silicon germanium"], "CMOS": ["cmos", "finfet", "fd-soi", "fdsoi", "mosfet"],
    "GaAs": ["gaas"], "GaN": ["gan"],
}
CIRCUITS = [" lna ", " lnas ", "low noise amplifier", "low-noise amplifier"]
CRYOGENIC = r"\bcryo(?:genic|cooled)?\b"
MEASURED = r"\bmeasure(?:d|ment|ments)?\b|experimental"
SIMULATED = r"\bsimulat(?:e|ed|ion|ions)\b"
PREPRINT = r"\barxiv\b|\bpreprint\b"
#: Bands that a record states in fields of its own: label, field.
BANDS = [("lna", "lna_band_ghz"), ("system", "system_band_ghz"), ("reported", "frequency_range_ghz")]
#: Parts that don't work from this frequency on (GHz).
SLOW_PARTS, SLOW_FROM = ["lt1028"], 1.0


@dataclass(frozen=True)
class Rules:
    """Words that tell technologies and circuits."""

    technologies: dict[str, list[str]] = field(default_factory=lambda: TECHNOLOGIES)
    circuits: list[str] = field(default_factory=lambda: CIRCUITS)


def _words(words: list[str]) -> str:
    return r"\b(?:" + "|".join(rf"\Q{w}\E" for w in words) + r")\b"


def _bands(types: dict[str, str]) -> Column:
    """Bands that a record's fields state, as mentions with their field."""
    one = lambda n: F.when(parse_band(n).isNotNull(), F.struct(parse_band(n)["low"].alias("low"), parse_band(n)["high"].alias("high"), text_of(n).alias("text"), F.lit(False).alias("inferred"), F.lit(n).alias("field")))
    found = [one(n) for _, n in BANDS if n in types]
    kind = "array<struct<low:double,high:double,text:string,inferred:boolean,field:string>>"
    return (F.array_compact(F.array(*found)) if found else F.array()).cast(kind)


def snapshot(records: DataFrame, target: tuple[float, float] | None = None, rules: Rules | None = None, key: str = "position") -> DataFrame:
    """One row for each record: its mentions, their relation to ``target`` (GHz), and what they are evidence of.

    ``best`` is the mention with the largest overlap, then one that covers the target, then one that was not inferred from
    a band's name, then the first. ``axes`` tells evidenced, unknown or contradicted; ``missing`` lists the axes without evidence.
    Records without any text have no mentions. Names of parts are looked up without blanks, as the normalised text sets letters and digits apart. Expressions only; nothing is shuffled.
    """
    rules = rules or Rules()
    types = dict(records.dtypes)
    read = records.select(key, evidence_text(records).alias("said"), _bands(types).alias("bands"))
    read = read.withColumn("plain", F.concat(F.lit(" "), normalize("said"), F.lit(" ")))
    has = lambda pattern: F.col("plain").rlike(pattern)
    stated = F.transform(frequency_mentions("said"), lambda m: F.struct(m["low"].alias("low"), m["high"].alias("high"), m["text"].alias("text"), m["inferred"].alias("inferred"), F.lit("").alias("field")))
    found = F.concat(stated, F.col("bands"))
    if target:
        low, high = (F.lit(float(x)) for x in target)
        found = F.transform(found, lambda m: m.withField("overlap", F.round(band_overlap(m["low"], m["high"], low, high), 6)).withField("relation", band_relation(m["low"], m["high"], low, high)))
    read = read.withColumns({
        "technologies": F.array_compact(F.array(*(F.when(has(_words(words)), F.lit(name)) for name, words in rules.technologies.items()))).cast("array<string>"),
        "temperatures": temperature_mentions("said"), "frequencies": found,
        "circuit": F.exists(F.lit(rules.circuits), lambda t: F.contains(F.col("plain"), t)), "measured": has(MEASURED), "simulated": has(SIMULATED), "cold": has(CRYOGENIC),
    })
    overlaps = F.transform("frequencies", lambda m: m["overlap"]) if target else F.array().cast("array<double>")
    axes = evidence_axes(F.col("technologies"), F.col("cold") | F.exists("temperatures", lambda t: t <= 120), F.col("circuit"), overlaps)
    order = lambda m, i: F.struct(m["overlap"], m["relation"] == "full_cover", ~m["inferred"], -i)
    best = F.get("frequencies", -F.array_max(F.transform("frequencies", order))["col4"]) if target else F.lit(None)
    slow = F.exists(F.lit(SLOW_PARTS), lambda w: F.contains(F.replace("plain", F.lit(" "), F.lit("")), w)) & F.exists("frequencies", lambda m: m["high"] >= SLOW_FROM)
    flags = F.array(
        F.when(has(PREPRINT), "preprint_requires_primary_evidence_check"), F.when(slow, "implausible_component_frequency_claim"),
        F.when(F.col("simulated") & ~F.col("measured"), "simulation_only"),
    )
    return read.withColumn("axes", axes).select(
        key, "technologies", "temperatures", F.array_sort(F.array_distinct(F.transform("temperatures", temperature_bucket))).alias("temperature_buckets"),
        F.col("cold").alias("cryogenic_language"), "frequencies", best.alias("best"),
        F.when(F.col("measured"), "measured").when(F.col("simulated"), "simulation_only").otherwise("unknown").alias("measurement"), "axes",
        F.filter(F.map_keys("axes"), lambda a: F.col("axes")[a] != "evidenced").alias("missing"), F.array_compact(flags).alias("credibility_flags"),
        F.array_compact(F.array(F.when(F.col("said").rlike(RANGE_SEPARATOR), "suspected_corrupted_frequency_range_separator"))).alias("quality_flags"),
    )
