"""Surrogate generation for personal data with native expressions.

One pattern finds entities in whole texts (KINDS). Each is replaced by a surrogate of the
same kind and format: digits by digits, letters by letters of the same script and case,
signs in place; the last labels of a mail address by a reserved example domain; parts of a
name by made-up parts of the same script and, for given names, the gender of the title. The
replacement depends on a secret key, the kind and the canonical form (case, separators and
titles don't matter), so the same entity has the same surrogate in every document. Later
mentions of the parts of a name, without a title, get the same parts in that document.

The key is a parameter, or the session's ``lectern.pii.key``; without either each run draws
its own, which nobody knows, so surrogates of two such runs differ.

Distinctness. Phones, cards (first digit kept, check digit right), social security numbers
and IPv4 addresses go through a keyed permutation of all numbers of their length (a Feistel
network), so no two can collide, however many there are; a surrogate may by chance be another
real number of the corpus, which itself is replaced. The other kinds have surrogates from
hashes; the corpus's distinct entities of these are grouped by surrogate. Of several
entities with one surrogate, all but the least by canonical form, and any whose surrogate is
itself an entity of the corpus, try again with a counter until none is left (forms grow, or have
12 random characters or more, so a few rounds do; ROUNDS rounds that leave as many are an error). Those that
needed a retry travel to the documents that hold them by a join; all other replacement is
done where the text is read.

Not told apart: a capital word of a text that is also a part of one of its names (Mark my words) is replaced like the name.
Not detected, as too many ordinary words and numbers look alike: names without any title in
their document, ten or fewer digits without a separator or +, card numbers with a wrong check
digit (these are left as they are), compressed IPv6 addresses whose first group is short.

Edge cases: null and empty texts stay as they are; texts of any length are searched whole;
equal rows get equal results; extra columns are kept by ``pseudonymize``, whatever their
names; a null doc_id makes no difference; where two kinds fit one place (a tie), the first
of KINDS counts.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import boxed, checked_broadcast, drop_tables, materialize, row_key, temporary_tables

ROUNDS = 20
#: Rounds of the Feistel networks (even, so that either half is back in its place).
FEISTEL = 8

# Fixed patterns and titles.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_WORD = r"\p{L}\p{N}"
MALE = "Mr|Herr|Señor|Sr|Monsieur|Господин|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Srta|Sra|Madame|Mme|Госпожа|Κυρία"
NEUTRAL = "Dr|Prof|Professor|Doctor|Доктор|Профессор"
TITLES = rf"(?:(?:{MALE}|{FEMALE}|{NEUTRAL})\.? )++"
#: A part of a name: Smith, McDonald, O'Brien, or SMITH.
PART = r"(?:\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:\p{Lu}\p{Ll}+)*|\p{Lu}(?:['’]?\p{Lu})+)"
NAME = rf"(?<!\p{{L}}){TITLES}{PART}(?:[ -]{PART}){{0,2}}(?!\p{{L}})"
SECRET_VALUE = r"[A-Za-z0-9+/_=-]{12,}"
KINDS = {
    "secret": rf"(?i:(?<![{_WORD}])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth)[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?){SECRET_VALUE}|(?<![{_WORD}])(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|[0-9a-f]{{32,64}}|[0-9A-F]{{32,64}})(?![{_WORD}])",
    "email": rf"(?<![{_WORD}._%+-])[{_WORD}._%+-]++@[{_WORD}-]+(?:\.[{_WORD}-]+)*\.\p{{L}}{{2,}}",
    "ipv6": r"(?<![:\p{L}\p{N}])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{4}:(?:[0-9A-Fa-f]{1,4}:){0,5}(?::[0-9A-Fa-f]{1,4}){1,6})(?![:\p{L}\p{N}])",
    "iban": rf"(?<![{_WORD}])[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?![{_WORD}])",
    "ipv4": rf"(?<![{_WORD}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![{_WORD}]|\.[0-9])",
    "ssn": rf"(?<![{_WORD}-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![{_WORD}-])",
    "card": rf"(?<![{_WORD}])(?:[0-9]{{4}}([ -]?)[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{1,7}}|3[0-9]{{3}}[ -]?[0-9]{{6}}[ -]?[0-9]{{5}}|[0-9]{{13,19}})(?![{_WORD}])",
    "phone": rf"(?<![{_WORD}+])(?:(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{2,4}}\)[ .-]?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-]?[0-9]{{4}}|\+[0-9]{{1,3}}(?:[ .-]?[0-9]{{2,4}}){{2,5}}|(?=0(?:[ .-]?[0-9]){{8,10}}(?![ .-]?[0-9]))0[0-9]{{1,4}}([ .-])[0-9]{{2,4}}(?:\2[0-9]{{2,4}}){{1,3}})(?![{_WORD}])",
    "name": NAME,
}
KINDS = {k: p.replace("([ -]?)", "(?<gap>[ -]?)").replace(r"\1", r"\k<gap>").replace("([ .-])", "(?<sep>[ .-])").replace(r"\2", r"\k<sep>") for k, p in KINDS.items()}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Kinds whose surrogates come from a permutation.
PERMUTED = ("phone", "card", "ssn", "ipv4")
#: A text without any of these holds no entity.
HINT = rf"[0-9@=:]|(?:{MALE}|{FEMALE}|{NEUTRAL})\.? \p{{Lu}}"

SYLLABLES = "ba be bo da de do fa fe fi ga go ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo wa we".split()
CYRILLIC, GREEK = "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"


def secret_key(spark: SparkSession, key: str | None = None) -> str:
    return key or spark.conf.get("lectern.pii.key", None) or secrets.token_hex(16)


def matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def kind_of(m: Column) -> Column:
    """The first kind whose pattern fits the whole of ``m``; "number" for a card whose check digit is wrong."""
    cases = [F.when(m.rlike(rf"^(?:{p})$"), F.when(luhn(_digits(m)) == 0, F.lit(k)).otherwise(F.lit("number")) if k == "card" else F.lit(k)) for k, p in KINDS.items()]
    return F.coalesce(*cases, F.lit("name"))


def luhn(digits: Column) -> Column:
    """Weighted sum of the digits, modulo 10: 0 for a valid card number."""

    def add(total: Column, i: Column) -> Column:
        x = F.coalesce(F.substr(digits, i, F.lit(1)).try_cast("int"), F.lit(0))
        return total + F.when(F.pmod(F.length(digits) - i, F.lit(2)) == 0, x).otherwise(F.when(x > 4, x * 2 - 9).otherwise(x * 2))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _prefix(m: Column, kind: Column) -> Column:
    """What stays as it is in front: a phone's country code, a secret's label, an account's country, a title."""
    return (
        F.when(kind == "phone", F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .(-]))?", 0))
        .when(kind == "secret", F.regexp_extract(m, rf"^(.*?[=:]\s*[\"']?)?(?={SECRET_VALUE}$)", 0))
        .when(kind == "iban", F.substr(m, F.lit(1), F.lit(2)))
        .when(kind == "name", F.regexp_extract(m, f"^{TITLES}", 0))
        .otherwise(F.lit(""))
    )


def _rest(m: Column, kind: Column) -> Column:
    return F.substr(m, F.length(_prefix(m, kind)) + 1)


def units(m: Column, kind: Column) -> Column:
    """(kind, canonical form) of the parts that are mapped: one, or those of a name."""
    rest = _rest(m, kind)
    plain = F.when(kind.isin("phone", "card", "ssn"), _digits(rest)).when(kind == "secret", rest).when(kind == "iban", F.regexp_replace(m, " ", "")).otherwise(F.lower(rest))
    parts = F.split(rest, " ")
    title = F.lower(_prefix(m, kind))
    given = F.when(title.rlike(rf"(?:^| )(?:{FEMALE.lower()})\.? "), "given_f").when(title.rlike(rf"(?:^| )(?:{MALE.lower()})\.? "), "given_m").otherwise("given_n")
    name = F.transform(parts, lambda p, i: F.struct(F.when(i == F.size(parts) - 1, F.lit("surname")).otherwise(given).alias("kind"), F.lower(p).alias("form")))
    return F.when(kind == "name", name).otherwise(F.array(F.struct(kind.alias("kind"), plain.alias("form"))))


def _stream(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """Hex digits that the key, kind, form and attempt determine, two for each character."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, form, attempt.cast("string"))
    blocks = F.sequence(F.lit(0), F.floor(F.length(form) / 32).cast("int"))
    return F.array_join(F.transform(blocks, lambda i: F.sha2(F.concat_ws("\x1f", seed, i.cast("string")).cast("binary"), 256)), "")


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substr(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def _same_format(form: Column, stream: Column, always_hex: Column | None = None) -> Column:
    """Each character by one of the same class."""
    hexed = form.rlike("^[0-9a-f:]{16,}$|^[0-9A-F]{16,}$")
    hexed = hexed if always_hex is None else hexed | always_hex

    def one(c: Column, i: Column) -> Column:
        n = _byte(stream, i)
        lower, upper = F.when(hexed, _pick("abcdef", n)).otherwise(_pick("abcdefghijklmnopqrstuvwxyz", n)), F.when(hexed, _pick("ABCDEF", n)).otherwise(_pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
        return (
            F.when(c.rlike("[0-9]"), _pick("0123456789", n)).when(c.rlike("[a-z]"), lower).when(c.rlike("[A-Z]"), upper)
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(CYRILLIC, n)).when(c.rlike(r"\p{IsGreek}"), _pick(GREEK, n)).when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", n)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(form, ""), one), "")


def _feistel(x: Column, y: Column, x_size: Column, y_size: Column, seed: Column) -> Column:
    """A keyed permutation of the pairs x < x_size, y < y_size: a struct (x, y)."""

    def step(now: Column, i: Column) -> Column:
        noise = F.conv(F.substr(F.sha2(F.concat_ws("\x1f", seed, i.cast("string"), now["y"].cast("string")).cast("binary"), 256), F.lit(1), F.lit(15)), 16, 10).cast("long")
        return F.struct(now["y"].alias("x"), F.pmod(now["x"] + noise, F.when(i % 2 == 0, x_size).otherwise(y_size)).alias("y"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(FEISTEL - 1)), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), step)


def _permuted_digits(digits: Column, kind: Column, key: str) -> Column:
    """A number of as many digits; different ones for different numbers."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    number = lambda c: F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    pair = _feistel(number(F.substr(digits, F.lit(1), half)), number(F.substr(digits, half + 1)), power(half), power(n - half), F.concat_ws("\x1f", F.lit(key), kind, n.cast("string")))
    return F.transform(F.array(pair), lambda p: F.concat(F.lpad(p["x"].cast("string"), half, F.lit("0")), F.lpad(p["y"].cast("string"), n - half, F.lit("0"))))[0]


def _permuted(kind: Column, form: Column, key: str) -> Column:
    """Surrogates of the kinds in PERMUTED, one to one."""
    inner = _permuted_digits(F.substr(form, F.lit(2), F.length(form) - 2), kind, key)
    card = F.transform(F.array(F.concat(F.substr(form, F.lit(1), F.lit(1)), inner)), lambda d: F.concat(d, F.pmod(10 - luhn(F.concat(d, F.lit("0"))), F.lit(10)).cast("string")))[0]
    octet = lambda i: F.coalesce(F.get(F.split(form, r"\."), F.lit(i)).try_cast("long"), F.lit(0).cast("long"))
    size = F.lit(65536).cast("long")
    pair = _feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), size, size, F.concat_ws("\x1f", F.lit(key), kind))
    part = lambda c, high: (F.shiftright(c, 8) if high else c.bitwiseAND(F.lit(255))).cast("string")
    ip = F.transform(F.array(pair), lambda p: F.concat_ws(".", part(p["x"], True), part(p["x"], False), part(p["y"], True), part(p["y"], False)))[0]
    return F.when(kind == "ipv4", ip).when(kind == "card", card).otherwise(_permuted_digits(form, kind, key))


def surrogate(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """Replacement, in canonical form, of a unit; retries of short forms grow longer."""
    stream = _stream(kind, form, attempt, key)
    tld = F.regexp_extract(form, r"\.(com|net|org)$", 1)
    local, label = F.regexp_extract(form, "^([^@]*)@", 1), F.regexp_extract(form, "@([^.]*)", 1)
    more = F.when(attempt > 0, F.substr(F.translate(F.sha1(stream.cast("binary")), "0123456789", "ghijklmnop"), F.lit(1), attempt)).otherwise(F.lit(""))
    email = F.concat(_same_format(local, stream), more, F.lit("@"), _same_format(label, F.sha2(stream.cast("binary"), 256)), F.lit(".example."), F.when(tld == "", "org").otherwise(tld))
    latin = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), lambda i: F.get(F.lit(SYLLABLES), _byte(stream, i) % len(SYLLABLES))), "")
    made = lambda alphabet: F.array_join(F.transform(F.sequence(F.lit(0), attempt + 5), lambda i: _pick(alphabet, _byte(stream, i))), "")
    script = F.when(form.rlike(r"\p{IsCyrillic}"), "c").when(form.rlike(r"\p{IsGreek}"), "g").otherwise("l")
    root = F.when(script == "c", made(CYRILLIC)).when(script == "g", made(GREEK)).otherwise(latin)
    last = (
        F.when(kind == "given_f", F.when(script == "c", "а").when(script == "g", "α").otherwise("a"))
        .when(kind == "given_n", F.when(script == "c", "и").when(script == "g", "ι").otherwise("e"))
        .when(kind == "given_m", F.when(script == "c", "н").when(script == "g", "ος").otherwise("n"))
        .otherwise(F.when(script == "c", "ко").when(script == "g", "ης").otherwise("rt"))
    )
    return (
        F.when(kind.isin(*PERMUTED), _permuted(kind, form, key)).when(kind == "email", email).when(kind.isin("given_f", "given_m", "given_n", "surname"), F.concat(root, last))
        .when(kind == "iban", F.concat(F.substr(form, F.lit(1), F.lit(2)), _same_format(F.substr(form, F.lit(3)), stream))).otherwise(_same_format(form, stream, kind == "ipv6"))
    )


def _like(part: Column, new: Column) -> Column:
    """A part's surrogate in capitals like the part, or with a first one."""
    return F.when((F.upper(part) == part) & (F.length(part) > 1), F.upper(new)).otherwise(F.concat(F.upper(F.substr(new, F.lit(1), F.lit(1))), F.substr(new, F.lit(2))))


def _fit(m: Column, kind: Column, mapped: Column) -> Column:
    """The surrogates ``mapped`` of the units of ``m`` in the format of ``m``."""
    rest, first = _rest(m, kind), F.get(mapped, F.lit(0))
    upper = (F.upper(m) == m) & (F.lower(m) != m)
    # separated groups: signs of the original between characters of the surrogate
    gaps = F.split(F.when(kind == "iban", m).otherwise(rest), F.when(kind == "iban", F.lit("[A-Z0-9]")).otherwise(F.lit("[0-9]")), -1)
    filled = F.array_join(F.zip_with(gaps, F.split(first, ""), lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))), "")
    cased = F.when(upper, F.upper(first)).otherwise(first)
    name = F.array_join(F.zip_with(F.split(rest, " "), mapped, _like), " ")
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.concat(_prefix(m, kind), filled)).when(kind == "iban", filled)
        .when(kind == "secret", F.concat(_prefix(m, kind), first)).when(kind == "name", F.concat(_prefix(m, kind), name)).otherwise(cased)
    )


def retries(docs: DataFrame, key: str) -> DataFrame:
    """``(kind, form, attempt)`` of the units whose first surrogate is taken; in the end no two units of a kind share one."""
    found = docs.where(F.col("text").rlike(HINT)).select(F.explode(matches(F.col("text"))).alias("m")).distinct()
    found = found.select("m", kind_of(F.col("m")).alias("kind")).where(~F.col("kind").isin("number", *PERMUTED))
    forms = found.select(F.explode(units(F.col("m"), F.col("kind"))).alias("u")).select("u.*").distinct()
    state = materialize(forms.withColumn("attempt", F.lit(0)).withColumn("out", surrogate(F.col("kind"), F.col("form"), F.lit(0), key)), "pii")
    order = Window.partitionBy("kind", "out").orderBy("attempt", "form")
    least, stuck = None, 0
    while True:
        own = state.select(F.col("kind").alias("k"), F.col("form").alias("f"))
        real = state.join(own, (F.col("kind") == F.col("k")) & (F.col("out") == F.col("f")), "left_semi").select("kind", "form")
        twice = state.groupBy("kind", "out").count().where("count > 1").select("kind", "out")
        later = state.join(twice, ["kind", "out"]).withColumn("n", F.row_number().over(order)).where("n > 1").select("kind", "form")
        again = materialize(real.unionByName(later).distinct().withColumn("again", F.lit(1)), "pii-again")
        left = again.count()
        if not left:
            break
        stuck = 0 if least is None or left < least else stuck + 1
        least = left if least is None else min(left, least)
        if stuck >= ROUNDS:
            raise RuntimeError(f"{left} surrogates still collide after {ROUNDS} rounds without progress")
        state = state.join(again, ["kind", "form"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0)))
        state = materialize(state.select("kind", "form", "attempt", surrogate(F.col("kind"), F.col("form"), F.col("attempt"), key).alias("out")), "pii")
    return state.where("attempt > 0").select("kind", "form", "attempt")


def _mapped(m: Column, tries: Column | None, key: str) -> Column:
    """Surrogates of the units of the match ``m(m, kind)``."""

    def unit(u: Column) -> Column:
        attempt = F.lit(0) if tries is None else F.coalesce(F.try_element_at(tries, F.concat(u["kind"], F.lit("|"), u["form"])), F.lit(0))
        return surrogate(u["kind"], u["form"], attempt, key)

    return F.transform(units(m["m"], m["kind"]), unit)


def _name_parts(found: Column) -> Column:
    """(part, surrogate) of the names among ``found(m, kind, new)``, longest parts first."""
    names = F.filter(found, lambda m: m["kind"] == "name")
    pairs = F.transform(names, lambda m: F.zip_with(F.split(_rest(m["m"], m["kind"]), " "), m["new"], lambda p, s: F.struct((-F.length(p)).alias("n"), p.alias("part"), _like(p, s).alias("new"))))
    return F.sort_array(F.array_distinct(F.flatten(pairs)))


def _mentions(gap: Column, parts: Column) -> Column:
    """``gap`` with the parts of names of the same document replaced."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}@._-])(?:"), F.array_join(F.transform(parts, lambda p: p["part"]), "|"), F.lit(r")(?![\p{L}\p{N}@])"))
    new = lambda w: F.filter(parts, lambda p: p["part"] == w)[0]["new"]
    replaced = F.transform(F.regexp_extract_all(gap, pattern, F.lit(0)), new)
    joined = F.array_join(F.zip_with(F.split(gap, pattern, -1), replaced, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    return F.when(F.size(parts) > 0, joined).otherwise(gap)


def pseudonymize(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs``, all columns, with surrogates in ``text``; ``pii_kinds`` tells what was replaced, in order.

    If ``docs`` has a column ``pii_kinds``, the new one has underscores behind its name.
    """
    key = secret_key(docs.sparkSession, key)
    with temporary_tables(docs.sparkSession) as made:
        taken = materialize(retries(docs, key), "pii-retries")
        drop_tables(docs.sparkSession, made[:-1])
    hint = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    found = F.transform(matches(F.col("text")), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    held = boxed(docs, F.col("text").alias("old"), row_key().alias("key"), F.when(hint, found).alias("found"))
    tries = None
    if not taken.isEmpty():
        each = held.select("key", F.explode("found").alias("f")).where(~F.col("f.kind").isin("number", *PERMUTED))
        each = each.select("key", F.explode(units(F.col("f.m"), F.col("f.kind"))).alias("u")).select("key", "u.*").distinct()
        mine = each.join(checked_broadcast(taken), ["kind", "form"]).groupBy("key")
        mine = mine.agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit("|"), "form"), "attempt"))).alias("tries"))
        held, tries = held.join(checked_broadcast(mine), "key", "left"), F.col("tries")
    mapped = F.transform("found", lambda m: F.struct(m["m"].alias("m"), m["kind"].alias("kind"), F.when(m["kind"] != "number", _mapped(m, tries, key)).alias("new")))
    held = held.select("_row", "old", mapped.alias("found"))
    new = F.transform("found", lambda m: F.when(m["kind"] == "number", m["m"]).otherwise(_fit(m["m"], m["kind"], m["new"])))
    kinds = F.filter(F.transform("found", lambda m: m["kind"]), lambda k: k != "number")
    held = held.select("_row", "old", new.alias("new"), kinds.alias("kinds"), _name_parts(F.col("found")).alias("parts"))
    gaps = F.transform(F.split("old", PATTERN, -1), lambda g: _mentions(g, F.col("parts")))
    text = F.array_join(F.zip_with(gaps, F.col("new"), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    free = "pii_kinds"
    while free in docs.columns:
        free += "_"
    out = held.select("_row", F.when(F.size("kinds") > 0, text).otherwise(F.col("old")).alias("text"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
    return out.select(*(F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns), F.col("kinds").alias(free))
