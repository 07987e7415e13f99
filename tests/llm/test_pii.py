import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import pii

TEXTS = [
    "mail und.34@mail7.example.com or UND.34@MAIL7.EXAMPLE.COM!! call +1 (017) 555-7713. and +1 (017) 555-7713%%% ip 217.2.20.125!!",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### 4785380592391139$$$ 4785 3805 9239 1139 und.34@mail7.example.com',
    "Mr. John Smith met Frau Anna Smith; Mr. Smith left. Господин Иван Петров", "SSN 123-45-6789 IBAN DE89 3704 0044 0532 0130 00 ip6 2001:0db8:85a3:0000:0000:8a2e:0370:7334 v 3. 10.5. 2001:10",
    "", None, "nothing 12 here, Mr and 1.2.3 or 300.1.1.1", "x" * 50000 + " 10.20.30.40",
]


def run(spark, texts, **k):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("kind", "m", "pii_kinds", "pii_row", "found", "key", "_row", "a.b")})
    out = pii.pseudonymize(df, **k)
    assert out.columns == [*df.columns, "pii_kinds_"]
    return {r["doc_id"]: (r["text"], r["pii_kinds_"]) for r in out.collect()}


def test_formats_and_coreference(spark):
    found = run(spark, TEXTS)
    a, kinds = found[0]
    m = re.fullmatch(r"mail ([a-z]{3}\.\d\d@[a-z]{4}\d\.example\.com) or (.*)!! call (\+1 \(\d{3}\) \d{3}-\d{4})\. and (.*)%%% ip ((?:\d{1,3}\.){3}\d{1,3})!!", a)
    assert m and m[2] == m[1].upper() and m[3] == m[4] and kinds == ["email", "email", "phone", "phone", "ipv4"]
    b, _ = found[1]
    n = re.fullmatch(r'token = "([0-9a-f]{40})"### (\d{16})\$\$\$ (\d{4} \d{4} \d{4} \d{4}) (\S+)', b)
    assert n and n[3].replace(" ", "") == n[2] and n[4] == m[1]
    c = re.fullmatch(r"Mr\. ([A-Z][a-z]+n) ([A-Z][a-z]+) met Frau ([A-Z][a-z]+a) (\w+); Mr\. (\w+) left\. Господин ([А-Я][а-я]+н) ([А-Я][а-я]+)", found[2][0])
    assert c and c[2] == c[4] == c[5]
    assert re.fullmatch(r"SSN \d{3}-\d{2}-\d{4} IBAN DE\d\d( \d{4}){4} \d\d ip6 ([0-9a-f]{4}:){7}[0-9a-f]{4} v 3\. 10\.5\. 2001:10", found[3][0])
    assert found[4] == ("", []) and found[5] == (None, []) and found[6] == (TEXTS[6], [])
    assert found[7][0].startswith("x" * 50000 + " ") and "10.20.30.40" not in found[7][0]
    originals = ["und.34", "555-7713", "217.2.20.125", "24be6443", "380592391139", "Smith", "123-45-6789", "3704"]
    assert not any(o in (t or "") for t, _ in found.values() for o in originals)


def test_key_changes_surrogates(spark):
    assert run(spark, TEXTS[:1], key="a") == run(spark, TEXTS[:1], key="a") != run(spark, TEXTS[:1], key="b")


def test_collisions_are_resolved(spark, monkeypatch):
    real = pii.surrogate

    def poor(kind, form, attempt, key):
        """Few surrogates at first, and one that is an entity itself."""
        few = F.concat(F.lit("u"), (F.crc32(form.cast("binary")) % 3 + 1).cast("string"), F.lit("@x.org"))
        return F.when((kind == "email") & (attempt == 0), few).otherwise(real(kind, form, attempt, key))

    monkeypatch.setattr(pii, "surrogate", poor)
    mails = [f"{a}.{b}@y.org" for a in "abcdefghij" for b in range(5)] + ["u1@x.org"]
    found = run(spark, [f"mail {m} and {mails[0]}" for m in mails], key="k")
    new = [found[i][0].split()[1] for i in range(len(mails))]
    assert len(set(new)) == len(mails) and not set(new) & set(mails)
    assert {found[i][0].split()[3] for i in range(len(mails))} == {new[0]}


def test_collisions_without_end_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(pii, "surrogate", lambda kind, form, attempt, key: F.lit("same@x.org"))
    monkeypatch.setattr(pii, "ROUNDS", 2)
    with pytest.raises(RuntimeError, match="still collide"):
        run(spark, ["a@y.org and b@y.org"], key="k")


def test_names_in_capitals_and_with_apostrophes(spark):
    texts = ["Mr. JOHN SMITH left. SMITH came, John too.", "Dr. O'Brien and Mrs. Ann O’Hara-Lee; O'Brien", "Ms. McDonald, Herr MÜLLER", "Dr. A, Mr. x"]
    found = run(spark, texts, key="k")
    m = re.fullmatch(r"Mr\. ([A-Z]+) ([A-Z]+) left\. ([A-Z]+) came, John too\.", found[0][0])
    assert m and m[2] == m[3] and "SMITH" not in found[0][0] and "JOHN" not in found[0][0]
    m = re.fullmatch(r"Dr\. ([A-Z][a-z]+) and Mrs\. ([A-Z][a-z]+) ([A-Z][a-z]+); ([A-Z][a-z]+)", found[1][0])
    assert m and m[1] == m[4] and "Brien" not in found[1][0] and "Hara" not in found[1][0]
    assert re.fullmatch(r"Ms\. [A-Z][a-z]+, Herr [A-Z]+", found[2][0]) and "Mc" not in found[2][0] and "LLER" not in found[2][0]
    assert found[3] == (texts[3], [])


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "mail a@b.org"), (1, "mail a@b.org"), (1, "mail a@b.org"), (None, None), (2, "")]
    found = pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    assert len(found) == 5 and len({r["text"] for r in found if r["text"]}) == 1 and sum(r["text"] is None for r in found) == 1


def test_many_short_numbers_stay_distinct(spark):
    """All 10,000 ends of one exchange and more: brute-force comparison of all surrogates."""
    phones = [f"555-{a}{b:04d}" for a in ("123-", "124-") for b in range(0, 10_000, 9)]
    phones += [f"020 7946 {b:04d}" for b in range(0, 2000, 17)] + [f"+49 30 {b:06d}" for b in range(0, 5000, 31)]
    ips = [f"10.{a}.{b}.7" for a in range(20) for b in range(25)]
    ssns = [f"{a:03d}-12-{b:04d}" for a in range(1, 20) for b in range(20)]
    cards = [c + str((10 - check(c + "0")) % 10) for c in (f"4{i:014d}" for i in range(400))]
    for group in (phones, ips, ssns, cards):
        df = spark.createDataFrame([(i, f"see {x}!") for i, x in enumerate(group)], "doc_id long, text string")
        rows = pii.pseudonymize(df, "k").orderBy("doc_id").collect()
        new = [r["text"][4:-1] for r in rows]
        assert all(len(r["pii_kinds"]) == 1 for r in rows), [g for g, r in zip(group, rows) if not r["pii_kinds"]][:3]
        assert len(set(new)) == len(set(group)) and sum(a == b for a, b in zip(new, group)) <= 1
        if group is not ips:
            assert all(re.sub(r"[0-9]", "0", a) == re.sub(r"[0-9]", "0", b) for a, b in zip(new, group))
        if group is cards:
            assert all(check(x) == 0 and x[0] == "4" for x in new)
        if group is ips:
            assert all(all(0 <= int(o) <= 255 for o in x.split(".")) for x in new)


def check(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def test_later_mentions_follow_the_name(spark):
    text = "Mr. John Smith met Anna. Smith left, and John Smith wrote to Anna Kowalska. Smithson stays; mail smith@x.org, Smith@x.org."
    new, kinds = run(spark, [text, "Smith alone stays", "Prof. Dr. Maria Weiß-Groß; Weiß-Groß, Weiß and Maria", "Dr. Ada"], key="k")[0]
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Anna\. (\w+) left, and (\w+) (\w+) wrote to Anna Kowalska\. Smithson stays; mail (\S+), (\S+)\.", new)
    assert m and m[2] == m[3] == m[5] and m[1] == m[4] and "Smith " not in new and m[6] == m[7].lower() and kinds == ["name", "email", "email"]
    found = run(spark, [text, "Smith alone stays", "Prof. Dr. Maria Weiß-Groß; Weiß-Groß, Weiß and Maria", "Dr. Ada"], key="k")
    assert found[1] == ("Smith alone stays", [])
    m = re.fullmatch(r"Prof\. Dr\. (\w+e) (\w+); (\w+), Weiß and (\w+)", found[2][0])
    assert m and m[2] == m[3] and m[1] == m[4]
    assert re.fullmatch(r"Dr\. [A-Z]\w+", found[3][0]) and found[3][0] != "Dr. Ada"


def test_more_forms(spark):
    texts = ["2001:db8::1 and fe80::1:2", "020 7946 0958 or 01 23 45 67 89", "on 01.02.2020 at 12:30, std::vector, 1694893019727317", "v0.12.34 2020-01-02 10:11:12 100.200"]
    found = run(spark, texts, key="k")
    assert found[0][1] == ["ipv6", "ipv6"] and re.fullmatch(r"\d{4}:[a-f]{2}\d::\d and [a-f]{2}\d\d::\d:\d", found[0][0])
    assert found[1][1] == ["phone", "phone"] and re.fullmatch(r"\d{3} \d{4} \d{4} or \d\d \d\d \d\d \d\d \d\d", found[1][0])
    assert found[2] == (texts[2], []) and found[3] == (texts[3], [])


def test_key_comes_from_the_session_or_is_drawn(spark):
    assert run(spark, TEXTS[:1]) != run(spark, TEXTS[:1])
    spark.conf.set("lectern.pii.key", "mine")
    try:
        assert run(spark, TEXTS[:1]) == run(spark, TEXTS[:1], key="mine")
    finally:
        spark.conf.unset("lectern.pii.key")


def test_native_and_empty(spark):
    df = spark.createDataFrame([(1, TEXTS[0])], "doc_id long, text string")
    plan = pii.pseudonymize(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert pii.pseudonymize(df.where("false")).count() == 0
