import base64
import hashlib
import io
import os
import zlib

from pyspark.sql import functions as F

from lectern.llm import warc

ROWS = [(5, "http://a", "same"), (2, "http://b", "same"), (9, None, None), (7, "http://c\r\nX: y", ""), (3, "u", "été " * 5000), (4, "u", "only"), (4, "u", "only"), (None, "n", "same"), (-1, "m", "neg")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("member", F.lit(1)).withColumn("sha", F.lit("x"))


def expected(rows):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[digest(h)] = min(i, first.get(digest(h), i))
    out = []
    for i, _, h in rows:
        lead = first.get(digest(h))
        own = lead is None or i == lead
        out.append((i, len((h or "").encode()), digest(h), "response" if own else "revisit", None if own else lead))
    return sorted(out, key=str)


def test_round_trip(spark):
    found = [tuple(r) for r in warc.round_trip(pages(spark)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(found, key=str) == expected(ROWS)


def test_many_repeated_payloads_are_joined_by_digest(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    rows = ROWS + [(100 + i, "u", "hot") for i in range(3000)]
    files = warc.write_archives(pages(spark, rows), folder, broadcast_rows=0)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = files.cache()
    kinds = {r["record_type"]: r["count"] for r in warc.read_archives(spark, files, payloads=False).groupBy("record_type").count().collect()}
    want = expected(rows)
    assert kinds == {k: sum(w[3] == k for w in want) for k in ("response", "revisit")}


def test_ranges_are_read_in_parallel(spark):
    files = spark.createDataFrame([("file:///none", 40 * 100)], "file string, size long").coalesce(1)
    read = warc.read_archives(spark, files, range_bytes=100)
    assert read.rdd.getNumPartitions() == 32  # 40 ranges, at most eight for each of four cores


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_any_range_gives_each_record_once(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    files = warc.write_archives(pages(spark).coalesce(1), folder).collect()
    path = files[0]["file"].removeprefix("file://")
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        whole = [r.offset for r in warc.records_in_range(f, 0, size)]
        for step in (1, 7, 100, 1000, size):
            if step == 1 and size > 5000:
                continue
            assert [r.offset for s in range(0, size, step) for r in warc.records_in_range(f, s, min(s + step, size))] == whole
    assert sum(f["records"] for f in files) == len(ROWS)
    read = warc.read_archives(spark, spark.createDataFrame([(r["file"], r["size"]) for r in files], "file string, size long"), range_bytes=64)
    assert read.count() == len(ROWS)
    assert read.where("payload_bytes > 5000").first()["payload"].decode() == "été " * 5000


def test_long_headers_of_plain_archives():
    one = zlib.decompress(warc.response_member(1, "http://x/" + "y" * 300_000, b"body", "d", "2000-01-01T00:00:00Z"), 31)
    data = one + one
    assert [r.payload for r in warc.records_in_range(io.BytesIO(data), 0, len(data))] == [b"body", b"body"]


def test_false_members_and_plain_archives():
    fake = zlib.compressobj(9, zlib.DEFLATED, 31)
    gz = fake.compress(b"no record") + fake.flush()
    one = warc.response_member(1, "u", b"x" + gz + warc.MAGIC, "d", "2000-01-01T00:00:00Z")
    data = one + gz + warc.response_member(2, "u", b"y", "d", "2000-01-01T00:00:00Z")
    found = [r for s in range(0, len(data), 50) for r in warc.records_in_range(io.BytesIO(data), s, min(s + 50, len(data)))]
    assert [r.headers["warc-record-id"] for r in found] == ["<urn:x-page:1>", "<urn:x-page:2>"] and found[0].payload == b"x" + gz + warc.MAGIC
    plain = b"".join(zlib.decompress(m, 31) for m in (one, warc.response_member(2, "u", b"WARC/1.0\r\nfake", "d", "2000-01-01T00:00:00Z")))
    found = list(warc.records_in_range(io.BytesIO(plain), 0, len(plain)))
    assert len(found) == 2 and found[1].payload == b"WARC/1.0\r\nfake"
