import base64
import hashlib
import random

import pytest
from helpers import rows

from sedra.llm import warc

EMBEDDED = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def expected(pages):
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), i if i is not None else -1)
    out = []
    for i, _, h in pages:
        body = (h or "").encode()
        same = (i if i is not None else -1) == last[h or ""]
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if same else "revisit", None if same else last[h or ""]))
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


PAGES = [(1, "http://a/ b\r\nc", "<p>one</p>"), (2, None, None), (3, "", ""), (4, "u", "<p>one</p>"), (5, "u", f"x{EMBEDDED}y{EMBEDDED}"), (6, "u", "WARC/1.1\r\n"), (7, "u", EMBEDDED), (8, "u", "é\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"), (4, "u", "<p>one</p>"), (9, "u", "z" * 300000), (10, "u", EMBEDDED), (None, None, "lone")]


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    assert rows(warc.archived(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected(PAGES)


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_splits_and_blocks(spark, tmp_path):
    """Splits fall inside records and payloads, and chains cross many blocks."""
    rng = random.Random(5)
    pages = [(i, f"u{i}", "".join(rng.choice(["abc ", "WARC/1.1\r\n", EMBEDDED, "\r\n\r\n", "é"]) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path, 0)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = rows(warc.read_archives(spark, path, block=7000).where("record_type = 'response'"), "record_id", "payload_bytes", "payload_digest")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = sorted((f"<urn:page:{r[0]}>", r[1], r[2]) for r in expected(pages) if r[3] == "response")
    assert got == want


def test_splits_that_change_between_readings(spark, tmp_path, monkeypatch):
    """The second reading, for payloads that hold magics, has other splits than the first."""
    rng = random.Random(6)
    pages = [(i, f"u{i}", "".join(rng.choice(["abc ", "WARC/1.1\r\n", EMBEDDED]) for _ in range(rng.randint(0, 40)))) for i in range(80)]
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path, 0)
    setting, sizes, read = "spark.sql.files.maxPartitionBytes", iter(["5000", "3100"]), warc._read
    old = spark.conf.get(setting)

    def other(*a):
        spark.conf.set(setting, next(sizes))
        return read(*a)

    monkeypatch.setattr(warc, "_read", other)
    try:
        got = rows(warc.read_archives(spark, path).where("record_type = 'response'"), "record_id", "payload_bytes", "payload_digest")
    finally:
        spark.conf.set(setting, old)
    assert next(sizes, None) is None
    assert got == sorted((f"<urn:page:{r[0]}>", r[1], r[2]) for r in expected(pages) if r[3] == "response")


def test_broken_chains_raise(spark, tmp_path):
    """A file cut within a record, one that is no archive, and one of the older version."""
    record = EMBEDDED.replace("999", "1")
    for name, text, count in (("cut", record + record[:-9], 1), ("foreign", "no archive at all", 0), ("more", record + "tail", 1), ("short", record + record[:-6], 2)):
        (tmp_path / name).write_bytes(text.encode())
        with pytest.raises(ValueError, match="behind the end"):
            warc.read_archives(spark, f"file://{tmp_path}/{name}")
        assert warc.read_archives(spark, f"file://{tmp_path}/{name}", strict=False).count() >= count
    (tmp_path / "old").write_bytes((record + record.replace("WARC/1.1", "WARC/1.0") + record).encode())
    got = warc.read_archives(spark, f"file://{tmp_path}/old").collect()
    assert [(r.record_id, r.payload_bytes) for r in got] == [("<urn:page:1>", 0)] * 3  # no head of HTTP in these blocks


def test_clashing_columns_and_long_pages(spark):
    pages = [(1, "u", "x" * 3_000_000), (2, "u", "x" * 3_000_000), (3, "u", ("<p>" + EMBEDDED) * 5000)]
    df = spark.createDataFrame([(*p, 1, "d", 2) for p in pages], "page_id long, url string, html string, original int, digest string, n int")
    assert rows(warc.archived(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected(pages)


def test_smaller_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    assert rows(warc.archived(df, least_bytes=5), "page_id", "record_type", "refers_to") == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


@pytest.mark.parametrize("text", ["", "abc", "é" * 100])
def test_base32(spark, text):
    from pyspark.sql import functions as F

    got = spark.range(1).select(warc.base32_sha1(F.lit(text)).alias("d")).first().d
    assert got == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
