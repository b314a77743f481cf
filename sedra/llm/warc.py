"""WARC archives: writing with Spark's text writer, reading back with boundary-chain verification.

Archives are uncompressed; WARC/1.1 is written, 1.0 is read too. They are read in
splits, at every magic string: what lies between two magics is a segment. A segment that opens with a record header
is a candidate, and its Content-Length points to its successor. Magics also occur in
payloads, so candidates are only trusted if a chain from the start of the file
reaches them: pointers are jumped, doubling, in blocks of each file and then from
block to block. Records whose payload holds magics span several segments, which are
joined again by the record they belong to.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import scratch_path, written

MAGIC, TRAILER = "WARC/1.1\r\n", "\r\n\r\n"
#: What the versions' magics have in common, where archives are cut into segments.
CUT = "WARC/1."
DATE = "2000-01-01T00:00:00Z"  # a fixed value, so that archives of equal pages are equal


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) with payload, digest and original, the largest page_id of those with this payload.

    original is null where the payload is smaller than least_bytes or shared by no
    other row. Shared digests are counted partially before the shuffle, and only
    they are joined back, so that a payload of a third of all pages is one row there.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    shared = pages.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("original")).where("n > 1")
    return pages.join(written(shared.select("digest", "original"), "shared"), "digest", "left")


def records(pages: DataFrame) -> DataFrame:
    """with_originals() -> `record`, one WARC record per row without its trailer.

    Responses hold an HTTP response with the payload; revisits hold its head alone
    and name the record they refer to. A row whose id is the original's is a
    response, also when it is repeated.
    """
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(TRAILER))
    body = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20")
    return pages.withColumn("revisit", revisit).select(
        F.concat(
            F.lit(MAGIC),
            line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", name(F.col("page_id"))),
            line("WARC-Date", F.lit(DATE)),
            F.when(url == "", F.lit("")).otherwise(line("WARC-Target-URI", url)),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", name(F.col("original"))))).otherwise(F.lit("")),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", F.octet_length(body).cast("string")),
            F.lit("\r\n"),
            body,
        ).alias("record")
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archives of all pages under path, one file per task, by any file system Spark writes to."""
    records(with_originals(pages, least_bytes)).write.option("lineSep", TRAILER).text(path)


_HEADER = re.compile(rb"[01]\r\n((?:[A-Za-z-]+: [^\r\n]*\r\n)+)\r\n")
SEGMENTS = "file long, split long, at long, size long, next long, type string, id string, refers string, claimed string, payload_bytes long, digest string"


def _block(header: bytes, block: bytes) -> tuple[int, str]:
    """Length and digest of the payload of a record's block."""
    if b"application/http" in header:
        block = block.partition(b"\r\n\r\n")[2]
    return len(block), base64.b32encode(hashlib.sha1(block).digest()).decode()


def _field(header: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?m)^" + name + rb": ([^\r\n]*)", header)
    return m[1].decode("utf-8", "replace") if m else None


def _read(spark: SparkSession, path: str) -> DataFrame:
    """Segments as text rows, in order within each split; files go by a 64-bit hash of their path."""
    lines = spark.read.option("lineSep", CUT).text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    """(file, split, offset within the rows of the split, segment)."""
    now, at = None, 0
    for batch in batches:
        for file, split, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if (file, split) != now:
                now, at = (file, split), 0
            data = value.as_py() or b""
            yield file, split, at, data
            at += len(data) + len(CUT)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per segment; `next`: bytes from its start to the start of its successor, where it opens with a header."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    rows = []
    for file, split, at, data in _positions(batches):
        row = [file, split, at, len(data), None, None, None, None, None, None, None]
        if (m := _HEADER.match(data)) and (length := _field(m[1], b"Content-Length")) and length.isdigit():
            end = m.end() + int(length)
            row[4:9] = [end + len(TRAILER), _field(m[1], b"WARC-Type"), _field(m[1], b"WARC-Record-ID"), _field(m[1], b"WARC-Refers-To"), _field(m[1], b"WARC-Payload-Digest")]
            if end <= len(data):
                row[9:] = _block(m[1], data[m.end() : end])
        rows.append(row)
        if len(rows) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _jumped(at: np.ndarray, to: np.ndarray, end: int) -> np.ndarray:
    """Per candidate, the first place at or after `end` that its chain reaches, or -1 where the chain breaks before."""
    spot = np.searchsorted(at, to)
    known = (to < end) & (spot < len(at)) & (at[np.minimum(spot, len(at) - 1)] == to)
    jump = np.where(known, spot, np.arange(len(at)))  # candidates that leave the block, or break, stay
    while not np.array_equal(twice := jump[jump], jump):
        jump = twice
    out = to[jump]
    return np.where(out >= end, out, -1)


def reachable(candidates: DataFrame, block: int = 1 << 26) -> DataFrame:
    """candidates(file, at, to) -> (file, at) of those that a chain from offset 0 of their file reaches.

    Candidates of one block of a file, a bounded number, jump in one task to the
    place where they leave the block; then the places entered are found by
    doubling from block to block, and last the candidates passed on the way.
    """
    candidates = candidates.withColumn("block", F.floor(F.col("at") / block))
    blocks = candidates.agg(F.max("block")).first()[0] or 0

    def leave(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at", ignore_index=True)
        out = _jumped(frame["at"].to_numpy(), frame["to"].to_numpy(), (int(key[1]) + 1) * block)
        return pd.DataFrame({"file": key[0], "at": frame["at"], "out": out})

    entered = candidates.where("at = 0").select("file", "at")
    if blocks:
        jumps = written(candidates.groupBy("file", "block").applyInPandas(leave, "file long, at long, out long").where("out >= 0"), "jumps")
        reach = 1
        while True:
            step = entered.join(jumps, ["file", "at"]).select("file", F.col("out").alias("at"))
            entered = written(entered.union(step).distinct(), "entered")
            if reach > blocks:
                break
            far = jumps.select("file", F.col("at").alias("out"), F.col("out").alias("beyond"))
            jumps = written(jumps.join(far, ["file", "out"]).select("file", "at", F.col("beyond").alias("out")), "jumps")
            reach *= 2
    marked = candidates.join(entered.withColumn("enters", F.lit(True)), ["file", "at"], "left")

    def passed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at", ignore_index=True)
        at, to = frame["at"].to_numpy(), frame["to"].to_numpy()
        on = frame["enters"].notna().to_numpy().copy()
        spot = np.searchsorted(at, to)
        jump = np.where((spot < len(at)) & (at[np.minimum(spot, len(at) - 1)] == to), spot, len(at))
        jump = np.append(jump, len(at))
        on = np.append(on, False)
        while (jump[:-1] < len(at)).any():  # who is on the chain passes it on, twice as far each time
            new = on.copy()
            new[jump[on]] = True
            new[-1] = False
            on, jump = new, jump[jump]
        return pd.DataFrame({"file": key[0], "at": at[on[:-1]]})

    return marked.groupBy("file", "block").applyInPandas(passed, "file long, at long")


def _unreached(segments: DataFrame, candidates: DataFrame, chain: DataFrame) -> DataFrame:
    """(file, bytes): how much of each file lies behind the end of its chain, or is missing before it."""
    sizes = segments.groupBy("file").agg((F.sum(F.col("size") + len(CUT)) - len(CUT)).alias("all"))
    ends = candidates.join(chain, ["file", "at"]).groupBy("file").agg(F.max("to").alias("end"))
    return sizes.join(ends, "file", "left").select("file", F.abs(F.col("all") - F.coalesce("end", F.lit(0))).alias("bytes")).where("bytes > 0")


def read_archives(spark: SparkSession, path: str, block: int = 1 << 26, strict: bool = True) -> DataFrame:
    """One row per record: record_type, record_id, refers_to_id, payload_bytes, payload_digest of its own block, claimed_digest.

    Magic strings in payloads make no records. Where a chain breaks before the end of
    its file (a truncated or foreign file), this raises with the bytes not reached;
    with strict=False the file's records end there, and a truncated one has what
    there is of it.
    """
    segments = written(_read(spark, path).mapInArrow(_segments, SEGMENTS), "segments")
    # The text before the first magic of a file is no segment's; a segment at x follows the magic at x - len(CUT).
    placed = segments.join(_bases(segments), ["file", "split"]).withColumn("at", F.col("base") + F.col("at") - len(CUT)).where("at >= 0")
    candidates = placed.where("next is not null").select("file", "at", (F.col("at") + len(CUT) + F.col("next")).alias("to"))
    chain = written(reachable(candidates, block), "chain")
    if strict and (lost := _unreached(segments, candidates, chain).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")).first()).files:
        raise ValueError(f"{lost.bytes} bytes of {lost.files} files are behind the end of their records' chain, or missing before it")
    found = placed.join(chain, ["file", "at"])
    columns = ["type", "id", "refers", "claimed", "payload_bytes", "digest"]
    whole = written(found.select("file", "at", F.col("next"), *columns), "records")
    broken = whole.where("digest is null")
    if not broken.isEmpty():
        whole = whole.where("digest is not null").select(*columns).unionByName(_reassembled(spark, path, placed, chain, broken).select(*columns))
    return whole.select(F.col("type").alias("record_type"), F.col("id").alias("record_id"), F.col("refers").alias("refers_to_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.substring_index("claimed", ":", -1).alias("claimed_digest"))


def _bases(segments: DataFrame) -> DataFrame:
    """(file, split, base) of segments with file, split and size: where the rows of each split begin; one row per split."""
    sizes = segments.groupBy("file", "split").agg(F.sum(F.col("size") + len(CUT)).alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("file").orderBy("split")) - F.col("bytes")
    return written(sizes.select("file", "split", before.alias("base")), "bases")


def _reassembled(spark: SparkSession, path: str, placed: DataFrame, chain: DataFrame, broken: DataFrame) -> DataFrame:
    """Records whose payload holds magics: their segments, found by the last chain member before each, joined in order.

    Spark cuts files by the cores it has at the moment, so the second reading may
    have other splits than the first. Its segments are written with their splits,
    and placed by what that one reading saw.
    """
    by_place = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owners = placed.select("file", "at").join(chain.withColumn("owner", F.col("at")), ["file", "at"], "left")
    owners = owners.withColumn("owner", F.last("owner", True).over(by_place))
    parts = written(owners.join(broken.select("file", F.col("at").alias("owner")), ["file", "owner"], "left_semi"), "parts")

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, split, at, data in _positions(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([split], pa.int64()), pa.array([at], pa.int64()), pa.array([data], pa.binary())], names=["file", "split", "near", "data"])

    files = written(broken.select("file").distinct(), "files")
    rows = _read(spark, path).mapInArrow(bodies, "file long, split long, near long, data binary").join(files, "file", "left_semi")
    rows = written(rows.withColumn("size", F.octet_length("data")), "bodies")
    rows = rows.join(_bases(rows), ["file", "split"]).withColumn("at", F.col("base") + F.col("near") - len(CUT)).join(parts.select("file", "at", "owner"), ["file", "at"])

    def join(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        data = CUT.encode().join(frame.sort_values("at")["data"])
        m = _HEADER.match(data)
        length = int(_field(m[1], b"Content-Length"))
        size, digest = _block(m[1], data[m.end() : m.end() + length])
        return pd.DataFrame({"file": [key[0]], "at": [key[1]], "payload_bytes": [size], "digest": [digest]})

    joined = rows.groupBy("file", "owner").applyInPandas(join, "file long, at long, payload_bytes long, digest string")
    return broken.drop("payload_bytes", "digest").join(joined, ["file", "at"])


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, null url has no target line, null ids are
    written as none and read as null (the least of all). Repeated rows with the
    largest id of their payload are responses each. A revisit's payload is that of
    the response it refers to, which is joined by id; the digest is recomputed
    from the bytes read for responses. An empty table gives an empty table.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, least_bytes)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as bigint)")
    found = read_archives(spark, path).select(number("record_id").alias("page_id"), number("refers_to_id").alias("refers_to"), "record_type", "payload_bytes", "payload_digest", "claimed_digest")
    found = written(found, "found")
    targets = found.where("record_type = 'revisit'").select(F.col("refers_to").alias("wanted")).distinct()
    full = found.where("record_type = 'response'").join(targets, F.col("page_id") == F.col("wanted"), "left_semi").dropDuplicates(["page_id", "payload_digest"]).select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("claimed_digest"), F.col("payload_bytes").alias("full_bytes"))
    full = written(full, "originals")
    revisits = found.where("record_type = 'revisit'").join(full, ["refers_to", "claimed_digest"], "left").select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("claimed_digest").alias("payload_digest"), "record_type", "refers_to")
    return found.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(revisits)
