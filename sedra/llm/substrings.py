"""Removal of repeated word windows by level-wise doubling.

Level by level, windows of `first` words, then of twice as many, and so on to the
full window, are looked up over the corpus, and only what is repeated at one
length is extended to the next. Below the full length each full window is stood
for by one of its shorter windows, that of least hash, which repeats wherever the
full window does; so no repeat is lost, and about one window in six is looked up.
At the full length, the least document that has a window owns it; in other
documents it goes, and in one document all but its first occurrence go. A text that
a lesser document has word for word is not looked up: all of it goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

LAST = 2**63 - 1
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Rows handed to Spark at once.
BATCH = 1 << 19


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def split_words(text: str | None) -> list[bytes]:
    """bytes.split() parts at exactly the six blanks."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def window_hashes(hashes: np.ndarray, first: int, length: int, which: int = 0) -> np.ndarray:
    """Hash of every window of `length` words: of `first` words by steps, then doubled."""
    if len(hashes) < length:
        return np.zeros(0, dtype=np.uint64)
    m = np.uint64(_MULTIPLIERS[which])
    n = len(hashes) - first + 1
    out, power = np.zeros(n, dtype=np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        source = _mixed(hashes + m) if which else hashes
        for j in range(first):
            out = out * m + source[j : j + n]
            power = power * m
        while first < length:
            out = out[:-first] * power + out[first:]
            power, first = power * power, 2 * first
    return out


def stand_ins(hashes: np.ndarray, first: int, length: int, window: int) -> np.ndarray:
    """For each full window the least mixed hash of its windows of `length` words."""
    least, wide, have = _mixed(window_hashes(hashes, first, length)), window - length + 1, 1
    while have < wide:
        step = min(have, wide - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    return least.view(np.int64)


def alive_windows(hashes: np.ndarray, first: int, window: int, survivors: list[np.ndarray]) -> np.ndarray:
    """Starts of the full windows whose stand-ins were repeated at every level looked up so far."""
    if len(hashes) < window or any(not len(kept) for kept in survivors):
        return np.zeros(0, dtype=np.int64)
    alive = np.ones(len(hashes) - window + 1, dtype=bool)
    for level, kept in enumerate(survivors):
        alive &= np.isin(stand_ins(hashes, first, first << level, window), kept)
    return np.flatnonzero(alive)


def _cell(column: pa.Array, i: int):
    """A value; lists of longs as numpy arrays, null ones as empty arrays."""
    if pa.types.is_list(column.type):
        return column[i].values.to_numpy(zero_copy_only=False) if column[i].is_valid else np.zeros(0, dtype=np.int64)
    return column[i].as_py()


def _flat(batches: Iterator[pa.RecordBatch], rows_of, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """rows_of(row of a batch) -> numpy columns; gives them on in batches of bounded size."""
    held, size = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            if columns := rows_of([_cell(c, i) for c in batch.columns]):
                held.append(columns)
                size += len(columns[-1])
            if size > BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], schema=schema)
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], schema=schema)


def _looked_up(texts: DataFrame, first: int, length: int, window: int, levels: int) -> DataFrame:
    """(doc, gram): the stand-ins of `length` words of the windows still alive, each once per row."""
    schema = pa.schema([("doc", pa.int64()), ("gram", pa.int64())])

    def rows(row: list):
        hashes = word_hashes(split_words(row[1]))
        if len(hashes) < window:
            return None
        at = alive_windows(hashes, first, window, row[2 : 2 + levels])
        grams = np.unique(stand_ins(hashes, first, length, window)[at])
        return [np.full(len(grams), row[0], dtype=np.int64), grams]

    return texts.mapInArrow(lambda b: _flat(b, rows, schema), "doc long, gram long")


def _full(texts: DataFrame, first: int, window: int, levels: int) -> DataFrame:
    """(doc, h1, h2): full windows alive, each once per row."""
    schema = pa.schema([("doc", pa.int64()), ("h1", pa.int64()), ("h2", pa.int32())])

    def rows(row: list):
        hashes = word_hashes(split_words(row[1]))
        at = alive_windows(hashes, first, window, row[2 : 2 + levels])
        if not len(at):
            return None
        h1, one = np.unique(window_hashes(hashes, first, window)[at].view(np.int64), return_index=True)
        h2 = (window_hashes(hashes, first, window, 1)[at[one]] >> np.uint64(33)).astype(np.int32)
        return [np.full(len(one), row[0], dtype=np.int64), h1, h2]

    return texts.mapInArrow(lambda b: _flat(b, rows, schema), "doc long, h1 long, h2 int")


def copied_texts(texts: DataFrame) -> DataFrame:
    """(doc, copied): digests of the texts of a document that a lesser document has too."""
    marks = written(texts.select("doc", F.md5(F.coalesce("body", F.lit("")).cast("binary")).alias("digest")), "digests")
    # written, so that the join deals both sides anew and can split a digest of many copies
    least = written(marks.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("least")).where("n > 1").select("digest", "least"), "least")
    return written(marks.join(least, "digest").where("doc > least").groupBy("doc").agg(F.collect_set("digest").alias("copied")), "copied")


def removed_words(hashes: np.ndarray, first: int, window: int, survivors: list[np.ndarray], owned: np.ndarray) -> np.ndarray:
    """Mask of the words of one text that go; owned: hashes of the windows that its document owns."""
    n = len(hashes) - window + 1
    gone = np.zeros(len(hashes) + 1, dtype=np.int64)
    if n < 1:
        return gone[:-1] > 0
    h1 = window_hashes(hashes, first, window).view(np.int64)
    again = np.zeros(n, dtype=bool)
    ordered = np.sort(h1)
    if (ordered[1:] == ordered[:-1]).any():
        again[:] = True
        again[np.unique(h1, return_index=True)[1]] = False
    at = alive_windows(hashes, first, window, survivors)
    again[at[~np.isin(h1[at], owned)]] = True
    starts = np.flatnonzero(again)
    if not len(starts):
        return gone[:-1] > 0
    np.add.at(gone, starts, 1)
    np.add.at(gone, starts + window, -1)
    return np.cumsum(gone)[:-1] > 0


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", first: int = 10, window: int = 20) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the kept words joined by a space).

    window must be first * 2^k. Null texts have no words. Null ids rank last, in the
    order of a hash of the text; those of equal texts are one document, so that no
    document gathers all of them (ids of 2^63 - 2^60 or more would mix with them).
    Rows with one id are one document and don't remove each other's words: what
    comes back to a document is bounded by its own length. Windows are compared by
    64 bits of hash within a text, and by 95 for who owns them; texts by MD5. Grams
    and windows are counted partially before every shuffle.
    """
    levels = (window // first).bit_length() - 1
    if first << levels != window or levels < 1:
        raise ValueError("window must be first * 2^k with k >= 1")
    nameless = F.lit(LAST) - F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col(text)), 4)
    texts = docs.select(F.coalesce(F.col(doc_id).cast("long"), nameless).alias("doc"), F.col(text).alias("body"), F.col(doc_id).alias("doc_id"))
    known = []
    for level in range(levels):
        told = texts.select("doc", "body")
        for i, table in enumerate(known):
            told = told.join(table.withColumnRenamed("grams", f"g{i}"), "doc")
        grams = _looked_up(told, first, first << level, window, level)
        # within one row each gram is listed once: a count above one is another row
        repeated = written(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "repeated")
        known.append(written(grams.join(repeated, "gram").groupBy("doc").agg(F.collect_set("gram").alias("grams")), "grams"))

    told = texts.join(copied_texts(texts), "doc", "left")
    for i, table in enumerate(known):
        told = told.join(table.withColumnRenamed("grams", f"g{i}"), "doc", "left")
    gs = [f"g{i}" for i in range(levels)]
    copy = F.coalesce(F.array_contains("copied", F.md5(F.coalesce("body", F.lit("")).cast("binary"))), F.lit(False))
    told = told.withColumn("copy", copy)
    full = _full(told.where(F.col(gs[-1]).isNotNull() & ~F.col("copy")).select("doc", "body", *gs), first, window, levels)
    owner = full.groupBy("h1", "h2").agg(F.min("doc").alias("doc"))
    owned = owner.groupBy("doc").agg(F.collect_list("h1").alias("owned"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_removed", "kept"]
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                ident, body, copy, have, *grams = (_cell(c, i) for c in batch.columns)
                words = split_words(body)
                gone = np.full(len(words), len(words) >= window) if copy else removed_words(word_hashes(words), first, window, grams, have)
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words)
                rows.append((ident, len(words), int(gone.sum()), kept.decode("utf-8", "replace")))
                size += len(kept)
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    out = told.join(owned, "doc", "left").select(F.col("doc_id").cast("long"), "body", "copy", "owned", *gs)
    return out.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept string")
