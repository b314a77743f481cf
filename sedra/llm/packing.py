"""Packing token ids into fixed sequences by first-fit decreasing.

Documents are cut into full sequences and a rest. Rests are dealt to random groups
of documents; in each group, longest first, a rest goes to the first bin with room,
which a tournament tree of bin capacities finds in logarithmic time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import groups_for, written

SEQUENCE, END = 2048, 1
#: A text with this string is encoded by the tokenizer file itself, for which it is one special token.
SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _encoder(path: str, ranks_path: str):
    """Text -> ids of the tokenizer file.

    The rank file is the same vocabulary for a faster library, which gives the
    same ids (tests/llm compare them over all code points) except where the text
    has a special token.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if SPECIAL in text:
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


class Tournament:
    """A max tree over bin capacities: the first bin with room for an item in O(log bins)."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.size)

    def place(self, length: int) -> int:
        tree, at = self.tree, 1
        while at < self.size:
            at *= 2
            if tree[at] < length:
                at += 1
        bin_ = at - self.size
        tree[at] -= length
        while at > 1:
            at //= 2
            left, right = tree[2 * at], tree[2 * at + 1]
            tree[at] = left if left >= right else right
        return bin_


def first_fit_decreasing(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; no item is longer than capacity. Ties go by position."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    filled: dict[int, int] = {}
    tree = Tournament(len(lengths), capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        b = tree.place(n)
        bins[i], offsets[i] = b, filled.get(b, 0)
        filled[b] = filled.get(b, 0) + n
    return bins, offsets


def _narrow(vocabulary: int) -> str:
    """The type in which ids travel: two bytes hold vocabularies of up to 65,536."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


@cache
def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def token_pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str = "byte_bpe_50k.json", sequence: int = SEQUENCE) -> DataFrame:
    """PIECES of each document: its ids and the end id, cut every `sequence` ids; ids little-endian, as _narrow() has them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, ranks = tokenizer_path(tokenizer), tokenizer_path(tokenizer.replace(".json", ".tiktoken"))  # where this task runs
        encode, kind = _encoder(path, ranks), _narrow(_vocabulary(path))
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            rows, held = [], 0
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array(encode(body.as_py() or "") + [END], dtype=kind)
                for at in range(0, len(ids), sequence):
                    piece = ids[at : at + sequence]
                    rows.append((doc, at, len(piece), len(ids), piece.tobytes()))
                    held += len(piece)
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(cut, PIECES)


def packed_sequences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str = "byte_bpe_50k.json", sequence: int = SEQUENCE, group_docs: int = 1024, seed: int = 11) -> DataFrame:
    """Pieces of all documents with their place: PIECES, sequence_id, offset.

    ids are little-endian 32-bit; they are written and shuffled in two bytes each where the vocabulary allows.
    Null and empty texts are the end id alone; null ids stay null. Repeated rows
    are separate documents. A piece of a whole sequence is a sequence by itself,
    with an odd number, and isn't shuffled. Each document's rest is dealt to a
    group by a seeded hash of id and row, so that equal ids don't meet in one
    group; a group is about group_docs rests of less than `sequence` ids each,
    however long its documents are. Sequences are padded by whoever stores them:
    their length is the sum of their pieces.
    """
    kind = _narrow(_vocabulary(tokenizer_path(tokenizer)))
    pieces = written(token_pieces(docs, text, doc_id, tokenizer, sequence), "pieces")
    rests = pieces.where(F.col("length") < sequence)
    groups = groups_for(rests.count(), group_docs)
    rests = rests.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", F.crc32("ids"), F.monotonically_increasing_id()), F.lit(groups)))

    def widened(ids: pd.Series) -> list[bytes]:
        return [np.frombuffer(x, dtype=kind).astype("<u4").tobytes() for x in ids]

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), sequence)
        _, bins = np.unique(bins, return_inverse=True)
        frame["ids"] = widened(frame["ids"])
        return frame.drop(columns="part").assign(sequence_id=2 * ((int(key[0]) << 24) + bins), offset=offsets)

    @F.pandas_udf("binary")
    def wide(ids: pd.Series) -> pd.Series:
        return pd.Series(widened(ids), dtype=object)

    whole = pieces.where(F.col("length") == sequence).withColumns({"ids": wide("ids"), "sequence_id": 2 * F.monotonically_increasing_id() + 1, "offset": F.lit(0).cast("long")})
    return whole.unionByName(rests.groupBy("part").applyInPandas(pack, f"{PIECES}, sequence_id long, offset long"))
