"""Encoding of the whole corpus with a public byte-level BPE tokenizer (problem 6).

A text is split by the tokenizer's pattern; each piece's bytes are merged with a segment tree over byte positions that
stores the leftmost minimum pair rank. A merge is three point updates on live neighbours, each logarithmic in the
piece's length, so even a piece of a million letters ends. Pieces seen before are remembered, up to a bound.

Defined ids: null and empty texts both have the empty list.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the tokenizer's public split pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: the leftmost pair of lowest rank is merged until no pair has a rank."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    width = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * width)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    after = [*range(1, n), -1]
    get = ranks.get
    for i in range(n - 1):
        if (rank := get(piece[i : i + 2])) is not None:
            tree[width + i] = rank << 32 | i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                break
            tree[k] = least
            k >>= 1

    def pair(i: int) -> int:
        j = after[i]
        if j < 0 or (rank := get(piece[i : end[j]])) is None:
            return _NONE
        return rank << 32 | i

    while (top := tree[1]) != _NONE:
        i = top & 0xFFFFFFFF
        j = after[i]
        end[i], after[i] = end[j], after[j]
        if after[j] >= 0:
            before[after[j]] = i
        put(j, _NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    ids, i = [], 0
    while i >= 0:
        ids.append(ranks[piece[i : end[i]]])
        i = after[i]
    return ids


class Encoder(dict):
    """Piece -> its ids, remembered for pieces of up to 64 characters; forgets all when it has grown too large."""

    MOST = 300_000

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        super().__init__()
        self.ranks, self.split = ranks, regex.compile(pattern).findall

    def __missing__(self, piece: str) -> array:
        ids = array("i", merge_piece(piece.encode(), self.ranks))
        if len(piece) <= 64:
            if len(self) >= self.MOST:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> array:
        out = array("i")
        for piece in self.split(text or ""):
            out += self[piece]
        return out


def encode_texts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(id, ids) of every row, in one pass without shuffle; repeated rows stay repeated, null ids stay null.

    The vocabulary (a fixed file of about 50,000 tokens) is read once on the driver and broadcast.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat, ends = array("i"), [0]
                for text in part.column(1).to_pylist():
                    flat += encoder.encode(text)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["id", "ids"])

    kind = dict(df.select(F.col(id_col).alias("id")).dtypes)["id"]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
