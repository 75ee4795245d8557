"""Words, word triples and their hashed forms, and fixed-size tables of hashed counts.

A text's words are the maximal runs of letters and digits of its NFKC form in lower case; its triples are the set of
its three consecutive words. Two texts are near when they share at least half of the triples that either has. A text
without triples (null, blank, fewer than three words) is near to nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

_WORD = re.compile(r"[^\W_]+")
#: ASCII letters in lower case and digits stay, all else is a blank.
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_ASCII).decode().split()
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower())


class Symbols(dict):
    """Word -> 32-bit symbol, remembered; forgets all when it has grown too large."""

    MOST = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = symbol = xxhash.xxh32_intdigest(word)
        return symbol

    def of(self, text: str | None) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.__getitem__, found), np.uint32, len(found))


def window_hashes(symbols: np.ndarray, width: int = 3) -> np.ndarray:
    """A 64-bit hash of every window of so many symbols, in order."""
    if len(symbols) < width:
        return np.empty(0, np.uint64)
    wide = symbols.astype(np.uint64)
    n = len(wide) - width + 1
    h = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(width):
        h ^= wide[k : k + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def triples(symbols: np.ndarray) -> np.ndarray:
    """The sorted distinct hashes of the triples."""
    return np.unique(window_hashes(symbols))


def near_from_counts(common: int, n: int, m: int) -> bool:
    """Common triples are at least half of the union: 2c >= n + m - c."""
    return common > 0 and 3 * common >= n + m


def prefix_order(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The hashes that must hold one shared with any near text: the first half plus one, rarest by hashed count first.

    Any order common to all texts keeps this exact; the counts only decide how well it filters.
    """
    n = len(hashes)
    if not n:
        return hashes
    order = np.lexsort((hashes, counts[(hashes & np.uint64(len(counts) - 1)).astype(np.int64)]))
    return hashes[order[: n // 2 + 1]]


def parity_sketch(hashes: np.ndarray) -> bytes:
    """256 bits, each the parity of the hashes that fall on it: two sets' sketches differ in at most as many bits as
    the sets differ in members."""
    return np.packbits((np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).tobytes()


def merged_table(df: DataFrame, fill: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], size: int, how: str, chunk: int = 1 << 16) -> np.ndarray:
    """A table of `size` bytes filled by every task and merged by chunk, by saturating sum of bytes ('add') or of two bytes
    ('add16'), by 'or', or as marks of what was seen once and twice ('twice', see marks).

    Its size is fixed whatever the input, so it may be sent to the driver and broadcast.
    """
    schema = "chunk int, data binary"

    def emit(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, part in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["chunk", "data"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.uint8)
        fill(batches, own)
        yield from emit({k: own[k * chunk : (k + 1) * chunk] for k in range(-(-size // chunk)) if own[k * chunk : (k + 1) * chunk].any()})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                new = np.frombuffer(data.as_buffer(), np.uint8)
                if k not in parts:
                    parts[k] = new.copy()
                elif how == "or":
                    parts[k] |= new
                elif how == "add16":
                    wide = parts[k].view(np.uint16).astype(np.uint32) + new.view(np.uint16)
                    parts[k] = np.minimum(wide, 65535).astype(np.uint16).view(np.uint8)
                elif how == "twice":
                    parts[k] = parts[k] | new | ((parts[k] & new & 0x0F) << 4)
                else:
                    parts[k] = np.minimum(parts[k].astype(np.uint16) + new, 255).astype(np.uint8)
        yield from emit(parts)

    out = np.zeros(size, np.uint8)
    for row in df.mapInArrow(make, schema).repartition("chunk").mapInArrow(merge, schema).collect():
        out[row["chunk"] * chunk : row["chunk"] * chunk + len(row["data"])] = np.frombuffer(row["data"], np.uint8)
    return out


def add_saturating(table: np.ndarray, slots: np.ndarray) -> None:
    """Counts slots into a byte table that stops at 255."""
    where, n = np.unique(slots, return_counts=True)
    table[where] = np.minimum(table[where].astype(np.int64) + n, 255)


def marks(batches_of_slots: Iterator[np.ndarray], table: np.ndarray) -> None:
    """Marks slots seen once and those seen twice or more, four slots a byte: the low bits for once, the high for twice."""
    once, twice = np.zeros(4 * len(table), bool), np.zeros(4 * len(table), bool)
    for slots in batches_of_slots:
        where, n = np.unique(slots, return_counts=True)
        twice[where] |= once[where] | (n > 1)
        once[where] = True
    weights = np.array([1, 2, 4, 8], np.uint8)
    table[:] = once.reshape(-1, 4) @ weights + (twice.reshape(-1, 4) @ weights) * np.uint8(16)


def seen_twice(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may have been seen twice; none that was is missed."""
    slots = (hashes & np.uint64(4 * len(table) - 1)).astype(np.int64)
    return (table[slots >> 2] >> ((slots & 3) + 4).astype(np.uint8)) & 1 == 1
