"""Texts dealt into buckets by the rarest of their word triples (problems 1 and 5).

A text's entries are the triples of its prefix (see words.prefix_order), each with the text's name, its number of triples
and its 256-bit parity sketch. They are dealt into buckets that a task holds as arrays. No more than PASS entries are in
the shuffle at once, and above LITTLE they come in two to four passes: what a pass shuffled is dropped before the next one
begins, so the disk that it takes is bounded, while the staged prefixes are read once a pass.

The lowest bit of a triple's number is 1 for triples of very many texts, which are dealt into parts by text.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.words import merged_table, window_hashes

#: Entries of a pass, at about 50 bytes, and of a bucket.
PASS = 100_000_000
LITTLE = 1_500_000
BUCKET = 500_000
ENTRY = np.dtype([("shard", "<u8"), ("rec", "<i8"), ("n", "<i4"), ("side", "<i4"), ("sketch", "<u8", (4,))])
PREFIXES = "rec long, side int, n int, sketch binary, prefix binary"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def flat(symbols: list[bytes], seeds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text, windows) of many texts at once: the triple hashes of all in order, the text each is of, and how many
    each text has. Every text has three symbols or more."""
    sizes = np.fromiter((len(p) >> 2 for p in symbols), np.int64, len(symbols))
    text = np.repeat(np.arange(len(symbols)), sizes)
    inside = text[2:] == text[:-2]
    text, hashes = text[:-2][inside], window_hashes(np.frombuffer(b"".join(symbols), np.uint32))[inside]
    return (hashes if seeds is None else hashes ^ seeds[text]), text, sizes - 2


def distinct(hashes: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text, n): each text's triples once, sorted, and how many each text has."""
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[first], text[first], np.bincount(text[first], minlength=texts)


def power(least: int, wanted: float, most: int) -> int:
    """The smallest power of two not under `wanted`, between two others."""
    return min(most, max(least, 1 << max(0, int(wanted) - 1).bit_length()))


def count_table(texts: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], counters: int) -> np.ndarray:
    """Hashed counts of the triples of all texts, up to 65535; they only order the triples."""
    mask = np.uint64(counters - 1)

    def fill(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> None:
        counts = table.view(np.uint16)
        for batch in batches:
            if batch.num_rows:
                where, n = np.unique((hashes(batch) & mask).astype(np.int64), return_counts=True)
                counts[where] = np.minimum(counts[where].astype(np.int64) + n, 65535)

    return merged_table(texts, fill, 2 * counters, "add16").view(np.uint16)


def rarest(h: np.ndarray, text: np.ndarray, n: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts): where each text's rarest half plus one are among the distinct triples of texts (see `distinct`),
    and the hashed counts of all of these."""
    counts = table[(h & np.uint64(len(table) - 1)).astype(np.int64)]
    order = np.lexsort((h, counts, text))
    starts = np.cumsum(n) - n
    return order[np.arange(len(h)) - starts[text] < n[text] // 2 + 1], counts


def prefixes(h: np.ndarray, text: np.ndarray, n: np.ndarray, table: np.ndarray, keep: Callable[[np.ndarray], np.ndarray] | None, many: int | None) -> tuple[list[bytes], list[bytes]]:
    """(sketches, prefixes) of texts from their distinct triples: the rarest half plus one, those of them that `keep`
    keeps. Triples of `many` texts or more are marked."""
    chosen, counts = rarest(h, text, n, table)
    if keep is not None:
        chosen = chosen[keep(h[chosen])]
    marked = (h[chosen] & ~np.uint64(1)) | (np.uint64(0) if many is None else (counts[chosen] >= many).astype(np.uint64))
    ends = np.cumsum(np.bincount(text[chosen], minlength=len(n))).tolist()
    raw = marked.tobytes()
    bits = np.bincount(text * 256 + (h >> np.uint64(56)).astype(np.int64), minlength=256 * len(n)) & 1
    sketches = np.packbits(bits.astype(np.uint8).reshape(-1, 256), axis=1)
    return [r.tobytes() for r in sketches], [raw[8 * a : 8 * b] for a, b in zip([0, *ends], ends)]


def entries(batch: pa.RecordBatch) -> np.ndarray:
    """The entries of a batch of PREFIXES."""
    rec, side, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:3])
    parts = batch.column(4).to_pylist()
    sizes = np.fromiter((len(p) >> 3 for p in parts), np.int64, len(parts))
    out = np.empty(sizes.sum(), ENTRY)
    text = np.repeat(np.arange(len(parts)), sizes)
    out["shard"] = np.frombuffer(b"".join(parts), np.uint64)
    out["rec"], out["side"], out["n"] = rec[text], side[text], n[text]
    out["sketch"] = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, 4)[text]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * _ODD
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def in_parts(e: np.ndarray, parts: int) -> np.ndarray:
    """The entries, those of triples of very many texts under a shard for each part: a text of side 0 is in one part, one
    of side 1 in all of them."""
    marked = e["shard"] & np.uint64(1) == 1
    if parts < 2 or not marked.any():
        return e
    one, all_ = e[marked & (e["side"] == 0)], e[marked & (e["side"] != 0)]
    of = np.concatenate([mixed(one["rec"].astype(np.uint64)) % np.uint64(parts), np.tile(np.arange(parts, dtype=np.uint64), len(all_))])
    dealt = np.concatenate([one, np.repeat(all_, parts)])
    dealt["shard"] ^= ((of + np.uint64(1)) * _ODD) << np.uint64(1)
    return np.concatenate([e[~marked], dealt])


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes shuffle files once the driver's garbage is collected; a session may wait half an hour for that."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def _dealt(prefixed: DataFrame, k: int, passes: int, buckets: int, parts: int) -> DataFrame:
    """(bucket, data): the entries of pass k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            e = np.concatenate(held)
            bucket = (mixed(e["shard"]) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            e, where = e[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            own = [b for b in range(buckets) if where[b] < where[b + 1]]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([e[where[b] : where[b + 1]].tobytes() for b in own], pa.binary())], ["bucket", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            e = entries(batch)
            if passes > 1:
                e = e[(e["shard"] >> np.uint64(40)) % np.uint64(passes) == k]
            held.append(in_parts(e, parts))
            size += len(held[-1])
            if size >= 400_000:
                yield out()
                held.clear()
                size = 0
        if size:
            yield out()

    return prefixed.mapInArrow(run, "bucket int, data binary")


def search(prefixed: DataFrame, find: Callable[[np.ndarray], Iterator[pa.RecordBatch]], schema: str, keep: Callable[[DataFrame, int], None], parts: int = 1, entries_a_pass: int = PASS, bucket: int = BUCKET) -> None:
    """Deals the prefixes pass by pass; `find` gets the entries of a bucket, `keep` what was found in a pass and its
    number, and must write it."""
    spark = prefixed.sparkSession
    total = prefixed.agg(F.sum(F.length("prefix"))).first()[0] or 0
    passes = max(1, -(-(total // 8) // entries_a_pass), min(4, -(-(total // 8) // LITTLE)))
    buckets = max(1, -(-(total // 8) // (bucket * passes)), min(2 * spark.sparkContext.defaultParallelism, total // 400_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != now and held:
                    yield from find(np.concatenate(held))
                    held = []
                now = b
                held.append(np.frombuffer(data.as_buffer(), ENTRY))
        if held:
            yield from find(np.concatenate(held))

    for k in range(passes):
        dealt = _dealt(prefixed, k, passes, buckets, parts)
        keep(dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema), k)
        if passes > 1:
            del dealt
            free_shuffles(spark)


def close(e: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which entries i and j are within the radius: no near pair is beyond it."""
    n, m = e["n"][i], e["n"][j]
    d = np.bitwise_count(e["sketch"][i] ^ e["sketch"][j]).sum(axis=1, dtype=np.int32)
    return (3 * d <= n + m) & (n <= 2 * m) & (m <= 2 * n)


def node_bits(pairs: DataFrame, columns: tuple[str, ...] = ("a", "b")) -> np.ndarray:
    """A bit table of the texts that are in pairs."""
    size = power(1 << 16, 16 * pairs.count(), 1 << 28)

    def fill(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> None:
        for batch in batches:
            for c in batch.columns:
                set_bits(table, c.to_numpy(zero_copy_only=False))

    return merged_table(pairs.select(*columns), fill, size >> 3, "or")


def set_bits(table: np.ndarray, recs: np.ndarray) -> None:
    slot = (mixed(recs.astype(np.uint64)) & np.uint64(8 * len(table) - 1)).astype(np.int64)
    np.bitwise_or.at(table, slot >> 3, (1 << (slot & 7)).astype(np.uint8))


def in_bits(table: np.ndarray, recs: np.ndarray) -> np.ndarray:
    slot = (mixed(recs.astype(np.uint64)) & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
