"""Same or near-same records across splits (problem 1).

Every text sends its rarest word triples (half plus one: any near text shares one of them, see words.prefix_order), those
that bit tables of fixed size find on both sides, to the bucket of the triple, pass by pass (see dealing). There the
training and the evaluation texts under one triple compare their sketches, so no text meets all texts of the other side.
Equal texts are one text, and dealt to their records at the end.

The pairs left are checked by Aho-Corasick automata: the triples of some evaluation texts, as symbols of one character
each, are the passages of an automaton that scans the training texts paired with them. The passages found give the
triples in common and the intervals that the evaluation text shares. Neither the driver nor a broadcast holds texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import dealing
from tracewell.llm.shelf import get, put
from tracewell.llm.words import Symbols, merged_table, near_from_counts
from tracewell.session import delete_shared, shared_path, stage, unstage

#: Counters at least and at most (two bytes each), and bits for a triple of a prefix, at most so many.
COUNTERS = 1 << 21
MOST_COUNTERS = 1 << 25
MOST_BITS = 1 << 28
#: Passages of an automaton; one of so many takes about 40 MB.
PASSAGES = 200_000
PART = 500_000
#: Pairs of sketches compared at once.
AT_ONCE = 500_000


def _seeds(tbls: pa.Array) -> np.ndarray:
    return tbls.to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def encoded(records: DataFrame) -> DataFrame:
    """(tbl, rec, train, text, symbols) of the records with a text of three words or more; text names the words and the
    table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Symbols()
        for batch in batches:
            out: list[tuple] = []
            for tbl, rec, train, text in zip(*(c.to_pylist() for c in batch.columns)):
                s = table.of(text)
                if rec is not None and len(s) > 2:
                    raw = s.tobytes()
                    name = xxhash.xxh3_64_intdigest(raw, tbl)
                    out.append((tbl, rec, train, name - (1 << 64) if name >> 63 else name, raw))
            if out:
                types = (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["tbl", "rec", "train", "text", "symbols"])

    return records.select("tbl", F.col("rec").cast("long"), "train", "text").mapInArrow(run, "tbl int, rec long, train boolean, text long, symbols binary")


def _triples(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's triples once, of columns tbl and symbols: (hashes, text, n)."""
    parts = batch.column("symbols").to_pylist()
    h, text, _ = dealing.flat(parts, _seeds(batch.column("tbl")))
    return dealing.distinct(h, text, len(parts))


def _prefixed(words: DataFrame, tables: str, many: int | None) -> DataFrame:
    """PREFIXES of the texts: their triples that may be on both sides; side is 1 for texts of evaluation splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, both = get(tables, "tables")
        for batch in batches:
            if not batch.num_rows:
                continue
            h, text, n = _triples(batch)
            sketches, own = dealing.prefixes(h, text, n, counts, lambda x: dealing.in_bits(both, x), many)
            side = pa.array([0 if train else 1 for train in batch.column("train").to_pylist()], pa.int32())
            columns = [batch.column("text"), side, pa.array(n.astype(np.int32)), pa.array(sketches, pa.binary()), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["rec", "side", "n", "sketch", "prefix"]).filter(pa.array([len(x) > 0 for x in own]))

    return words.select("tbl", "train", "text", "symbols").mapInArrow(run, dealing.PREFIXES)


def _side_bits(words: DataFrame, tables: str, bits: int) -> np.ndarray:
    """The bit table of the triples in the prefixes of the texts."""

    def fill(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> None:
        counts = get(tables, "tables")
        for batch in batches:
            if batch.num_rows:
                h, text, n = _triples(batch)
                dealing.set_bits(table, h[dealing.rarest(h, text, n, counts)[0]])

    return merged_table(words.select("tbl", "symbols"), fill, bits >> 3, "or")


def cross_pairs(e: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(train, held) within the radius, of the entries of whole shards."""
    e = e[np.lexsort((e["rec"], e["side"], e["shard"]))]
    again = np.zeros(len(e), bool)
    again[1:] = (e["shard"][1:] == e["shard"][:-1]) & (e["side"][1:] == e["side"][:-1]) & (e["rec"][1:] == e["rec"][:-1])
    e = e[~again]
    starts = np.flatnonzero(np.concatenate([[True], e["shard"][1:] != e["shard"][:-1]]))
    sizes = np.diff(np.append(starts, len(e)))
    trains = np.add.reduceat((e["side"] == 0).astype(np.int64), starts)
    first, number = np.repeat(starts + trains, trains), np.repeat(sizes - trains, trains)  # the evaluation texts that each training entry meets
    train = np.flatnonzero(e["side"] == 0)
    train, first, number = (x[number > 0] for x in (train, first, number))
    found: list[np.ndarray] = []
    done = np.concatenate([[0], np.cumsum(number)])

    def unique() -> pa.RecordBatch:
        pairs = np.concatenate(found)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["train", "held"])

    for low in range(0, int(done[-1]), AT_ONCE):
        at = np.arange(low, min(low + AT_ONCE, int(done[-1])))
        own = np.searchsorted(done, at, side="right") - 1
        i, j = train[own], first[own] + at - done[own]
        ok = dealing.close(e, i, j)
        if ok.any():
            found.append(np.stack([e["rec"][i[ok]], e["rec"][j[ok]]], axis=1))
        if sum(map(len, found)) >= 1_000_000:
            yield unique()
            found.clear()
    if found:
        yield unique()


class _Automaton:
    """The triples of some evaluation texts as passages: a character for each symbol that they have, one for all others."""

    def __init__(self, texts: list[bytes]) -> None:
        flat = np.frombuffer(b"".join(texts), np.uint32)
        self.known = np.unique(flat)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.passages: list[np.ndarray] = []
        numbers: dict[str, int] = {}
        for s in texts:
            text = self._characters(s)
            self.passages.append(np.fromiter((numbers.setdefault(text[i : i + 3], len(numbers)) for i in range(len(text) - 2)), np.int64, len(text) - 2))
        for passage, k in numbers.items():
            self.automaton.add_word(passage, k)
        self.automaton.make_automaton()

    def _characters(self, s: bytes) -> str:
        symbols = np.frombuffer(s, np.uint32)
        at = np.minimum(self.known.searchsorted(symbols), len(self.known) - 1)
        c = np.where(self.known[at] == symbols, at + 1, 0).astype(np.uint32)
        return np.where(c >= 0xD800, c + np.uint32(0x800), c).astype(np.uint32).tobytes().decode("utf-32-le")

    def found(self, s: bytes) -> np.ndarray:
        """The numbers of the passages in a training text."""
        return np.unique(np.fromiter((k for _, k in self.automaton.iter(self._characters(s))), np.int64))


def _checked(pairs: DataFrame, words: DataFrame, passages: int) -> DataFrame:
    """(tbl, train, held, common, n_train, n_held, words, spans) of the pairs that are near."""
    bits = words.sparkSession.sparkContext.broadcast(dealing.node_bits(pairs, ("train", "held")))

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(dealing.in_bits(bits.value, batch.column("text").to_numpy(zero_copy_only=False))))
            if batch.num_rows:
                n = pa.array(_triples(batch)[2].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, n], ["tbl", "text", "symbols", "n"])

    texts = stage(words.select("tbl", "text", "symbols").mapInArrow(paired, "tbl int, text long, symbols binary, n int").dropDuplicates(["text"]), "compared", compression="zstd")
    side = lambda x: texts.select(F.col("text").alias(x), F.col("tbl").alias(f"tbl_{x}"), F.col("n").alias(f"n_{x}"), F.col("symbols").alias(f"symbols_{x}"))
    rows = pairs.join(side("train"), "train").join(side("held"), "held").filter("tbl_train = tbl_held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = list(zip(*(batch.column(c).to_pylist() for c in ("tbl_train", "train", "held", "n_train", "n_held", "symbols_train", "symbols_held"))))
            low = 0
            while low < len(whole):
                number: dict[int, int] = {}
                texts_: list[bytes] = []
                size, high = 0, low
                while high < len(whole) and (size < passages or whole[high][2] in number):
                    held, s = whole[high][2], whole[high][6]
                    if held not in number:
                        number[held] = len(texts_)
                        texts_.append(s)
                        size += len(s) >> 2
                    high += 1
                automaton, scanned, out = _Automaton(texts_), {}, []
                for tbl, train, held, n, m, s, _ in whole[low:high]:
                    if train not in scanned:
                        scanned[train] = automaton.found(s)
                    own, hit = automaton.passages[number[held]], scanned[train]
                    if not len(hit):
                        continue
                    shared = hit[np.minimum(hit.searchsorted(own), len(hit) - 1)] == own
                    common = len(np.unique(own[shared]))
                    if near_from_counts(common, n, m):
                        out.append((tbl, train, held, common, n, m, len(own) + 2, spans(shared)))
                if out:
                    types = (pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["tbl", "train", "held", "common", "n_train", "n_held", "words", "spans"])
                low = high

    return rows.mapInArrow(run, "tbl int, train long, held long, common int, n_train int, n_held int, words int, spans array<struct<start: int, end: int>>")


def spans(shared: np.ndarray, width: int = 3) -> list[dict[str, int]]:
    """The intervals of words [start, end) within matched windows, merged."""
    change = np.zeros(len(shared) + width, np.int32)
    at = np.flatnonzero(shared)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    inside = np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=np.int8(0))
    return [{"start": a, "end": b} for a, b in zip(np.flatnonzero(inside > 0).tolist(), np.flatnonzero(inside < 0).tolist())]


def split_overlaps(records: DataFrame, passages: int = PASSAGES, counters: int | None = None, part: int = PART, entries_a_pass: int = dealing.PASS) -> DataFrame:
    """(tbl, train_id, held_id, common, n_train, n_held, words, spans) of every training record and evaluation record of
    the same table that are near; spans are the intervals of the evaluation record's words that they share. records: tbl
    int, rec, train boolean, text.

    Null or blank texts and texts under three words are near to nothing; rows with null train or rec are ignored; rows
    that come twice count once; an empty table gives an empty result. Jobs run while the result is built.
    """
    spark = records.sparkSession
    words = stage(encoded(records.filter("train is not null")), "words", compression="zstd")
    rows, size = words.agg(F.count("*"), F.coalesce(F.sum(F.length("symbols")), F.lit(0))).first()
    # a task sends a whole table: as many tasks as cores, not as files
    few = lambda df: df.coalesce(spark.sparkContext.defaultParallelism)

    def shared(tables: object) -> str:
        dealing.free_shuffles(spark)  # those of the table made last
        put(path := shared_path(spark, "tables"), "tables", tables)
        return path

    counters = counters or dealing.power(COUNTERS, 32 * rows, MOST_COUNTERS)
    counts = dealing.count_table(few(words.select("tbl", "symbols")), lambda b: _triples(b)[0], counters)
    alone = shared(counts)
    bits = dealing.power(1 << 22, 2 * size, MOST_BITS)  # sixteen for each triple of a prefix: half of a text's words
    both = _side_bits(few(words.filter("train")), alone, bits) & _side_bits(few(words.filter("not train")), alone, bits)
    tables = shared((counts, both))
    del counts, both
    delete_shared(spark, alone)
    parts = max(1, rows // part)
    prefixes = stage(_prefixed(words, tables, min(part, 65535) if parts > 1 else None), "prefixes", compression="lz4")
    delete_shared(spark, tables)
    found: list[DataFrame] = []
    dealing.search(prefixes, cross_pairs, "train long, held long", lambda pairs, k: found.append(stage(pairs, f"pairs-{k}")), parts, entries_a_pass)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionAll(more)
    pairs = stage(pairs.distinct(), "pairs")
    unstage(prefixes, *found)
    near = stage(_checked(pairs, words, passages), "near")
    unstage(pairs)
    member = lambda which, name: words.filter(which).select(F.col("text").alias(name), F.col("rec").alias(f"{name}_id")).distinct()
    members = near.join(member("train", "train"), "train").join(member("not train", "held"), "held")
    return members.select("tbl", "train_id", "held_id", "common", "n_train", "n_held", "words", "spans")


def coverage(found: DataFrame) -> DataFrame:
    """(tbl, held_id, pairs, words, covered): for each evaluation record of split_overlaps the words that lie in an
    interval shared with any of its training records. Equal intervals are folded before they are sorted, so a record
    that very many share costs its own length, not their number."""
    by = ["tbl", "held_id"]
    each = found.select(*by, F.inline("spans")).distinct()
    before = F.max("end").over(Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    more = F.greatest(F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))), F.lit(0))
    covered = each.select(*by, more.alias("more")).groupBy(*by).agg(F.sum("more").alias("covered"))
    return found.groupBy(*by).agg(F.count("*").alias("pairs"), F.max("words").alias("words")).join(covered, by)
