"""Groups of near-duplicate records (problem 5): shards of a prefix index, BK-trees over Hamming distance in large ones.

Texts with equal sets of triples are one text, named by a hash of the set, so exact copies never meet each other. Every
text sends its rarest triples (half plus one: any near text shares one of them) with a 256-bit parity sketch to the shard
of the triple; shards are dealt into buckets, pass by pass (see dealing), not broadcast, as their size grows with the
data. A shard compares its members' sketches with the radius (|A| + |B|) / 3, which no near pair exceeds; what is found
is then checked exactly and joined into components. Triples of one text only name no shard: a table of fixed size, of
those that may be in two texts, keeps most of them back (when it is full it keeps fewer back, which only costs speed).
Words are staged once, compressed; only texts that are in a pair are sent on for the exact check.

A triple of very many texts is dealt into parts from the start, one for each PART texts of the collection. A shard above
`hot` members links them to its first member only; later rounds split it into blocks, grow a BK-tree in each (children
are keyed by their integer Hamming distance to the parent, a search follows the edges within its radius) and search
again, but only from members outside its largest component and only for pairs whose components still differ, so a shard
full of near-copies stays linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import dealing
from tracewell.llm.words import Symbols, marks, merged_table, seen_twice
from tracewell.operators.components import connected_components
from tracewell.session import stage, unstage

#: Counters at least and at most (two bytes each).
COUNTERS = 1 << 21
MOST_COUNTERS = 1 << 25
#: Slots of the table of triples that may be in two texts (two bits each).
SLOTS = 1 << 25
HOT = 8192
PART = 500_000


class BKTree:
    """Children are keyed by integer Hamming distance to their parent."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: tuple | None = None

    def add(self, sketch: int, item: object) -> None:
        if self.root is None:
            self.root = (sketch, [item], {})
            return
        node = self.root
        while True:
            d = (node[0] ^ sketch).bit_count()
            if d == 0:
                node[1].append(item)
                return
            child = node[2].get(d)
            if child is None:
                node[2][d] = (sketch, [item], {})
                return
            node = child

    def within(self, sketch: int, radius: int) -> Iterator[tuple[object, int]]:
        todo = [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            d = (node[0] ^ sketch).bit_count()
            if d <= radius:
                for item in node[1]:
                    yield item, d
            low, high = d - radius, d + radius
            for k, child in node[2].items():
                if low <= k <= high:
                    todo.append(child)


def features(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rec, text, symbols) of every row with triples; text names the set of triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Symbols()
        for batch in batches:
            ids, symbols = [], []
            for rec, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if rec is not None and len(s := table.of(text)) > 2:
                    ids.append(rec)
                    symbols.append(s.tobytes())
            if not ids:
                continue
            h, text, _ = dealing.flat(symbols)
            h, text, n = dealing.distinct(h, text, len(ids))
            raw, ends = h.tobytes(), (8 * np.cumsum(n)).tolist()
            keys = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip([0, *ends], ends)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys), pa.array(symbols, pa.binary())], ["rec", "text", "symbols"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "rec long, text long, symbols binary")


def _triples(symbols: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's triples once: (hashes, text, n)."""
    parts = symbols.to_pylist()
    h, text, _ = dealing.flat(parts)
    return dealing.distinct(h, text, len(parts))


def in_two_texts(feats: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """The table of triples that may be in two texts."""
    mask = np.uint64(slots - 1)

    def fill(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> None:
        marks(((_triples(b.column(0))[0] & mask).astype(np.int64) for b in batches if b.num_rows), table)

    return merged_table(feats.select("symbols"), fill, slots // 4, "twice")


def prefixed(feats: DataFrame, counts: np.ndarray, twice: np.ndarray, many: int | None) -> DataFrame:
    """PREFIXES of the texts: their triples that may be in another text."""
    shared = feats.sparkSession.sparkContext.broadcast((counts, twice))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kept = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            h, text, n = _triples(batch.column(1))
            sketches, own = dealing.prefixes(h, text, n, table, lambda x: seen_twice(kept, x), many)
            columns = [batch.column(0), pa.array(np.zeros(len(n), np.int32)), pa.array(n.astype(np.int32)), pa.array(sketches, pa.binary()), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["rec", "side", "n", "sketch", "prefix"]).filter(pa.array([len(x) > 0 for x in own]))

    return feats.select("text", "symbols").mapInArrow(run, dealing.PREFIXES)


def hot_entries(prefixed: DataFrame, hots: np.ndarray) -> DataFrame:
    """(shard, rec, n, sketch) under the shards given, and under those that were dealt into parts."""
    shared = prefixed.sparkSession.sparkContext.broadcast(np.sort(hots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            e, own = dealing.entries(batch), shared.value
            at = e["shard"] & np.uint64(1) == 1
            if len(own):
                at |= own[np.minimum(own.searchsorted(e["shard"]), len(own) - 1)] == e["shard"]
            e = e[at]
            columns = [pa.array(np.ascontiguousarray(e["shard"]).view(np.int64)), *[pa.array(np.ascontiguousarray(e[c])) for c in ("rec", "n")], pa.array([x.tobytes() for x in e["sketch"]], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "rec", "n", "sketch"])

    return prefixed.mapInArrow(run, "shard long, rec long, n int, sketch binary")


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[tuple], int, bool]]:
    """(key, rows, number, last) of runs of rows with equal first `width` columns in sorted batches; a run's rows come in
    pieces, a batch each, and only the last piece of a batch may go on."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:width]]
        change = np.zeros(n, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], n).tolist()
        keys = zip(*(c[starts].tolist() for c in columns))
        rest = [c.to_pylist() for c in batch.columns[width:]]
        rest[2] = [int.from_bytes(x, "little") for x in rest[2]]
        for key, a, b in zip(keys, starts.tolist(), ends):
            yield key, zip(*(c[a:b] for c in rest)), b - a, b == n


class _Shard:
    """Searches one shard: members come one by one, pairs within the radius go to `out`."""

    def __init__(self, out: set[tuple[int, int]]) -> None:
        self.out, self.tree, self.most = out, BKTree(), 0

    def link(self, rec: int, n: int, sketch: int, comp: int | None = None, most: int | None = None) -> None:
        radius, close = min(n, (n + self.most) // 3), {}
        for (other, m, c), d in self.tree.within(sketch, radius):
            if 3 * d <= n + m and n <= 2 * m and m <= 2 * n and other != rec and (comp is None or comp != c):
                if most is None:
                    self.out.add((rec, other) if rec < other else (other, rec))
                else:
                    close.setdefault(c, []).append((d, other))
        for found in close.values():
            self.out.update((min(rec, other), max(rec, other)) for _, other in sorted(found)[:most])

    def add(self, rec: int, n: int, sketch: int, comp: int | None = None) -> None:
        self.tree.add(sketch, (rec, n, comp))
        self.most = max(self.most, n)


_PAIRS = "kind string, a long, b long"


def _pair_batch(kind: str, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(pairs), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])


def _arrays(kind: str, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.string()).take(pa.array(np.zeros(len(a), np.int64))), pa.array(a), pa.array(b)], ["kind", "a", "b"])


def _far_and_wide(e: np.ndarray, start: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs within the radius in one shard of many members, some rows at a time."""
    n, words = e["n"][start : start + size], [np.ascontiguousarray(e["sketch"][start : start + size, k]) for k in range(4)]
    step = max(1, 1_000_000 // size)
    for a in range(0, size, step):
        rows = slice(a, a + step)
        d = np.zeros((len(n[rows]), size - a), np.int16)
        for w in words:
            d += np.bitwise_count(w[rows, None] ^ w[None, a:])
        i, j = np.nonzero(3 * d <= n[rows, None] + n[None, a:])
        i, j = i[i < j] + a, j[i < j] + a
        ok = (n[i] <= 2 * n[j]) & (n[j] <= 2 * n[i])
        yield start + i[ok], start + j[ok]


def shard_pairs(e: np.ndarray, hot: int = HOT) -> Iterator[pa.RecordBatch]:
    """(kind, a, b) in the entries of whole shards: 'pair' within the radius in some shard; 'hot' names a shard (in a) that
    only linked to its first member."""
    e = e[np.lexsort((e["rec"], e["shard"]))]
    again = np.zeros(len(e), bool)
    again[1:] = (e["shard"][1:] == e["shard"][:-1]) & (e["rec"][1:] == e["rec"][:-1])
    e = e[~again]
    starts = np.flatnonzero(np.concatenate([[True], e["shard"][1:] != e["shard"][:-1]]))
    sizes = np.diff(np.append(starts, len(e)))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            found.append((e["rec"][i], e["rec"][j]))

    small = np.repeat(sizes <= min(hot, 64), sizes)
    i, d = np.flatnonzero(small[:-1] & (e["shard"][1:] == e["shard"][:-1])), 1
    while len(i):
        for k in range(0, len(i), 500_000):
            x = i[k : k + 500_000]
            ok = dealing.close(e, x, x + d)
            take(x[ok], x[ok] + d)
        d += 1
        i = i[i + d < len(e)]
        i = i[e["shard"][i + d] == e["shard"][i]]
    hots = []
    for start, size in zip(starts[sizes > min(hot, 64)].tolist(), sizes[sizes > min(hot, 64)].tolist()):
        if size <= hot:
            for i, j in _far_and_wide(e, start, size):
                take(i, j)
        else:
            hots.append(e["shard"][start])
            j = np.arange(start + 1, start + size)
            ok = dealing.close(e, np.full(size - 1, start), j)
            take(np.full(int(ok.sum()), start), j[ok])
        if sum(len(a) for a, _ in found) >= 1_000_000:
            yield _unique(found)
            found.clear()
    if found:
        yield _unique(found)
    shards = np.array([s for s in hots if not int(s) & 1], np.uint64).view(np.int64)
    yield _arrays("hot", shards, np.zeros(len(shards), np.int64))


def _unique(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*found))
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return _arrays("pair", a[first], b[first])


def cross_pairs(entries: DataFrame, comps: DataFrame, hot: int = HOT, most: int | None = None) -> DataFrame:
    """The pairs within the radius in hot shards whose components differ.

    A shard's members are dealt into blocks of about `hot`, a tree each. Only members outside the shard's largest
    component search all blocks, so a shard that is nearly one component costs its size, not its square. With `most`,
    a search keeps the closest so many of each other component; call again without it for what is left.
    """
    own = entries.join(comps.withColumnRenamed("node", "rec"), "rec", "left").withColumn("comp", F.coalesce("comp", "rec"))
    sizes = own.groupBy("shard", "comp").agg(F.count("*").alias("k")).groupBy("shard").agg(
        F.ceil(F.sum("k") / hot).cast("int").alias("blocks"), F.max(F.struct("k", "comp"))["comp"].alias("major"), F.count("*").alias("comps")
    )
    dealt = own.join(sizes.filter("comps > 1"), "shard")
    columns = ("rec", "n", "sketch", "comp")
    home = dealt.select("shard", F.pmod(F.xxhash64("rec"), F.col("blocks")).cast("int").alias("block"), *columns, F.lit(0).alias("role"))
    seek = dealt.filter("comp <> major").select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *columns, F.lit(1).alias("role"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()
        now, shard = None, _Shard(out)
        for key, rows, _, _ in _runs(batches, 2):
            if key != now:
                now, shard = key, _Shard(out)
            for rec, n, sketch, comp, role in rows:
                if role:
                    shard.link(rec, n, sketch, comp, most)
                else:
                    shard.add(rec, n, sketch, comp)
            if len(out) >= 200_000:
                yield _pair_batch("pair", list(out))
                out.clear()
        yield _pair_batch("pair", list(out))

    return home.unionAll(seek).repartition("shard", "block").sortWithinPartitions("shard", "block", "role", "rec").mapInArrow(run, _PAIRS)


def near_links(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """The pairs whose triples prove them near. Only texts that are in a pair are sent."""
    only = stage(pairs.filter("kind = 'pair'").select("a", "b").distinct(), "candidates")
    bits = feats.sparkSession.sparkContext.broadcast(dealing.node_bits(only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(dealing.in_bits(bits.value, batch.column(0).to_numpy(zero_copy_only=False))))
            if batch.num_rows:
                h, _, n = _triples(batch.column(1))
                tri = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), tri], ["text", "tri"])

    texts = feats.select("text", "symbols").mapInArrow(run, "text long, tri array<long>").dropDuplicates(["text"])
    texts = stage(texts, "compared")
    side = lambda x: texts.select(F.col("text").alias(x), F.col("tri").alias(f"tri_{x}"))
    common = F.size(F.array_intersect("tri_a", "tri_b"))
    links = stage(
        only.join(side("a"), "a").join(side("b"), "b").filter(common * 3 >= F.size("tri_a") + F.size("tri_b")).select("a", "b"), "links"
    )
    unstage(only, texts)
    dealing.free_shuffles(feats.sparkSession)
    return links


def near_groups(
    df: DataFrame, id_col: str, text_col: str, group_col: str = "group_id", hot: int = HOT, counters: int | None = None, part: int = PART, entries_a_pass: int = dealing.PASS
) -> DataFrame:
    """(group, id): the members of every group of two or more records linked, directly or through others, by near texts;
    the group is named by its smallest id.

    Null, blank and very short texts are in no group; an id that comes twice is one record, and has all the texts that
    came with it; an empty table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    feats = stage(features(df, id_col, text_col), "features", compression="zstd")
    rows = feats.count()
    counters = counters or dealing.power(COUNTERS, 32 * rows, MOST_COUNTERS)
    # a task sends a whole table: as many tasks as cores, not as files
    few = feats.coalesce(spark.sparkContext.defaultParallelism)
    counts = dealing.count_table(few.select("symbols"), lambda b: _triples(b.column(0))[0], counters)
    parts = max(1, rows // part)
    prefixes = stage(prefixed(feats, counts, in_two_texts(few), min(part, 65535) if parts > 1 else None), "prefixes", compression="lz4")
    dealing.free_shuffles(spark)
    found: list[DataFrame] = []
    dealing.search(prefixes, lambda e: shard_pairs(e, hot), _PAIRS, lambda pairs, k: found.append(stage(pairs, f"pairs-{k}")), parts, entries_a_pass)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionAll(more)
    links = near_links(pairs, feats)
    comps = connected_components(links)
    hots = np.array([r["a"] for r in pairs.filter("kind = 'hot'").select("a").distinct().collect()], np.int64).view(np.uint64)
    if parts > 1 or len(hots):
        hot_rows = stage(hot_entries(prefixes, hots).distinct(), "hot")
        for most in (4, None):  # first the closest of each component, which joins most; then all that still differ
            crossed = near_links(cross_pairs(hot_rows, comps, hot, most), feats)
            both = stage(links.unionByName(crossed).distinct(), "links")
            unstage(links, crossed)
            links = both
            comps = connected_components(links)
        unstage(hot_rows)
    unstage(prefixes, *found)
    own = feats.select("rec", "text").distinct()
    ends = own.groupBy("rec").agg(F.min("text").alias("a"), F.max("text").alias("b"), F.collect_set("text").alias("all")).filter("a < b")
    same = stage(ends.select("a", F.explode("all").alias("b")).filter("a < b").distinct(), "links")
    if not same.isEmpty():
        comps = connected_components(links.unionByName(same))
    unstage(links, same)
    placed = own.join(comps.withColumnRenamed("node", "text"), "text", "left").select("rec", F.coalesce("comp", "text").alias("comp")).distinct()
    named = placed.groupBy("comp").agg(F.min("rec").alias(group_col), F.count("*").alias("members")).filter("members > 1")
    return placed.join(named, "comp").select(group_col, F.col("rec").alias(id_col))
