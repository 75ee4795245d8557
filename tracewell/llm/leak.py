"""Evaluation texts leaking into training text (problem 7).

Test items go into a BM25 inverted index with block maxima. Every training document is read in overlapping passages of
2 * run - 1 words, a step of `run` apart, so that any run of `run` words lies whole in one passage; each passage
queries the index by block-max WAND. Impacts are scaled so that 1 is the least score any passage holding `run`
consecutive words of the item can have (the minimum over the item's own windows), so retrieving all at 1 and above
loses nothing. What is retrieved is verified word by word.

Items are dealt into shards by the bytes of their texts, which bound an index's memory (about ten times them); each
shard's index is built in a task and written to the shared folder, so neither the driver nor a broadcast ever holds
items. The documents are read and split into words once, in chunks; each chunk meets one shard's index after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shelf import get, put
from tracewell.llm.words import Symbols, window_hashes, words
from tracewell.session import shared_path

RUN = 12
K1, B = 1.2, 0.75
BLOCK = 16
#: Bytes of the items' texts in one shard, and code points of documents that meet one shard's index before the next.
SHARD_BYTES = 16 << 20
CHUNK = 1 << 25
#: A score of 1, but for rounding.
ENOUGH = 1 - 1e-6


class ItemIndex:
    """BM25 postings of the items with `run` words or more, in arrays; impacts over the item's own threshold.

    Terms are word triples, by hash: a run of `run` words holds run - 2 of them, and single words of scenes are too
    common to tell items apart.
    """

    #: Postings kept as lists once they were asked for, all together.
    KEPT = 1 << 20

    def __init__(self, items: list[tuple[int, list[str]]], run: int = RUN) -> None:
        self.run, self.symbols = run, Symbols()
        items = [(key, ws) for key, ws in items if len(ws) >= run]
        self.items = np.array([key for key, _ in items], np.int64)
        self.texts = [" ".join(ws) for _, ws in items]
        sizes = np.array([len(ws) for _, ws in items], np.int64)
        own = [np.fromiter(map(self.symbols.__getitem__, ws), np.uint32, len(ws)) for _, ws in items]
        self.starts = [np.concatenate([[0], np.cumsum([len(w) + 1 for w in ws])]).astype(np.int32) for _, ws in items]
        self.runs = [np.sort(window_hashes(s, run)) for s in own]
        self.where = [np.argsort(window_hashes(s, run), kind="stable").astype(np.int32) for s in own]
        lengths = sizes - 2
        terms = np.concatenate([*map(window_hashes, own), np.empty(0, np.uint64)])
        of = np.repeat(np.arange(len(items)), lengths)
        order = np.lexsort((of, terms))
        t, d = terms[order], of[order]
        first = np.ones(len(t), bool)
        first[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(first)
        tf = np.diff(np.append(at, len(t)))
        self.docs = d[at].astype(np.int32)
        self.keys, self.first = np.unique(t[at], return_index=True)
        self.first = np.append(self.first, len(at))
        df = np.diff(self.first)
        idf = np.log(1 + (len(items) - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1e-9, lengths.mean() if len(lengths) else 1))
        impacts = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.docs])
        # Each item's threshold: the least sum over the distinct terms of one of its runs.
        spread = np.empty(len(t))
        spread[order] = np.repeat(impacts, tf)
        again = np.bincount(self.docs[tf > 1], minlength=len(items)) > 0
        least, begin = np.ones(len(items)), np.concatenate([[0], np.cumsum(lengths)])
        width = run - 2
        for k in range(len(items)):
            x, own_terms = spread[begin[k] : begin[k + 1]], terms[begin[k] : begin[k + 1]]
            if again[k]:
                least[k] = min(sum(dict(zip(own_terms[i : i + width].tolist(), x[i : i + width].tolist())).values()) for i in range(len(x) - width + 1))
            else:
                sums = np.concatenate([[0.0], np.cumsum(x)])
                least[k] = (sums[width:] - sums[:-width]).min()
        self.impacts = impacts / least[self.docs]
        self.bounds = np.maximum.reduceat(self.impacts, self.first[:-1]) if len(self.keys) else np.empty(0)
        self.lists: dict[int, tuple] = {}
        self.kept = 0

    def term(self, k: int) -> tuple:
        """(bound, items, impacts, block ends, block maxima) of a term."""
        if (found := self.lists.get(k)) is None:
            a, b = self.first[k], self.first[k + 1]
            docs, impacts = self.docs[a:b], self.impacts[a:b]
            blocks = np.arange(0, b - a, BLOCK)
            found = (float(self.bounds[k]), docs.tolist(), impacts.tolist(), docs[np.minimum(blocks + BLOCK, b - a) - 1].tolist(), np.maximum.reduceat(impacts, blocks).tolist())
            if self.kept > self.KEPT:
                self.lists.clear()
                self.kept = 0
            self.lists[k] = found
            self.kept += int(b - a)
        return found

    def __getstate__(self) -> dict:
        return self.__dict__ | {"symbols": Symbols(), "lists": {}, "kept": 0}

    def holds(self, k: int, run_hash: int, words_: list[str]) -> bool:
        """Whether the item has this run of words, of this hash."""
        runs, text, starts = self.runs[k], self.texts[k], self.starts[k]
        said = " ".join(words_)
        for i in range(runs.searchsorted(run_hash), runs.searchsorted(run_hash, "right")):
            place = self.where[k][i]
            if text[starts[place] : starts[place + self.run] - 1] == said:
                return True
        return False

    def above(self, passage: set[int], threshold: float = ENOUGH) -> list[int]:
        """The items whose score for the passage (places of its terms in the index) reaches the threshold, by
        block-max WAND."""
        lists = [self.term(t) for t in passage]
        # cursor: [current item, upper bound, place, items, impacts, block ends, block maxima]
        cursors = [[x[1][0], x[0], 0, x[1], x[2], x[3], x[4]] for x in lists]
        cursors.sort(key=_item)
        found: list[int] = []
        while cursors:
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[1]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block, following = 0.0, _NEVER
            for c in cursors[: pivot + 1]:
                k = c[2] // BLOCK
                ends = c[5]
                last = len(ends)
                while k < last and ends[k] < item:
                    k += 1
                if k < last:
                    block += c[6][k]
                    if ends[k] + 1 < following:
                        following = ends[k] + 1
            if block < threshold:  # no item up to the nearest block end can reach it
                if pivot + 1 < len(cursors) and cursors[pivot + 1][0] < following:
                    following = cursors[pivot + 1][0]
                target = max(following, item + 1)
            else:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    _forward(c, item)
                    if c[0] == item:
                        score += c[4][c[2]]
                if score >= threshold:
                    found.append(item)
                target = item + 1
            for c in cursors[: pivot + 1]:
                _forward(c, target)
            cursors = [c for c in cursors if c[0] != _NEVER]
            cursors.sort(key=_item)
        return found

    def held(self, ws: list[str]) -> dict[int, set[int]]:
        """Item -> the places in the document where a run of it starts."""
        run, hits = self.run, {}
        if len(ws) < run or not len(self.keys):
            return hits
        symbols = np.fromiter(map(self.symbols.__getitem__, ws), np.uint32, len(ws))
        h, whole = window_hashes(symbols), None
        at = np.minimum(self.keys.searchsorted(h), len(self.keys) - 1)
        known = self.keys[at] == h
        sums = np.concatenate([[0.0], np.cumsum(np.where(known, self.bounds[at], 0.0))])
        starts = np.arange(0, len(ws) - run + 1, run)
        ends = np.minimum(starts + 2 * run - 3, len(h))
        for a, b in zip(starts.tolist(), ends.tolist()):
            if sums[b] - sums[a] < ENOUGH:  # not even all upper bounds together reach it: no first pivot
                continue
            for k in self.above(set(at[a:b][known[a:b]].tolist())):
                whole = window_hashes(symbols, run) if whole is None else whole
                for i in range(a, min(a + run, len(ws) - run + 1)):
                    if self.holds(k, whole[i], ws[i : i + run]):
                        hits.setdefault(k, set()).add(i)
        return hits


_NEVER = 1 << 60


def _item(cursor: list) -> int:
    return cursor[0]


def _forward(c: list, target: int) -> None:
    """Moves a cursor to the first posting at or after the target, by blocks."""
    if c[0] >= target:
        return
    docs, ends, at = c[3], c[5], c[2]
    k = at // BLOCK
    last = len(ends)
    while k < last and ends[k] < target:
        k += 1
    if k == last:
        c[0] = _NEVER
        return
    at = max(at, k * BLOCK)
    while docs[at] < target:
        at += 1
    c[0], c[2] = docs[at], at


def _build(items: DataFrame, path: str, run: int) -> list[int]:
    """Builds the index of each shard of (shard, item, text) in a task of its own; gives the shards that have items."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if now is not None:
                put(path, f"index-{now}", ItemIndex(held, run))
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32())], ["shard"])

        for batch in batches:
            for shard, item, text in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    yield from close()
                    now, held = shard, []
                held.append((item, words(text)))
        yield from close()

    built = items.repartition("shard").sortWithinPartitions("shard", "item", "text").mapInArrow(build, "shard int")
    return sorted(r["shard"] for r in built.collect())


def leaked_items(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, run: int = RUN, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc, item, runs, words): documents with a run of `run` or more consecutive words that is also one of the item;
    runs counts the places, words the document's words within them.

    Null and blank texts and items under `run` words match nothing; repeated rows count once; null ids are ignored;
    empty tables give an empty result. Jobs run while the result is built.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).filter("item is not null and text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    deal = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-size // shard_bytes)))).cast("int")
    path = shared_path(spark, "items")
    shards = _build(items.select(deal.alias("shard"), "item", "text"), path, run)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(doc_text).cast("string").alias("text")).filter("doc is not null and text is not null")
    schema, types = f"{doc_id} long, {item_id} long, runs int, words int", (pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        chunk, n = [], 0
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                chunk.append((doc, words(text)))
                n += len(text)
                if n > CHUNK:
                    yield chunk
                    chunk, n = [], 0
        yield chunk

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            out = []
            for shard in shards if chunk else ():
                index = get(path, f"index-{shard}")
                for doc, ws in chunk:
                    for k, places in index.held(ws).items():
                        covered = set().union(*(range(p, p + run) for p in places))
                        out.append((doc, int(index.items[k]), len(places), len(covered)))
            for k in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[k : k + 10_000]), types)], [doc_id, item_id, "runs", "words"])

    return texts.mapInArrow(scan, schema).groupBy(doc_id, item_id).agg(F.max("runs").alias("runs"), F.max("words").alias("words"))
