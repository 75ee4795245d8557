"""Long exact spans shared between records (problem 8).

Rabin-Karp hashes of every window of half the length are taken over code points; each document passes on only those
that are minimal among the windows of one span (winnowing), which every span of the full length holds at least one of
wherever it stands. Those that Spark counts in two documents mark the regions a shared span can lie in. There every
window of the full length is hashed and counted in Spark; windows of two or more documents merge into the maximal
intervals, per document. Counting takes the least and the greatest document of a hash, so a passage held by a third of
all documents is pre-aggregated like any other and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import stage

SPAN = 400
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class RabinKarp:
    """Hashes of all windows of a width, modulo 2^64; powers are kept and grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            for name, step in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, step, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def windows(self, points: np.ndarray, width: int) -> np.ndarray:
        n = len(points) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        self._grow(len(points))
        c = points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
        c *= np.uint64(0xFF51AFD7ED558CCD)
        c ^= c >> np.uint64(33)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * self.up[: len(c)], dtype=np.uint64)])
        h = (sums[width:] - sums[:n]) * self.down[:n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every window, in time linear in len(x)."""
    op, fill = (np.minimum, np.iinfo(x.dtype).max) if least else (np.maximum, 0)
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, fill, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(blocks, width)
    left = op.accumulate(rows, axis=1).ravel()
    right = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[:n], left[width - 1 : width - 1 + n])


def winnowed(h: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the least of some `width` consecutive ones; ties all count."""
    if len(h) < width:
        return np.empty(0, np.int64)
    low = _sliding(h, width, True)
    around = np.concatenate([np.zeros(width - 1, h.dtype), low, np.zeros(width - 1, h.dtype)])
    return np.flatnonzero(_sliding(around, width, False) == h)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _marks(docs: DataFrame, span: int) -> DataFrame:
    """(mark, doc, at): the winnowed windows of half the span; the first place of each in a document."""
    half = span // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rk = RabinKarp(_BASES[0])
        for batch in batches:
            hs, ds, ps = [], [], []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                h = rk.windows(code_points(text), half)
                at = winnowed(h, span - half + 1)
                hs.append(h[at])
                ds.append(np.full(len(at), doc, np.int64))
                ps.append(at.astype(np.int32))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(ds)), pa.array(np.concatenate(ps))], ["mark", "doc", "at"])

    return docs.mapInArrow(run, "mark long, doc long, at int")


def _windows(docs: DataFrame, span: int) -> DataFrame:
    """(hash, doc, at): every window of the full span in the regions around a document's repeated marks."""
    half = span // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rk = RabinKarp(_BASES[1])
        for doc, text, marks in _texts(batches):
            h = rk.windows(code_points(text), span)
            change = np.zeros(len(h) + 1, np.int32)
            at = np.array(marks, np.int64)
            np.add.at(change, np.maximum(at - (span - half), 0), 1)
            np.add.at(change, np.minimum(at, len(h) - 1) + 1, -1)
            here = np.flatnonzero(np.cumsum(change)[:-1] > 0)
            for a in range(0, len(here), 200_000):
                part = here[a : a + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(np.full(len(part), doc, np.int64)), pa.array(part.astype(np.int32))], ["hash", "doc", "at"])

    return docs.mapInArrow(run, "hash long, doc long, at int")


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low <> high").select(key)


def shared_spans(df: DataFrame, id_col: str, text_col: str, span: int = SPAN) -> DataFrame:
    """(id, start, end): the maximal intervals of each document, in code points, made of windows of `span` that occur
    unchanged in another document.

    Null texts and texts shorter than the span share nothing; rows of one id are one document; null ids are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") >= span))
    marks = stage(_marks(docs, span), "marks")
    places = marks.join(_repeated(marks, "mark"), "mark").groupBy("doc").agg(F.collect_set("at").alias("marks"))
    rows = stage(_windows(docs.join(places, "doc").select("doc", "text", "marks"), span), "windows")
    hits = rows.join(_repeated(rows, "hash"), "hash").select("doc", "at").repartition("doc").sortWithinPartitions("doc", "at")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = start = last = None
        out: list[tuple] = []
        for batch in batches:
            for doc, at in zip(*(c.to_numpy() for c in batch.columns)):
                if doc != now or at > last + span:
                    if now is not None:
                        out.append((now, start, last + span))
                    now, start = doc, at
                last = at
        if now is not None:
            out.append((now, start, last + span))
        for a in range(0, len(out), 10_000):
            part = zip(*out[a : a + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, (pa.int64(), pa.int32(), pa.int32()))], [id_col, "start", "end"])

    return hits.mapInArrow(merge, f"{id_col} long, start int, end int")
