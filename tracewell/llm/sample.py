"""Samples that match target category proportions (problem 3), by swap repair over category signatures.

A record's signature is its category in each field that a request targets, all untargeted categories of a field being
one. Records are counted by signature, which is a table bounded by the targets, not by the records. A random sample that
satisfies the floors starts the search: counts are exchanged between two signatures, the best exchange at a time, while
that lowers the deviation from the targets, never below a floor and never above what there is. The counts are then
materialised by a random order of the records: those that can be among the first so many of their signature pass a
threshold first, so that records do not meet all requests, and only those are ranked.
"""

from __future__ import annotations

import random
from collections.abc import Hashable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import stage, unstage

#: Targets in one call at most, and signatures of one request; they and a table of this size are worked on by the driver.
MOST_TARGETS, MOST_SIGNATURES = 100_000, 4_000


def category(column: str):
    """Outer blanks cut, lower case, '-' and inner blanks read as '_'."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.col(column), r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")), r"[\s\x{A0}-]", "_")


def repair(have: dict[Hashable, int], target: dict[Hashable, int], floor: dict[Hashable, int], size: int, seed: int) -> dict[Hashable, int]:
    """Counts by signature: floors first, then at random, then swaps that lower sum |count * 1000 - target_pm * size| over
    the categories, the best one at a time, until none does.

    have: records by signature, a tuple of categories (or one category). target, floor: by category; categories that are
    not in target have 0. Where there are fewer records than size, all are taken.
    """
    rng, keys = random.Random(seed), sorted(have, key=str)
    of = [k if isinstance(k, tuple) else (k,) for k in keys]
    cats = sorted({c for k in of for c in k}, key=str)
    size = min(size, sum(have.values()))
    if not keys or size <= 0:
        return dict.fromkeys(keys, 0)
    at = {c: j for j, c in enumerate(cats)}
    inside = np.zeros((len(keys), len(cats)), np.int64)
    for i, k in enumerate(of):
        inside[i, [at[c] for c in k]] = 1
    most = np.array([have[k] for k in keys], np.int64)
    goal = np.array([target.get(c, 0) * size for c in cats], np.int64)
    low = np.minimum(most @ inside, np.array([floor.get(c, 0) for c in cats], np.int64))
    took = np.zeros(len(keys), np.int64)

    def draw(n: int, of_these: np.ndarray) -> None:
        """n more records at random from the signatures, in proportion to what is spare."""
        while n > 0 and (spare := int((most - took)[of_these].sum())):
            left = n
            for i in rng.sample(of_these.tolist(), len(of_these)):
                part = min(int(most[i] - took[i]), n, max(1, round(left * int(most[i] - took[i]) / spare)))
                took[i] += part
                n -= part
                if not n:
                    break

    for j in rng.sample(range(len(cats)), len(cats)):
        draw(max(0, int(low[j] - took @ inside[:, j])), np.flatnonzero(inside[:, j]))
    while (over := int(took.sum()) - size) > 0:  # floors that do not fit together give way, the largest first
        i = max(range(len(keys)), key=lambda i: (took[i], i))
        rest = sorted(took.tolist())[-2:-1]
        took[i] -= min(over, max(1, int(took[i]) - (rest[0] if rest else 0)))
    draw(size - int(took.sum()), np.arange(len(keys)))
    low = np.minimum(low, took @ inside)
    step = 1 << (size.bit_length() - 1)
    while step:
        now = took @ inside
        off = np.abs(1000 * now - goal)
        less, more = np.abs(1000 * (now - step) - goal) - off, np.abs(1000 * (now + step) - goal) - off
        # The change by moving from signature a (row) to b (column); categories of both stay as they are.
        change = (inside @ less)[:, None] + (inside @ more)[None, :] - (inside * (less + more)) @ inside.T
        breaks = inside * (now - step < low)
        barred = (took < step)[:, None] | (took + step > most)[None, :] | (breaks.sum(1)[:, None] > breaks @ inside.T)
        change[barred] = 0
        a, b = np.unravel_index(np.argmin(change), change.shape)
        if change[a, b] >= 0:
            step >>= 1
            continue
        took[a] -= step
        took[b] += step
    return dict(zip(keys, took.tolist()))


def _needs(targets: DataFrame) -> DataFrame:
    """The records that each target asks for: the greater of its floor and its share, rounded up."""
    share = F.ceil(F.col("target_pm").cast("decimal(20,0)") * F.col("sample_rows").cast("decimal(20,0)") / F.lit(1000).cast("decimal(4,0)"))
    return targets.withColumn("needed", F.greatest(F.coalesce(F.col("min_rows").cast("long"), F.lit(0)), F.coalesce(share.cast("long"), F.lit(0))))


def proportional_samples(
    records: DataFrame, targets: DataFrame, id_col: str, must_have: str, fields: tuple[str, ...], seed: int = 17, latest: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of all requests in targets (request_id, field_name, category, target_pm, min_rows, sample_rows).

    sample: request_id, one column for each field with the record's category, or null where the request does not target
    it, and id. report: request_id, field_name, category, available, needed, taken, short (not even all that there are
    suffice), unmet (the sample has too few, for that or because floors or other targets gave way).

    A request may target several fields at once. A record counts once however often it comes, by the row that is last
    by `latest` where that is given, and only if must_have is not null; null categories are in the sample only as
    untargeted ones. A target of a field or category that no record has is reported with 0 available. Several requests
    draw by one random order, so their samples overlap. Empty tables give empty results. Jobs run while the result is
    built. MOST_TARGETS and MOST_SIGNATURES bound what one call may ask; more raise an error.
    """
    spark = records.sparkSession
    asked_for = F.col("request_id").isNotNull() & F.col("category").isNotNull() & F.col("field_name").isin(*fields)
    asked = sorted(_needs(targets.filter(asked_for)).limit(MOST_TARGETS + 1).collect(), key=lambda r: (r["request_id"], r["field_name"], r["category"]))
    if len(asked) > MOST_TARGETS:
        raise ValueError("too many targets for one call; split the requests")
    wanted = {f: sorted({r["category"] for r in asked if r["field_name"] == f}) for f in fields}
    own = F.struct(*[category(f).alias(f) for f in fields])
    kept = records.filter(F.col(id_col).isNotNull() & F.col(must_have).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max_by(own, latest) if latest else F.max(own)).alias("own"))
    order = F.xxhash64(F.lit(seed), F.col("id"))
    signed = stage(kept.select("id", order.alias("o"), *[F.when(F.col(f"own.{f}").isin(wanted[f] or [""]), F.col(f"own.{f}")).alias(f) for f in fields]), "signatures")
    counted = {tuple(r[f] for f in fields): r["count"] for r in signed.groupBy(*fields).count().collect()}
    plan, report = [], []
    for request in sorted({r["request_id"] for r in asked}):
        mine = [r for r in asked if r["request_id"] == request]
        said = {f: {r["category"] for r in mine if r["field_name"] == f} for f in fields}
        label = lambda raw: tuple((f, c if c in said[f] else None) for f, c in zip(fields, raw) if said[f])  # noqa: E731, B023
        have: dict[tuple, int] = {}
        for raw, n in counted.items():
            have[label(raw)] = have.get(label(raw), 0) + n
        if len(have) > MOST_SIGNATURES:
            raise ValueError(f"request {request} has too many signatures")
        target = {(r["field_name"], r["category"]): r["target_pm"] or 0 for r in mine}
        target |= {(f, None): max(0, 1000 - sum(pm for (g, _), pm in target.items() if g == f)) for f in fields if said[f]}
        floor = {(r["field_name"], r["category"]): r["min_rows"] or 0 for r in mine}
        took = repair(have, target, floor, max(r["sample_rows"] or 0 for r in mine), seed + request)
        total: dict[tuple, int] = {}
        there: dict[tuple, int] = {}
        for k in have:
            for c in k:
                total[c] = total.get(c, 0) + took[k]
                there[c] = there.get(c, 0) + have[k]
        for r in mine:
            c = (r["field_name"], r["category"])
            got, available = total.get(c, 0), there.get(c, 0)
            report.append((request, *c, available, r["needed"], got, available < r["needed"], got < r["needed"]))
        part = {k: i for i, k in enumerate(have)}
        for raw in counted:
            k = label(raw)
            if took[k]:
                plan.append((request, part[k], *raw, took[k], *[dict(k).get(f) for f in fields], _threshold(took[k], have[k])))
    quota = spark.createDataFrame(plan, "request_id int, part int, " + "".join(f"raw_{f} string, " for f in fields) + "quota long, " + "".join(f"said_{f} string, " for f in fields) + "most long")
    quota = F.broadcast(quota) if len(plan) <= MOST_TARGETS else quota
    same = [F.col(f).eqNullSafe(F.col(f"raw_{f}")) for f in fields]
    # A record is dropped before it meets any request if it is beyond the threshold of all that ask for its signature.
    widest = {raw: max((p[-1] for p in plan if p[2 : 2 + len(fields)] == raw), default=None) for raw in counted} if len(plan) <= 10_000 else {}
    if widest:
        bounds = spark.createDataFrame([(*raw, w) for raw, w in widest.items()], "".join(f"raw_{f} string, " for f in fields) + "widest long")
        drawn = signed.join(F.broadcast(bounds), same).filter(F.col("o") <= F.col("widest")).select("id", "o", *fields)
    else:
        drawn = signed
    near = drawn.join(quota, same).filter(F.col("o") <= F.col("most"))
    columns = ["request_id", "part", *[f"said_{f}" for f in fields], "quota", "id", "o"]
    near = stage(near.select(*columns), "drawn")
    lacking = near.groupBy("request_id", "part").agg(F.count("*").alias("n")).select("request_id", "part", "n")
    lacking = quota.select("request_id", "part", "quota").distinct().join(lacking, ["request_id", "part"], "left").filter(F.coalesce("n", F.lit(0)) < F.col("quota")).select("request_id", "part")
    if not lacking.isEmpty():  # about one signature in a billion: the whole of it is ranked
        again = signed.join(quota.join(lacking, ["request_id", "part"]), same).select(*columns)
        whole = stage(near.join(lacking, ["request_id", "part"], "left_anti").unionAll(again), "drawn")
        unstage(near)
        near = whole
    unstage(signed)
    sample = _smallest_by(near).select("request_id", *[F.col(f"said_{f}").alias(f) for f in fields], "id")
    return sample, spark.createDataFrame(report, "request_id int, field_name string, category string, available long, needed long, taken long, short boolean, unmet boolean")


def _threshold(quota: int, have: int) -> int:
    """The order up to which so many of them lie, but for chance of six standard deviations."""
    share = min(1.0, (quota + 6 * quota**0.5 + 40) / have)
    return min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))


def _smallest_by(drawn: DataFrame) -> DataFrame:
    """The `quota` rows of each (request, part) with the smallest (o, id), ranked by ranges of o.

    o is uniform over the longs, so equal ranges of it hold about equal numbers; ranges before the quota's end are
    taken whole and only one range is ranked. No task sorts a whole hot category.
    """
    by = ["request_id", "part"]
    ranged = drawn.withColumn("range", F.shiftright("o", 52))
    sizes = ranged.groupBy(*by, "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("range")) - F.col("n")
    starts = sizes.withColumn("before", before).select(F.col("request_id").alias("r"), F.col("part").alias("c"), F.col("range").alias("g"), "before")
    near = ranged.join(starts, (F.col("request_id") == F.col("r")) & (F.col("part") == F.col("c")) & (F.col("range") == F.col("g"))).filter("before < quota")
    rank = F.row_number().over(Window.partitionBy(*by, "range").orderBy("o", "id"))
    return near.withColumn("rank", rank).filter("before + rank <= quota")
