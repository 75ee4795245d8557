"""Sources and sinks: tolerant JSON lines, CSV with a fixed field list, nested JSON results, Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.curate import latest

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: str, torn: str = "skip") -> DataFrame:
    """JSON lines with an explicit schema. torn: 'skip' leaves out lines that cannot be read (the last line of a file
    that was cut), 'fail' raises on them. Missing fields are null; blank lines are ignored."""
    if torn == "fail":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).filter("trim(value) <> ''")
    read = lines.select(F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    return read.filter(f"r is not null and r.{CORRUPT} is null").select("r.*").drop(CORRUPT)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Nulls of the named columns replaced; columns that are missing are added."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, fields: list[str], mode: str = "errorifexists") -> None:
    """The listed fields, in this order, with a header."""
    df.select(*fields).write.mode(mode).csv(path, header=True)


def merged_results(prior: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Prior rows kept, but for those that are there anew."""
    both = prior.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.desc("_new")]).drop("_new")


def nested_json(df: DataFrame, key: str, inner: str, values: list[str]) -> DataFrame:
    """One row per key with a JSON object: inner -> values."""
    pair = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(inner), F.struct(*values)))))
    return df.groupBy(key).agg(F.to_json(pair).alias("json"))


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A Markdown table of a small report; raises if it has more than `limit` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the report has more than {limit} rows")
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def check_metadata(stored: dict, wanted: dict) -> None:
    """Refuses to reuse a table that was built with other parameters."""
    other = {k: (stored.get(k), v) for k, v in wanted.items() if stored.get(k) != v}
    if other:
        raise ValueError(f"built with other parameters: {other}")


