"""Session helpers: settings for local runs, and tables staged in the folder that all executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tracewell") -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset, as in local tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new name in the shared folder; clear_staged deletes what is there."""
    path = f"{shared_dir(spark)}/tracewell/{what}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


#: Paths in the shared folder by application: names only.
_STAGED: dict[str, set[str]] = {}


def stage(df: DataFrame, what: str, partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Writes df once into the shared folder and reads it back: cuts lineage, outlives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    writer = df.write.option("compression", compression) if compression else df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._tracewell_path = path
    return staged


def delete_shared(spark: SparkSession, where: str) -> None:
    """Deletes a path of shared_path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _STAGED.get(spark.sparkContext.applicationId, set()).discard(where)


def unstage(*staged: DataFrame) -> None:
    """Deletes staged tables that no later result reads."""
    for df in staged:
        delete_shared(df.sparkSession, df._tracewell_path)


def clear_staged(spark: SparkSession) -> int:
    """Deletes all that this application still has in the shared folder, once its results are written; the number."""
    left = list(_STAGED.get(spark.sparkContext.applicationId, ()))
    for path in left:
        delete_shared(spark, path)
    return len(left)


def spread(df: DataFrame, per_core: int = 4) -> DataFrame:
    """Before costly work per row: a table of few partitions (a small file is one, whatever its rows) is dealt out to
    all cores; one of many stays as it is, so a large table is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < per_core * cores else df


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver runs from: by path, and on a cluster also as a zip."""
    sc = spark.sparkContext
    if getattr(sc, "_tracewell_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if not sc.master.startswith("local"):
        to = os.path.join(tempfile.mkdtemp(prefix="tracewell-"), "tracewell")
        sc.addPyFile(shutil.make_archive(to, "zip", root, os.path.basename(package)))
    sc._tracewell_shipped = True
