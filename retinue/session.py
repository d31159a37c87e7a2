"""Session set-up and the shared folder that jobs cut their lineage in."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit both a laptop and a cluster. Everything that depends on
#: the cluster (executors, memory, shared folder) comes from spark-submit.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "retinue", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_retinue_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="retinue-pkg-"), "retinue.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(archive)
    context._retinue_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``; a folder that was set on
    the context is taken too. Only a local session without either gets a
    temporary folder; on a cluster each machine would write to its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if getattr(context, "_retinue_root", None) is None:
        given = context._jsc.sc().getCheckpointDir()
        if given.isDefined():
            context._retinue_root = given.get().rstrip("/")
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            context._retinue_root = tempfile.mkdtemp(prefix="retinue-")
            context.setCheckpointDir(context._retinue_root)
        else:
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all machines share")
    return context._retinue_root


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path below :func:`shared_root`."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result feeds several jobs: the written table cuts the lineage,
    is not lost with an executor, and gives exact sizes to the next plan.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Give every core a share of a plain file scan before CPU-heavy row work.

    Only a scan of fewer splits than cores (few or unsplittable files) is
    redistributed; a large one already has more and is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


@contextmanager
def bucketed(df: DataFrame, label: str, *keys: str):
    """Write ``df``, already partitioned by ``keys``, as a table with that layout.

    Joins on the keys do not shuffle this side again. The catalog entry lives
    as long as the ``with`` block.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    writer = df.write.bucketBy(bucket_count(spark), *keys).sortBy(*keys)
    writer.option("path", path).format("parquet").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
