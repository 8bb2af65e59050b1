"""Where intermediate tables live, and how they are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own; a cluster session without it
    is refused, because executors on other machines could not see a local folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        base = tempfile.mkdtemp(prefix="spendaudit-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/spendaudit/{sc.applicationId}"


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan with at least one partition per core.

    A table stored as few blocks would otherwise keep every following step on a few cores. Tables with
    enough blocks, as any large one has, are returned as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, keeps column pruning and filter pushdown
    for later readers, and gives the optimizer the true size: a table that turns out small is
    broadcast by Spark's own size check, a large one is not.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)  # takes about two thirds of the disk of the default
    return spark.read.schema(df.schema).parquet(path)


def remove_intermediate(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. DataFrames that read them can't be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
