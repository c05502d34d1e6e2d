"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir`` where the cluster names one.

    Only a local session without that setting gets a folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), f"biblioforge-{spark.sparkContext.applicationId}")
    return at


def store(df: DataFrame) -> DataFrame:
    """Cut lineage by a table written to the shared folder: columnar and compressed, so smaller than a checkpoint.

    It survives the loss of executors and goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def merged(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join by sorted shuffles. Spark judges stored tables by their compressed size, so a plain join may send one of millions of rows through the driver."""
    return left.join(right.hint("merge"), on, how)


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Rows over all cores before costly Python work, only where the scan gives fewer partitions than cores, as for one small file."""
    n = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
