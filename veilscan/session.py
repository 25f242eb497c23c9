"""Session helpers shared by all subpackages: table loading, the shared work folder, durable cuts of lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; a table is one parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where that is unset, a local folder serves a local
    master only; on a cluster it must be set."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"veilscan-{os.getuid()}")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


_made: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for a written intermediate table."""
    _made.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this process made; results not yet written or collected are lost with them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    gone = 0
    while _made:
        path = hadoop.Path(_made.pop())
        gone += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def written(df: DataFrame, label: str, partitions: list[str] | None = None) -> DataFrame:
    """Cut the lineage by writing a table to the shared folder and reading it back; survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    writer = df.write.mode("overwrite")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the input has fewer partitions than cores, as one small file has; else as it is, so
    that tables of many files are never shuffled. For work that is heavy per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
