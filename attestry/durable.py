"""Intermediate tables that survive a lost executor, Parquet in the folder that the cluster shares; whole files in bounded batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of whole files that a task of Python is sent at once.
BATCH_ROWS = 256
#: How many times larger than its files a written table is in memory.
IN_MEMORY = 40


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="attestry-")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder under spark.checkpoint.dir. Where that is unset a temporary one, on a local master alone: executors elsewhere would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return f"{(root or _own_dir()).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df, computed once and read back: its lineage ends here and later joins know its size."""
    path = shared_dir(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """df for a join that shuffles both sides. A written table is IN_MEMORY times larger than its files, by which Spark would send it whole through the driver."""
    return df.hint("merge")


@contextmanager
def sized_in_memory(spark: SparkSession) -> Iterator[None]:
    """What is run within takes tables for IN_MEMORY times their files, so that only what is small in memory goes through the driver; sizes met at run time are Spark's own."""
    key = "spark.sql.sources.fileCompressionFactor"
    before = spark.conf.get(key)
    spark.conf.set(key, str(float(IN_MEMORY)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def numbered(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """df with its place (int) in the order of by, from 1: first by ranges, then within each, so that no task sorts all."""
    ranged = kept(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    base = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return ranged.withColumn(name, place).join(F.broadcast(base), "_range").withColumn(name, (F.col("_before") + F.col(name)).cast("int")).drop("_range", "_before")


def bucketed(df: DataFrame, key: str | list[str], tag: str) -> DataFrame:
    """df, computed once, in buckets of its key, so that joins by the key shuffle their other side alone. df should come partitioned by the key, as from an aggregation by it."""
    spark, name = df.sparkSession, f"{tag.replace('-', '_')}_{uuid.uuid4().hex}"
    parts, keys = int(spark.conf.get("spark.sql.shuffle.partitions")), [key] if isinstance(key, str) else key
    df.write.bucketBy(parts, *keys).sortBy(*keys).option("compression", "zstd").option("path", shared_dir(spark, tag)).saveAsTable(name)
    return spark.table(name)


def in_batches(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """rows.mapInArrow for rows that hold whole files: at most BATCH_ROWS of them are in memory at once, on either side."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return rows.mapInArrow(run, schema)
