"""Cutting a plan's lineage with tables in the folder that the cluster shares, and dealing rows out by the size of the input."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """df as a table in spark.checkpoint.dir: later reads survive lost executors. Where that is unset and all runs in one JVM (as in
    tests), one is set; elsewhere its lack is an error: executors would write to their own disks."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file:///tmp/checkpoints/{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of input files for one task.
DEAL = 8 << 20


def tasks(df: DataFrame) -> int:
    """How many tasks to deal df's rows out to: one for each DEAL bytes of its input files, but every core has one."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    least = spark.sparkContext.defaultParallelism
    if any(x >= 1 << 50 for x in sizes):  # of a source that does not know its size
        least = max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, sum(x for x in sizes if x < 1 << 50) // DEAL)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys before they are grouped. Narrow rows shrink tenfold in a shuffle and grow back in hash maps: partitions
    that adaptive execution has joined to 64 MB take a GB of a task's memory. A number of partitions that is given is kept."""
    return df.repartition(tasks(df), *keys)
