"""What the corpus operators share: reading tables, cutting lineage, worker environment."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: blank and \t \n \v \f \r.
SPACE = " \t\n\u000b\f\r"
SPACE_RE = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Lets local Python workers import this package wherever the driver was started (clusters get it by --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the folder that the cluster shares: its lineage ends there and survives lost executors.

    The folder is spark.checkpoint.dir; where that is unset and all runs in one JVM (tests), one is set. Elsewhere its lack is
    an error: executors would write to their own disks.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file:///tmp/checkpoints/{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(wanted: str, taken: list[str]) -> str:
    """wanted, with as many underscores added as no column of taken has (names are compared as Spark does, without case)."""
    held = {c.lower() for c in taken}
    while wanted.lower() in held:
        wanted += "_"
    return wanted


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words between white space, in order; an empty array for none."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def over(frame: DataFrame, fn, schema: str) -> DataFrame:
    """frame.mapInArrow(fn) with what its workers need."""
    ready(frame.sparkSession)
    return frame.mapInArrow(fn, schema)
