"""Snapshots as directories of Parquet, one per table, partitioned by sync_id (R-01..R-03, R-17, R-22, R-25, R-29, R-30).

A run counts once its row is in sync_runs, which is written last: what an interrupted write leaves is not seen.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES, schema

FORMAT = "parquet"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, table: str, sync_id: str = "") -> DataFrame:
        """A table, of one run if one is named: the partition filter prunes the others' files."""
        try:
            df = self.spark.read.schema(schema(table)).option("mergeSchema", "false").parquet(f"{self.path}/{table}")
        except AnalysisException:
            df = self.spark.createDataFrame([], schema(table))
        return df.where(F.col("sync_id") == sync_id) if sync_id else df

    def runs(self) -> DataFrame:
        return self.read("sync_runs")

    def put(self, table: str, rows: DataFrame) -> None:
        """Replaces the partitions of the runs that rows belong to (R-101). Runs themselves are added by finish()."""
        if table == "sync_runs":
            raise ValueError("sync_runs is written by finish(): replacing it would erase all other runs")
        names = [f.name for f in schema(table)]
        out = rows.select(*(F.col(n).cast(schema(table)[n].dataType) if n in rows.columns else F.lit(None).cast(schema(table)[n].dataType).alias(n) for n in names))
        out.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("sync_id").parquet(f"{self.path}/{table}")

    def finish(self, run: DataFrame) -> None:
        """Adds a run's row; only now its tables are to be found. A run that is there already is left as it is."""
        names = [f.name for f in schema("sync_runs")]
        run = run.join(self.runs().select("sync_id"), "sync_id", "left_anti")
        run.select(*(F.col(n).cast(schema("sync_runs")[n].dataType) if n in run.columns else F.lit(None).cast(schema("sync_runs")[n].dataType).alias(n) for n in names)).write.mode("append").parquet(f"{self.path}/sync_runs")

    def copy(self, sync_id: str, path: str) -> None:
        """R-29: one run alone, in a store of its own."""
        other = Store(self.spark, path)
        for table in TABLES:
            if table != "sync_runs":
                other.put(table, self.read(table, sync_id))
        other.finish(self.runs().where(F.col("sync_id") == sync_id))

    def convert(self, path: str, sync_id: str) -> DataFrame:
        """R-30: as copy(), with a report of the runs that were left behind."""
        self.copy(sync_id, path)
        return self.runs().where(F.col("sync_id") != sync_id).select("sync_id", "sync_type", F.when(F.col("ended_at").isNull(), "unfinished").otherwise("not chosen").alias("reason"))
