"""Counts and distributions (R-60..R-68)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by_type(df: DataFrame, column: str = "resource_type_id", name: str = "n") -> DataFrame:
    """R-61."""
    return df.groupBy(F.col(column).alias("resource_type_id")).agg(F.count(F.lit(1)).alias(name))


def grant_stats(grants: DataFrame) -> DataFrame:
    """R-62: grants by the type of their entitlement's resource."""
    return count_by_type(grants, "resource_type_id", "grants")


def sync_stats(resource_types: DataFrame, resources: DataFrame, entitlements: DataFrame, grants: DataFrame, assets: DataFrame | None = None, sync_type: str = "full") -> DataFrame:
    """R-60, R-63, R-65: item, resource_type_id (null for totals) and n. Resources are zero-filled over the known types and
    of unknown types left out; entitlements and grants are not; resources_only runs have neither."""
    types = resource_types.select(F.col("external_id").alias("resource_type_id"))
    per = types.join(count_by_type(resources), "resource_type_id", "left").select(F.lit("resources").alias("item"), "resource_type_id", F.coalesce("n", F.lit(0)).alias("n"))
    total = lambda item, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(item).alias("item"), F.lit(None).cast("string").alias("resource_type_id"), "n")
    out = per.union(total("resource_types", resource_types))
    if sync_type != "resources_only":
        for item, df in (("entitlements", entitlements), ("grants", grants)):
            out = out.union(count_by_type(df).select(F.lit(item).alias("item"), "resource_type_id", "n"))
    return out.union(total("assets", assets)) if assets is not None else out


def merged_timings(parts: DataFrame) -> DataFrame:
    """R-66: calls by bucket over any number of runs."""
    sums = [F.sum(c).alias(c) for c in ("count", "total_ms", "errors", "timeouts")]
    return parts.groupBy("bucket").agg(*sums, F.max("max_ms").alias("max_ms"))


def fan_distribution(edges: DataFrame) -> DataFrame:
    """R-67: how many edges come into (in) and leave (out) an entitlement: maximum, nearest-rank percentiles, wide ones."""
    out = None
    for side, column in (("in", "dst"), ("out", "src")):
        n = edges.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        rank = [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY n)").cast("long").alias(f"p{p}") for p in (50, 90, 99)]
        wide = [F.count_if(F.col("n") >= k).alias(f"at_least_{k}") for k in (128, 256, 512, 1024)]
        row = n.agg(F.lit(side).alias("side"), F.max("n").alias("most"), *rank, *wide)
        out = row if out is None else out.union(row)
    return out


def dropped_edges(dropped: DataFrame, examples: int = 5) -> DataFrame:
    """R-68: dropped edges by reason with the first distinct examples. The examples are bounded before they meet in one row."""
    ids = dropped.select("reason", F.concat_ws(" -> ", "src", "dst").alias("edge"))
    counts = ids.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window as W

    few = ids.distinct().withColumn("r", F.row_number().over(W.partitionBy("reason").orderBy("edge"))).where(F.col("r") <= examples)
    return counts.join(few.groupBy("reason").agg(F.sort_array(F.collect_list("edge")).alias("examples")), "reason")
