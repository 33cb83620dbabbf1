"""What a fresh collection lets in (R-37..R-42)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_records(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """R-37: rows whose key columns are all set, and the number of the others."""
    good = F.lit(True)
    for k in keys:
        good = good & F.coalesce(F.col(k) != "", F.lit(False))
    return df.where(good), df.where(~good).agg(F.count(F.lit(1)).alias("dropped"))


def fresh_entitlements(entitlements: DataFrame, scheduled: DataFrame, sync_type: str = "full") -> DataFrame:
    """R-38: of full runs only entitlements of scheduled types; without a resource they stay."""
    if sync_type != "full":
        return entitlements
    types = scheduled.select(F.col("external_id").alias("_t"), F.lit(True).alias("_s"))
    out = entitlements.join(types, F.col("resource_type_id") == F.col("_t"), "left")
    return out.where(F.col("_s") | F.coalesce(F.col("resource_type_id") == "", F.lit(True))).drop("_t", "_s")


def judged_grants(grants: DataFrame, scheduled: DataFrame) -> DataFrame:
    """R-39: verdict ok, entitlement_type or principal_type (of grants that no other directory is to match)."""
    types = lambda a: scheduled.select(F.col("external_id").alias(a))
    df = grants.join(types("_e"), F.col("resource_type_id") == F.col("_e"), "left").join(types("_p"), F.col("principal_resource_type_id") == F.col("_p"), "left")
    verdict = F.when(F.col("_e").isNull(), "entitlement_type").when(F.col("_p").isNull() & F.col("external_match").isNull(), "principal_type").otherwise("ok")
    return df.withColumn("verdict", verdict).drop("_e", "_p")


def fresh_grants(grants: DataFrame, scheduled: DataFrame) -> DataFrame:
    """R-39, R-40."""
    return narrowed_expansions(judged_grants(grants, scheduled).where("verdict = 'ok'").drop("verdict"), scheduled)


def narrowed_expansions(grants: DataFrame, scheduled: DataFrame) -> DataFrame:
    """R-40: type filters without types that are not collected; a filter that nothing remains of ends the expansion (an
    empty one would let all through). All types are one row, joined to every grant."""
    types = scheduled.agg(F.collect_set(F.col("external_id").cast("string")).alias("_types"))
    kept = F.array_intersect("expansion.resource_type_ids", "_types")
    was = F.coalesce(F.size("expansion.resource_type_ids"), F.lit(0))
    none = F.lit(None).cast(grants.schema["expansion"].dataType)
    new = F.when((was > 0) & (F.size(kept) == 0), none).when(was > 0, F.col("expansion").withField("resource_type_ids", kept)).otherwise(F.col("expansion"))
    return grants.crossJoin(types).withColumn("expansion", new).drop("_types").withColumn("needs_expansion", F.col("needs_expansion") & F.col("expansion").isNotNull())


def discovered_resources(found: DataFrame, scheduled: DataFrame) -> DataFrame:
    """R-41: resources that grants bring along, of scheduled types."""
    return found.join(scheduled.select(F.col("external_id").alias("resource_type_id")), "resource_type_id", "left_semi")


def quality_counters(grants: DataFrame, entitlements: DataFrame, scheduled: DataFrame) -> DataFrame:
    """R-42: what was dropped and changed, one row; flags holds a bit for each kind."""
    judged = judged_grants(grants, scheduled)
    count = lambda v: F.count_if(F.col("verdict") == v).alias(f"dropped_{v}")
    flags = F.bit_or(F.when(F.col("verdict") == "entitlement_type", 1).when(F.col("verdict") == "principal_type", 2).otherwise(0)).alias("flags")
    return judged.agg(F.count(F.lit(1)).alias("grants"), count("entitlement_type"), count("principal_type"), flags)
