"""References and exclusion groups that a snapshot must keep (R-120..R-128)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EXAMPLES, MEMBERS = 25, 50
RESOURCE = ["resource_type_id", "resource_id"]


def dangling_grant_resources(grants: DataFrame, resources: DataFrame) -> DataFrame:
    """R-120: resources that grants refer to and that are not there; soft unless a grant inserts its resource."""
    refs = grants.groupBy(*RESOURCE).agg(F.count(F.lit(1)).alias("grants"), F.bool_or("insert_resource").alias("inserts"))
    return refs.join(resources.select(*RESOURCE), RESOURCE, "left_anti")


def unscheduled_children(scheduled: DataFrame, done: DataFrame) -> DataFrame:
    """R-121: (child type, parent) pairs that were to be collected and were not."""
    key = ["child_type_id", "parent_type_id", "parent_id"]
    return scheduled.join(done.select(*key), key, "left_anti")


def exclusion_violations(entitlements: DataFrame) -> DataFrame:
    """R-122: group and rule: several_types, several_defaults, too_many members."""
    own = entitlements.select("external_id", "resource_type_id", F.explode("exclusion_groups").alias("g"))
    groups = own.groupBy(F.col("g.id").alias("group_id")).agg(
        F.count_distinct("resource_type_id").alias("types"),
        F.count_distinct(F.when(F.col("g.is_default"), F.col("external_id"))).alias("defaults"),
        F.count_distinct("external_id").alias("members"),
    )
    broken = F.array_compact(F.array(F.when(F.col("types") > 1, "several_types"), F.when(F.col("defaults") > 1, "several_defaults"), F.when(F.col("members") > MEMBERS, "too_many")))
    return groups.select("group_id", F.explode(broken).alias("rule"))


def dangling_entitlements(entitlements: DataFrame, resources: DataFrame) -> DataFrame:
    """R-123."""
    return entitlements.groupBy(*RESOURCE).agg(F.count(F.lit(1)).alias("entitlements")).join(resources.select(*RESOURCE), RESOURCE, "left_anti")


def dangling_grant_entitlements(grants: DataFrame, entitlements: DataFrame) -> DataFrame:
    """R-124: entitlements that grants refer to and that are not there, unless all such grants insert them."""
    refs = grants.groupBy("entitlement_id").agg(F.count(F.lit(1)).alias("grants"), F.bool_and(F.coalesce("insert_resource", F.lit(False))).alias("all_insert"))
    known = entitlements.select(F.col("external_id").alias("entitlement_id"))
    return refs.where("not all_insert").join(known, "entitlement_id", "left_anti").drop("all_insert")


def dangling_grant_principals(grants: DataFrame, resources: DataFrame) -> DataFrame:
    """R-125: principals that are not there, of grants that are not for matching with another directory."""
    refs = grants.where(F.col("external_match").isNull()).groupBy(F.col("principal_resource_type_id").alias("resource_type_id"), F.col("principal_resource_id").alias("resource_id")).agg(F.count(F.lit(1)).alias("grants"))
    return refs.join(resources.select(*RESOURCE), RESOURCE, "left_anti")


def undrained(spawned: DataFrame, drained: DataFrame) -> DataFrame:
    """R-126: cursors that were spawned and never finished."""
    return spawned.join(drained, "cursor_id", "left_anti")


def attributed(dangling: DataFrame, resource_types: DataFrame) -> DataFrame:
    """R-127: by type: a type that was never collected is a gap of configuration, else it is a bug; count and first examples."""
    known = resource_types.select(F.col("external_id").alias("known"))
    judged = dangling.join(known, F.col("resource_type_id") == F.col("known"), "left").withColumn("cause", F.when(F.col("known").isNull(), "type never collected").otherwise("row missing"))
    few = judged.withColumn("r", F.row_number().over(W.partitionBy("resource_type_id").orderBy("resource_id"))).where(F.col("r") <= EXAMPLES)
    examples = few.groupBy("resource_type_id").agg(F.sort_array(F.collect_list("resource_id")).alias("examples"))
    return judged.groupBy("resource_type_id", "cause").agg(F.count(F.lit(1)).alias("n")).join(examples, "resource_type_id")


#: R-128: the checks of a run of each kind.
CHECKS = {"full": ("I3", "I4", "I5", "I7", "I8", "I9", "I10"), "partial": ("I5", "I10"), "resources_only": ("I5", "I10")}


def verdicts(graph, sync_type: str = "full") -> DataFrame:
    """Each check of the run with its number of violations; I4 and I10 are the collector's, which knows what was scheduled."""
    found = {
        "I3": dangling_grant_resources(graph.grants, graph.resources),
        "I5": exclusion_violations(graph.entitlements),
        "I7": dangling_entitlements(graph.entitlements, graph.resources),
        "I8": dangling_grant_entitlements(graph.grants, graph.entitlements),
        "I9": dangling_grant_principals(graph.grants, graph.resources),
    }
    out = None
    for name in CHECKS.get(sync_type, CHECKS["partial"]):
        if name in found:
            row = found[name].agg(F.lit(name).alias("invariant"), F.count(F.lit(1)).alias("violations"))
            out = row if out is None else out.union(row)
    return out
