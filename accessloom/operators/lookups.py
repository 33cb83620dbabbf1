"""Hydrating lookups and effective access (R-43..R-51, R-57, R-58)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import dealt

PRINCIPAL = ["principal_resource_type_id", "principal_resource_id"]
RESOURCE = ["resource_type_id", "resource_id"]


def missing(kind: str, *key: Column) -> Column:
    """What stands for a row that a lookup does not find."""
    return F.concat(F.lit(f"MISSING {kind} ("), F.concat_ws(":", *key), F.lit(")"))


def named(df: DataFrame, resources: DataFrame, key: list[str], alias: str, kind: str = "RESOURCE") -> DataFrame:
    """df with the display name of the resource that key refers to."""
    names = resources.select(F.col("resource_type_id").alias("_t"), F.col("resource_id").alias("_r"), F.col("display_name").alias("_name"))
    joined = df.join(names, (df[key[0]] == names["_t"]) & (df[key[1]] == names["_r"]), "left")
    return joined.withColumn(alias, F.coalesce("_name", missing(kind, *(F.col(k) for k in key)))).drop("_t", "_r", "_name")


def typed(df: DataFrame, resource_types: DataFrame, key: str, alias: str) -> DataFrame:
    names = resource_types.select(F.col("external_id").alias("_t"), F.col("display_name").alias("_name"))
    joined = df.join(names, df[key] == names["_t"], "left")
    return joined.withColumn(alias, F.coalesce("_name", missing("RESOURCE TYPE", F.col(key)))).drop("_t", "_name")


def hydrate_grants(grants: DataFrame, entitlements: DataFrame, resources: DataFrame, resource_types: DataFrame) -> DataFrame:
    """R-43: grants with the names of entitlement, principal, resource and their types; none is dropped."""
    ents = entitlements.select(F.col("external_id").alias("_e"), F.col("display_name").alias("_name"))
    df = grants.join(ents, grants["entitlement_id"] == ents["_e"], "left")
    df = df.withColumn("entitlement_name", F.coalesce("_name", missing("ENTITLEMENT", F.col("entitlement_id")))).drop("_e", "_name")
    df = named(df, resources, PRINCIPAL, "principal_name")
    df = named(df, resources, RESOURCE, "resource_name")
    return typed(typed(df, resource_types, "resource_type_id", "resource_type_name"), resource_types, "principal_resource_type_id", "principal_type_name")


def hydrate_resources(resources: DataFrame, resource_types: DataFrame) -> DataFrame:
    """R-44: resources with the names of their type and parent (null without one)."""
    df = typed(resources.withColumns({"_pt": F.col("parent.resource_type_id"), "_pr": F.col("parent.resource_id")}), resource_types, "resource_type_id", "resource_type_name")
    df = named(df, resources, ["_pt", "_pr"], "parent_name")
    return df.withColumn("parent_name", F.when(F.col("parent").isNotNull(), F.col("parent_name"))).drop("_pt", "_pr")


def hydrate_entitlements(entitlements: DataFrame, resources: DataFrame, resource_types: DataFrame) -> DataFrame:
    """R-45."""
    return typed(named(entitlements, resources, RESOURCE, "resource_name"), resource_types, "resource_type_id", "resource_type_name")


def effective_access(grants: DataFrame, entitlements: DataFrame) -> DataFrame:
    """R-46: entitlement ids of each principal by resource, duplicates kept, in order."""
    own = grants.join(entitlements.select(F.col("external_id").alias("entitlement_id")), "entitlement_id")
    return own.groupBy(*PRINCIPAL, *RESOURCE).agg(F.sort_array(F.collect_list("entitlement_id")).alias("entitlements"))


def access_for_resource(grants: DataFrame, resource_type_id: str, resource_id: str) -> DataFrame:
    """R-47: the entitlements of each principal on a resource."""
    own = grants.where((F.col("resource_type_id") == resource_type_id) & (F.col("resource_id") == resource_id))
    return own.groupBy(*PRINCIPAL).agg(F.sort_array(F.collect_list("entitlement_id")).alias("entitlements"))


def access_counts(grants: DataFrame) -> DataFrame:
    """R-47: distinct principals of each resource by their type."""
    once = dealt(grants.select(*RESOURCE, *PRINCIPAL), *RESOURCE, *PRINCIPAL).distinct()
    return once.groupBy(*RESOURCE, "principal_resource_type_id").agg(F.count("principal_resource_id").alias("principals"))


def principals(grants: DataFrame, resources: DataFrame) -> DataFrame:
    """R-48: the resources that hold a grant, each once."""
    keys = grants.select(*(F.col(c).alias(k) for c, k in zip(PRINCIPAL, RESOURCE, strict=True))).distinct()
    return resources.join(keys, RESOURCE, "left_semi")


def user_types(resource_types: DataFrame) -> DataFrame:
    """Types whose first trait is USER."""
    return resource_types.where(F.get("traits", F.lit(0)) == "USER").select(F.col("external_id").alias("resource_type_id"))


def user_principals(grants: DataFrame, resources: DataFrame, resource_types: DataFrame) -> DataFrame:
    """R-49."""
    return principals(grants, resources).join(user_types(resource_types), "resource_type_id", "left_semi")


def user_counts(grants: DataFrame, resources: DataFrame, resource_types: DataFrame) -> DataFrame:
    """R-50: every resource with its number of distinct user principals, zero included."""
    users = grants.join(user_types(resource_types).withColumnRenamed("resource_type_id", "principal_resource_type_id"), "principal_resource_type_id", "left_semi")
    once = dealt(users.select(*RESOURCE, *PRINCIPAL), *RESOURCE, *PRINCIPAL).distinct()
    counts = once.groupBy(*RESOURCE).agg(F.count(F.lit(1)).alias("n"))
    return resources.join(counts.hint("merge"), RESOURCE, "left").withColumn("users", F.coalesce("n", F.lit(0))).drop("n")


def emails_of(df: DataFrame) -> Column:
    return F.transform("user_trait.emails", lambda e: F.lower(e["address"]))


def matched_principals(base: DataFrame, compared: DataFrame) -> DataFrame:
    """R-51: for each base principal the least compared one that is the same: equal key, else (both or neither a user) an equal
    email or display name. The alternatives are equi-joins, never a comparison of all with all."""
    left = base.select(F.struct(*RESOURCE).alias("base"), "display_name", F.col("user_trait").isNotNull().alias("user"), emails_of(base).alias("emails"))
    right = compared.select(F.struct(*RESOURCE).alias("compared"), "display_name", F.col("user_trait").isNotNull().alias("user"), emails_of(compared).alias("emails"))
    by_key = left.join(right, left["base"] == right["compared"]).select("base", "compared")
    by_name = left.join(right, (left["display_name"] == right["display_name"]) & (left["user"] == right["user"]) & (left["display_name"] != "")).select("base", "compared")
    mail = lambda df, c: df.where("user").select(c, F.explode("emails").alias("email"))
    by_mail = mail(left, "base").join(mail(right, "compared"), "email").select("base", "compared")
    found = by_key.union(by_name).union(by_mail)
    return found.groupBy("base").agg(F.min("compared").alias("compared"))


def compare_principals(base: DataFrame, compared: DataFrame) -> DataFrame:
    """R-51: base principals that are missing in compared, and compared ones that no base principal matches (extra)."""
    found = matched_principals(base, compared)
    keys = lambda df: df.select(F.struct(*RESOURCE).alias("key"))
    gone = keys(base).join(found, F.col("key") == F.col("base"), "left_anti").select("key.*", F.lit("missing").alias("side"))
    more = keys(compared).join(found, F.col("key") == F.col("compared"), "left_anti").select("key.*", F.lit("extra").alias("side"))
    return gone.union(more)


def child_schedule(resources: DataFrame) -> DataFrame:
    """R-58: each (child type, parent) to collect, once."""
    return resources.select(F.explode("child_type_ids").alias("child_type_id"), F.col("resource_type_id").alias("parent_type_id"), F.col("resource_id").alias("parent_id")).distinct()


def reconciled_external(stored: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R-57: the external principals after a new collection, and the stale ones that it drops."""
    stale = stored.join(current.select(*RESOURCE), RESOURCE, "left_anti")
    return current.unionByName(stored.limit(0)), stale


def source_cache_hits(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """R-56: rows whose validator equals the manifest's for their scope."""
    return rows.join(manifest.select("row_kind", "scope_key", "validator"), ["row_kind", "scope_key", "validator"], "left_semi")
