"""An access graph projected from the star-schema tables.

Regions and nations are groups (a nation's parent is its region, a region's the organisation), customers are people, suppliers
service accounts, parts applications. Members of a nation reach its region's membership and that the organisation's, by expandable
grants whose first hop is filtered to customers where the nation's key divides by three, and whose second is shallow where the region's is odd.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import dealt, tasks
from ..schemas import schema

OLD, NEW = "sync-1", "sync-2"
CUTOFF = "1998-01-01"
BEGIN = "1995-01-01"


@dataclass
class Graph:
    """The tables of one snapshot."""

    resource_types: DataFrame
    resources: DataFrame
    entitlements: DataFrame
    grants: DataFrame


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the columns of the table, in order; those that it lacks are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)))


def text(c: str) -> Column:
    return F.col(c).cast("string")


def ref(kind: str, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("resource_type_id"), key.alias("resource_id"))


def mail(name: str) -> Column:
    return F.concat(F.lower(F.replace(F.col(name), F.lit("#"), F.lit("."))), F.lit("@example.com"))


def user(name: str, account: str) -> Column:
    emails = F.array(F.struct(mail(name).alias("address"), F.lit(True).alias("is_primary")))
    return F.struct(emails.alias("emails"), F.lit(account).alias("account_type"), F.lower(F.col(name)).alias("login"))


def resource_types(spark: SparkSession) -> DataFrame:
    rows = [("customer", "Customer", ["USER"]), ("nation", "Nation", ["GROUP"]), ("org", "Organisation", ["GROUP"]), ("part", "Part", ["APP"]), ("region", "Region", ["GROUP"]), ("supplier", "Supplier", ["USER"])]
    return conform(spark.createDataFrame(rows, "external_id string, display_name string, traits array<string>"), "resource_types")


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit(BEGIN).cast("timestamp").alias("discovered_at")
    t = lambda name: read(spark, sf_dir, name)
    org = spark.range(1).select(F.lit("org").alias("resource_type_id"), F.lit("0").alias("resource_id"), F.lit("Organisation").alias("display_name"), F.array(F.lit("region")).alias("child_type_ids"), at)
    region = t("region").select(F.lit("region").alias("resource_type_id"), text("r_regionkey").alias("resource_id"), F.col("r_name").alias("display_name"), ref("org", F.lit("0")).alias("parent"), F.array(F.lit("nation")).alias("child_type_ids"), at)
    nation = t("nation").select(F.lit("nation").alias("resource_type_id"), text("n_nationkey").alias("resource_id"), F.col("n_name").alias("display_name"), ref("region", text("n_regionkey")).alias("parent"), at)
    status = F.when(F.col("c_custkey") % 10 == 0, "DISABLED").when(F.col("c_custkey") % 10 == 1, "ENABLED")
    profile = F.to_json(F.struct(F.lit("Customer").alias("first_name"), F.col("c_name").alias("last_name"), text("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")))
    customer = t("customer").select(F.lit("customer").alias("resource_type_id"), text("c_custkey").alias("resource_id"), F.col("c_name").alias("display_name"), ref("nation", text("c_nationkey")).alias("parent"), status.alias("status"), profile.alias("profile"), user("c_name", "human").alias("user_trait"), at)
    supplier = t("supplier").select(F.lit("supplier").alias("resource_type_id"), text("s_suppkey").alias("resource_id"), F.col("s_name").alias("display_name"), ref("nation", text("s_nationkey")).alias("parent"), F.to_json(F.struct(text("s_suppkey").alias("user_id"))).alias("profile"), user("s_name", "service").alias("user_trait"), at)
    part = t("part").select(F.lit("part").alias("resource_type_id"), text("p_partkey").alias("resource_id"), F.col("p_name").alias("display_name"), F.col("p_type").alias("description"), at)
    out = None
    for df in (org, region, nation, customer, supplier, part):
        df = conform(df, "resources")
        out = df if out is None else out.unionByName(df)
    return out


def entitlements(resources: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of organisation, regions and nations; buyers and suppliers of parts. Exclusion groups: one for geography (which
    spans resource types), one for each brand's buyers."""
    groups = resources.where(F.col("resource_type_id").isin("org", "region", "nation")).select("resource_type_id", "resource_id", F.lit("member").alias("slug"), F.when(F.col("resource_type_id") != "org", F.lit("geography")).alias("group"), F.lit(0).alias("order"), F.lit(False).alias("first"))
    parts = read(spark, sf_dir, "part")
    buyer = parts.select(F.lit("part").alias("resource_type_id"), text("p_partkey").alias("resource_id"), F.lit("buyer").alias("slug"), F.col("p_brand").alias("group"), F.col("p_size").cast("int").alias("order"), (F.col("p_size") % 10 == 0).alias("first"))
    supplier = buyer.select("resource_type_id", "resource_id", F.lit("supplier").alias("slug"), F.lit(None).cast("string").alias("group"), "order", F.lit(False).alias("first"))
    df = groups.unionByName(buyer).unionByName(supplier)
    own = F.when(F.col("group").isNotNull(), F.array(F.struct(F.col("group").alias("id"), F.col("order"), F.col("first").alias("is_default"))))
    label = F.concat_ws(" ", F.initcap("slug"), F.lit("of"), "resource_type_id", "resource_id")
    return conform(df.select("*", F.concat_ws(":", "resource_type_id", "resource_id", "slug").alias("external_id"), label.alias("display_name"), own.alias("exclusion_groups"), F.lit(BEGIN).alias("discovered_at")), "entitlements")


def grant(kind: str, rid: Column, slug: str, by: str, pid: Column, at: Column, expansion: Column | None = None) -> list[Column]:
    entitlement = F.concat_ws(":", F.lit(kind), rid, F.lit(slug))
    return [
        F.concat_ws(":", entitlement, F.lit(by), pid).alias("external_id"),
        entitlement.alias("entitlement_id"),
        F.lit(kind).alias("resource_type_id"),
        rid.alias("resource_id"),
        F.lit(by).alias("principal_resource_type_id"),
        pid.alias("principal_resource_id"),
        (expansion if expansion is not None else F.lit(None)).alias("expansion"),
        F.lit(expansion is not None).alias("needs_expansion"),
        at.cast("timestamp").alias("discovered_at"),
    ]


def expansion(source: Column, shallow: Column, kinds: Column) -> Column:
    return F.struct(F.array(source).alias("entitlement_ids"), shallow.alias("shallow"), kinds.alias("resource_type_ids"))


def grants(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """Direct and expandable grants; before: only of orders before that date."""
    t = lambda name: read(spark, sf_dir, name)
    begin = F.lit(BEGIN)
    everyone = F.array().cast("array<string>")
    nations = t("nation")
    orders = t("orders").where(F.col("o_orderdate") < before) if before else t("orders")
    n = tasks(orders.crossJoin(t("lineitem")))
    ordered, lines = orders.repartition(n, "o_orderkey"), t("lineitem").repartition(n, "l_orderkey")
    pairs = lines.join(ordered.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey", "o_orderdate")
    bought = dealt(pairs, "o_custkey", "l_partkey").groupBy("o_custkey", "l_partkey").agg(F.min("o_orderdate").alias("at"))
    sold = dealt(t("lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey").distinct()
    even = t("supplier").where("s_suppkey % 2 = 0").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    parts = [
        t("customer").select(*grant("nation", text("c_nationkey"), "member", "customer", text("c_custkey"), begin)),
        t("supplier").select(*grant("nation", text("s_nationkey"), "member", "supplier", text("s_suppkey"), begin)),
        even.select(*grant("region", text("n_regionkey"), "member", "supplier", text("s_suppkey"), begin)),
        bought.select(*grant("part", text("l_partkey"), "buyer", "customer", text("o_custkey"), F.col("at"))),
        sold.select(*grant("part", text("l_partkey"), "supplier", "supplier", text("l_suppkey"), begin)),
        nations.select(*grant("region", text("n_regionkey"), "member", "nation", text("n_nationkey"), begin, expansion(F.concat(F.lit("nation:"), text("n_nationkey"), F.lit(":member")), F.lit(False), F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("customer"))).otherwise(everyone)))),
        t("region").select(*grant("org", F.lit("0"), "member", "region", text("r_regionkey"), begin, expansion(F.concat(F.lit("region:"), text("r_regionkey"), F.lit(":member")), F.col("r_regionkey") % 2 == 1, everyone))),
    ]
    out = None
    for df in parts:
        df = conform(df.withColumns({"sources": F.create_map().cast("map<string,boolean>"), "immutable": F.lit(False), "insert_resource": F.lit(False)}), "grants")
        out = df if out is None else out.unionByName(df)
    return out


def graph(spark: SparkSession, sf_dir: str, sync_id: str = NEW) -> Graph:
    """The snapshot NEW of all orders, or OLD of those before CUTOFF."""
    stamp = lambda df: df.withColumn("sync_id", F.lit(sync_id))
    rs = stamp(resources(spark, sf_dir))
    return Graph(stamp(resource_types(spark)), rs, stamp(entitlements(rs, spark, sf_dir)), stamp(grants(spark, sf_dir, CUTOFF if sync_id == OLD else None)))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signup grants, error revokes, anything else is use."""
    df = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "create_grant").when(F.col("event_type") == "error", "create_revoke").otherwise("usage")
    return conform(
        df.select(
            F.lit("star").alias("feed_id"),
            text("event_id").alias("event_id"),
            F.col("ts").cast("timestamp").alias("occurred_at"),
            kind.alias("event_type"),
            F.concat(F.lit("part:"), (F.col("event_id") % 20).cast("string"), F.lit(":buyer")).alias("entitlement_id"),
            F.lit("customer").alias("principal_resource_type_id"),
            text("user_id").alias("principal_resource_id"),
            F.col("props").alias("payload"),
        ),
        "events",
    )
