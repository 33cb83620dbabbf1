"""Rows for spreadsheets, and the ways out (R-26..R-29)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of the export, in order.
HEADERS = ("Type", "Last Name", "First Name", "User ID", "User Status", "Email Address", "Entitlement Display Name", "Entitlement", "Resource Type", "Resource Name", "Entitlement Description", "Entitlement Slug")
COLUMNS = ("row_type", *(h.lower().replace(" ", "_") for h in HEADERS[1:]))


def status_name(status: Column) -> Column:
    return F.when(status.isNull(), "Enabled").when(status.isin("ENABLED", "DISABLED", "DELETED"), F.initcap(status)).otherwise("Unknown")


def csv_rows(resource_types: DataFrame, resources: DataFrame, entitlements: DataFrame, grants: DataFrame) -> DataFrame:
    """R-26: identities, entitlements and grants of users, one table. Grants of others than users are left out; one whose entitlement
    is missing shows its id alone."""
    text = lambda c: F.coalesce(c, F.lit(""))
    field = lambda n: text(F.get_json_object("profile", f"$.{n}"))
    primary = text(F.get(F.filter("user_trait.emails", lambda e: e["is_primary"]), F.lit(0))["address"])
    users = resources.where(F.col("user_trait").isNotNull())
    identity = [field("last_name").alias("last_name"), field("first_name").alias("first_name"), field("user_id").alias("user_id"), primary.alias("email_address")]
    types = resource_types.where(F.array_contains("traits", "USER")).select(F.col("external_id").alias("resource_type_id"))
    people = users.join(types, "resource_type_id", "left_semi").select(F.lit("Identity").alias("row_type"), *identity, status_name(F.col("status")).alias("user_status"))
    names = resources.select("resource_type_id", "resource_id", F.col("display_name").alias("resource_name"))
    held = entitlements.join(names, ["resource_type_id", "resource_id"], "left").select(text(F.col("display_name")).alias("entitlement_display_name"), F.col("external_id").alias("entitlement"), F.col("resource_type_id").alias("resource_type"), text(F.col("resource_name")).alias("resource_name"), text(F.col("description")).alias("entitlement_description"), text(F.col("slug")).alias("entitlement_slug"))
    holders = users.select(F.col("resource_type_id").alias("principal_resource_type_id"), F.col("resource_id").alias("principal_resource_id"), *identity)
    own = grants.select(F.col("entitlement_id").alias("entitlement"), F.col("resource_type_id").alias("own_type"), "principal_resource_type_id", "principal_resource_id").join(holders, ["principal_resource_type_id", "principal_resource_id"])
    own = own.join(held, "entitlement", "left").withColumn("resource_type", F.coalesce("resource_type", "own_type")).withColumn("row_type", F.lit("Grant"))
    shaped = lambda df: df.select(*((text(F.col(c)) if c in df.columns else F.lit("")).alias(c) for c in COLUMNS))
    return shaped(people).unionByName(shaped(held.withColumn("row_type", F.lit("Entitlement")))).unionByName(shaped(own))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.toDF(*HEADERS).write.mode("overwrite").option("header", True).csv(path)


def write_xlsx(rows: DataFrame, path: str, most: int = 1_048_575) -> None:
    """R-27: a sheet holds so many rows; more are an error. Needs a spreadsheet writer of pandas."""
    head = rows.limit(most + 1).toDF(*HEADERS).toPandas()
    if len(head) > most:
        raise ValueError(f"a sheet holds {most} rows")
    head.to_excel(Path(path), index=False)


def json_lines(df: DataFrame) -> DataFrame:
    """R-28."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
