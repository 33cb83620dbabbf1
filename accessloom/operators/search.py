"""Expression search (R-33..R-35)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import compiled
from ..functions.records import profile_fields

PRINCIPAL = ["principal_resource_type_id", "principal_resource_id"]
RESOURCE = ["resource_type_id", "resource_id"]


def resource_variables(prefix: str = "resource", at: str = "") -> dict[str, Column]:
    c = lambda n: F.col(f"{at}{n}")
    return {f"{prefix}.display_name": c("display_name"), f"{prefix}.id": c("resource_id"), f"{prefix}.type": c("resource_type_id"), f"{prefix}.profile": profile_fields(c("profile"), c("user_trait"))}


def search_resources(resources: DataFrame, expression: str, resource_type_id: str = "") -> DataFrame:
    """R-33: resources for which the expression is true; where it can't be evaluated it is not."""
    df = resources.where(F.col("resource_type_id") == resource_type_id) if resource_type_id else resources
    return df.where(F.coalesce(compiled(expression, resource_variables()), F.lit(False)))


def joined(grants: DataFrame, entitlements: DataFrame, resources: DataFrame, expression: str) -> DataFrame:
    ents = entitlements.select(F.col("external_id").alias("entitlement_id"), F.struct("display_name", "slug", "external_id").alias("e"))
    whole = resources.select(F.col("resource_type_id").alias("principal_resource_type_id"), F.col("resource_id").alias("principal_resource_id"), F.struct("resource_type_id", "resource_id", "display_name", "profile", "user_trait").alias("p"))
    df = grants.join(ents, "entitlement_id").join(whole, PRINCIPAL)
    variables = {"entitlement.display_name": F.col("e.display_name"), "entitlement.slug": F.col("e.slug"), "entitlement.id": F.col("entitlement_id"), "resource.id": F.col("resource_id"), "resource.type": F.col("resource_type_id"), **resource_variables("principal", "p.")}
    return df.where(F.coalesce(compiled(expression, variables), F.lit(False)))


def search_grants(grants: DataFrame, entitlements: DataFrame, resources: DataFrame, expression: str, resource_type_id: str, resource_id: str, page: int = 0, after: tuple | None = None) -> DataFrame:
    """R-34: matching grants of a resource by principal; a page is so many principals."""
    own = grants.where((F.col("resource_type_id") == resource_type_id) & (F.col("resource_id") == resource_id))
    found = joined(own, entitlements, resources, expression).groupBy(*PRINCIPAL).agg(F.sort_array(F.collect_list("entitlement_id")).alias("entitlements"))
    if after is not None:
        found = found.where(F.struct(*PRINCIPAL) > F.struct(*map(F.lit, after)))
    return found.orderBy(*PRINCIPAL).limit(page) if page else found


def search_principal_grants(grants: DataFrame, entitlements: DataFrame, resources: DataFrame, expression: str, principal_type: str, principal_id: str) -> DataFrame:
    """R-35: matching grants of a principal by resource."""
    own = grants.where((F.col(PRINCIPAL[0]) == principal_type) & (F.col(PRINCIPAL[1]) == principal_id))
    return joined(own, entitlements, resources, expression).groupBy(*RESOURCE).agg(F.sort_array(F.collect_list("entitlement_id")).alias("entitlements"))
