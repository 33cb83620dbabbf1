"""Listing, paging and fetching rows of a snapshot (R-04..R-20, R-31, R-130, R-131)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 10_000
BATCH = 128


def where(df: DataFrame, **equal: str | Iterable[str] | None) -> DataFrame:
    """R-31: rows whose columns equal (or are among) the given values; empty and None are no predicate."""
    for column, value in equal.items():
        if isinstance(value, str) and value:
            df = df.where(F.col(column) == value)
        elif value is not None and not isinstance(value, str) and (values := list(value)):
            df = df.where(F.col(column).isin(values))
    return df


def list_resource_types(resource_types: DataFrame, sync_id: str = "") -> DataFrame:
    """R-04."""
    return where(resource_types, sync_id=sync_id)


def list_resources(resources: DataFrame, resource_type_id: str = "", parent_type_id: str = "", parent_id: str = "") -> DataFrame:
    """R-05."""
    df = where(resources, resource_type_id=resource_type_id)
    return df.where((F.col("parent.resource_type_id") == parent_type_id) & (F.col("parent.resource_id") == parent_id)) if parent_id else df


def list_entitlements(entitlements: DataFrame, resource_type_id: str = "", resource_id: str = "") -> DataFrame:
    """R-06."""
    return where(entitlements, resource_type_id=resource_type_id, resource_id=resource_id)


def static_entitlements(declared: DataFrame, resources: DataFrame) -> DataFrame:
    """R-07: each declaration (resource_type_id, slug, display_name) for every resource of its type."""
    rs = resources.select("sync_id", "resource_type_id", "resource_id")
    return rs.join(declared, "resource_type_id").withColumn("external_id", F.concat_ws(":", "resource_type_id", "resource_id", "slug"))


def list_grants(grants: DataFrame, *, resource_type_id: str = "", resource_id: str = "", entitlement_id: str = "", principal_type_id: str = "", principal_id: str = "", principal_types: Iterable[str] = ()) -> DataFrame:
    """R-08, R-09, R-10, R-11: the conjunction of whatever is given; expansions are a column of each grant."""
    df = where(grants, resource_type_id=resource_type_id, resource_id=resource_id, entitlement_id=entitlement_id)
    df = where(df, principal_resource_type_id=principal_type_id, principal_resource_id=principal_id)
    return where(df, principal_resource_type_id=tuple(principal_types))


def grants_for_entitlement_type(grants: DataFrame, resource_type_id: str = "") -> DataFrame:
    """R-12 by the type of the entitlement's resource; none is all."""
    return where(grants, resource_type_id=resource_type_id)


def grants_for_principal_type(grants: DataFrame, resource_type_id: str) -> DataFrame:
    """R-12 by the principal's type, which has to be given."""
    if not resource_type_id:
        raise ValueError("a principal's resource type has to be given")
    return where(grants, principal_resource_type_id=resource_type_id)


def grants_for_entitlements(grants: DataFrame, ids: list[str]) -> DataFrame:
    """R-13: grants of at most BATCH entitlements with the place of each in the request; order by (position, external_id)."""
    if len(ids) > BATCH:
        raise ValueError(f"at most {BATCH} entitlements at once")
    asked = grants.sparkSession.createDataFrame([(i, x) for i, x in enumerate(dict.fromkeys(ids))], "position int, entitlement_id string")
    return grants.join(F.broadcast(asked), "entitlement_id")


def principal_keys(grants: DataFrame, entitlement_id: str) -> DataFrame:
    """R-14."""
    return where(grants, entitlement_id=entitlement_id).select("principal_resource_type_id", "principal_resource_id").distinct()


def get(df: DataFrame, **key: str) -> DataFrame:
    """R-15: the row of a key, if there is one."""
    for column, value in key.items():
        df = df.where(F.col(column) == value)
    return df.limit(1)


def get_many(df: DataFrame, ids: DataFrame, on: str | list[str] = "external_id") -> DataFrame:
    """R-16: rows whose key is among ids."""
    return df.join(ids, on, "left_semi")


def stream(df: DataFrame, columns: list[str] | None = None):
    """R-17: rows one by one, a partition at a time."""
    return (df.select(*columns) if columns else df).toLocalIterator(prefetchPartitions=True)


def pending_expansion(grants: DataFrame) -> DataFrame:
    """R-20."""
    return grants.where(F.col("expansion").isNotNull() & F.col("needs_expansion"))


def page_size(asked: int) -> int:
    """R-130: 0 or too many is the largest page."""
    return PAGE if asked <= 0 or asked > PAGE else asked


def page(df: DataFrame, key: list[str], size: int = 0, after: tuple | None = None, inclusive: bool = False) -> DataFrame:
    """R-130, R-131: the next rows by key, and one more than asked for to tell whether there are others. Keyset paging: the
    predicate reaches the scan, and TakeOrdered keeps size + 1 rows of each task."""
    if after is not None:
        df = df.where(beyond(key, after, inclusive))
    return df.orderBy(*key).limit(page_size(size) + 1)


def beyond(key: list[str], after: tuple, inclusive: bool) -> Column:
    """key > after (or >=) in lexicographic order."""
    out, equal = F.lit(False), F.lit(True)
    for column, value in zip(key, after, strict=True):
        out = out | (equal & (F.col(column) > value))
        equal = equal & (F.col(column) == value)
    return out | equal if inclusive else out
