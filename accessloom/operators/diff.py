"""Snapshot differences (R-59, R-90..R-92)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import dealt
from ..schemas import KEYS

#: Columns that say which run saw a row, and when: no part of what is compared.
OUTSIDE = ("sync_id", "discovered_at")


def comparable(column: Column, kind: T.DataType) -> Column:
    """Maps have no equality: their entries in order have."""
    return F.sort_array(F.map_entries(column)) if isinstance(kind, T.MapType) else column


def changes(old: DataFrame, new: DataFrame, table: str) -> DataFrame:
    """R-90: created, deleted and modified rows: the new row, or of deleted ones the old, and change. Each column goes through the
    join once a side, and those that are neither compared nor asked for do not."""
    key = KEYS[table]
    others = [c for c in new.columns if c not in key]
    compared = [f for f in old.schema if f.name not in (*OUTSIDE, *key)]
    side = lambda df, n: df.select(*key, *(F.col(c).alias(f"{n}_{c}") for c in df.columns if c not in key), F.lit(True).alias(n))
    both = dealt(side(old, "_old"), *key).join(side(new, "_new"), key, "full_outer")
    same = F.lit(True)
    for f in compared:
        same = same & comparable(F.col(f"_old_{f.name}"), f.dataType).eqNullSafe(comparable(F.col(f"_new_{f.name}"), f.dataType))
    change = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").when(~same, "modified")
    both = both.withColumn("change", change).where(F.col("change").isNotNull())
    row = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c) for c in others}
    return both.select(*(row.get(c, F.col(c)) for c in new.columns), "change")


def additive(base: DataFrame, applied: DataFrame, table: str, sync_id: str) -> DataFrame:
    """R-91: rows of applied whose key base lacks, under a new run (of type partial, its parent the base run)."""
    # An anti-join would go down into each branch of a union, and read the base once for each.
    known = base.select(*KEYS[table], F.lit(True).alias("_known"))
    fresh = dealt(applied, *KEYS[table]).join(known, KEYS[table], "left").where(F.col("_known").isNull())
    return fresh.withColumn("sync_id", F.lit(sync_id)).select(*applied.columns)


def upserts(old: DataFrame, new: DataFrame, table: str) -> DataFrame:
    """R-92: new rows, and rows whose content or expansion differs."""
    return changes(old, new, table).where("change <> 'deleted'").drop("change")


def deletions(old: DataFrame, new: DataFrame, table: str) -> DataFrame:
    """R-92: old rows whose key the new snapshot lacks."""
    return old.join(new.select(*KEYS[table]), KEYS[table], "left_anti")


def linked_runs(old_run: DataFrame, upsert_id: str, deletion_id: str) -> DataFrame:
    """R-92: the runs of both halves of a difference, linked to one another; the old run has to support differences."""
    made = lambda sync_id, kind, other: old_run.where("supports_diff").select(F.lit(sync_id).alias("sync_id"), F.lit(kind).alias("sync_type"), F.col("sync_id").alias("parent_sync_id"), F.lit(other).alias("linked_sync_id"), "started_at", "ended_at")
    return made(upsert_id, "partial_upserts", deletion_id).union(made(deletion_id, "partial_deletions", upsert_id))


def applied(base: DataFrame, gone: DataFrame, ups: DataFrame, table: str) -> DataFrame:
    """base after a difference."""
    key = KEYS[table]
    return base.join(gone.select(*key).union(ups.select(*key)), key, "left_anti").select(*base.columns).unionByName(ups.select(*base.columns))
