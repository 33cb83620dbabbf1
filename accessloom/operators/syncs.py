"""Sync runs: finding, resolving, retaining (R-18, R-19, R-64, R-98, R-99, R-133, R-134)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DIFFS = ("partial_upserts", "partial_deletions")
PARTS = ("partial", "resources_only")


def newest(sync_runs: DataFrame, sync_type: str = "") -> DataFrame:
    """R-18: finished runs (of a type) with their rank, 1 for the latest by (ended_at, sync_id)."""
    done = sync_runs.where(F.col("ended_at").isNotNull())
    done = done.where(F.col("sync_type") == sync_type) if sync_type else done
    return done.withColumn("rank", F.row_number().over(W.partitionBy("sync_type").orderBy(F.desc("ended_at"), F.desc("sync_id"))))


def latest_and_previous(sync_runs: DataFrame, sync_type: str = "full") -> DataFrame:
    return newest(sync_runs, sync_type).where("rank <= 2")


def finished_sync(sync_runs: DataFrame, sync_type: str = "", offset: int = 0) -> str | None:
    """The id of the offset-th latest finished run of a type, or of all."""
    done = sync_runs.where(F.col("ended_at").isNotNull())
    done = done.where(F.col("sync_type") == sync_type) if sync_type else done
    rows = done.orderBy(F.desc("ended_at"), F.desc("sync_id")).offset(offset).limit(1).select("sync_id").collect()
    return rows[0][0] if rows else None


def resolve(sync_runs: DataFrame, asked: str = "", current: str = "", view: str = "") -> str | None:
    """R-19: what a request names, else the open run, else the viewed one, else the latest finished full run."""
    return asked or current or view or finished_sync(sync_runs, "full") or finished_sync(sync_runs)


def run_for_stats(sync_runs: DataFrame, sync_id: str = "", sync_type: str = "") -> str:
    """R-64: no id is the latest finished run; one of another type, or none at all, is an error."""
    if not sync_id:
        found = finished_sync(sync_runs, sync_type)
        if found is None:
            raise LookupError("no finished sync run")
        return found
    rows = sync_runs.where(F.col("sync_id") == sync_id).select("sync_type").collect()
    if not rows:
        raise LookupError(f"no sync run {sync_id}")
    if sync_type and rows[0][0] != sync_type:
        raise ValueError(f"sync run {sync_id} is of type {rows[0][0]}, not {sync_type}")
    return sync_id


def union_type(a: Column, b: Column) -> Column:
    """R-98: full, else resources_only, else partial."""
    either = lambda kind: (a == kind) | (b == kind)
    return F.when(either("full"), "full").when(either("resources_only"), "resources_only").otherwise("partial")


def merged_run(sync_runs: DataFrame, new_id: str) -> DataFrame:
    """R-98 over any number of runs: the run that their merge makes."""
    rank = F.max(F.when(F.col("sync_type") == "full", 3).when(F.col("sync_type") == "resources_only", 2).otherwise(1))
    kind = F.element_at(F.array(F.lit("partial"), F.lit("resources_only"), F.lit("full")), rank)
    return sync_runs.agg(F.lit(new_id).alias("sync_id"), kind.alias("sync_type"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"))


def compactable(sync_runs: DataFrame) -> DataFrame:
    """R-99: the latest finished run that is no diff."""
    kinds = ("full", *PARTS)
    return sync_runs.where(F.col("ended_at").isNotNull() & F.col("sync_type").isin(*kinds)).orderBy(F.desc("ended_at"), F.desc("sync_id")).limit(1)


def deletable(sync_runs: DataFrame, current: str = "", keep: int = 2) -> DataFrame:
    """R-133: ids of the runs that retention drops, by sync_id order.

    Of finished full runs (or of unknown type) the last `keep` stay, one fewer if a run is open; partial runs that ended before
    the earliest kept full run began go with the overflow; of more than two diff runs only the last and its partner stay.
    """
    limit = max(0, keep - bool(current)) if keep > 0 else 0
    done = sync_runs.where(F.col("ended_at").isNotNull() & (F.col("sync_id") != current))
    kind = F.when(F.col("sync_type").isin(*PARTS), "part").when(F.col("sync_type").isin(*DIFFS), "diff").otherwise("full")
    own = W.partitionBy("kind")
    done = done.withColumn("kind", kind).withColumns({"place": F.row_number().over(own.orderBy("sync_id")), "n": F.count(F.lit(1)).over(own)})
    cut = F.col("n") - limit
    full = done.where("kind = 'full'")
    old_full = full.where((F.col("n") > limit) & (F.col("place") <= cut)).select("sync_id")
    # The first that stays; with a run open, the last that goes (the open one takes a place).
    edge = full.where((F.col("n") > limit) & (F.col("place") == cut + (0 if current else 1))).select(F.col("started_at").alias("edge"))
    old_part = done.where("kind = 'part'").join(F.broadcast(edge), F.col("ended_at") < F.col("edge")).select("sync_id")
    diff = done.where("kind = 'diff' and n > 2")
    last = diff.where("place = n").select(F.col("sync_id").alias("last"), F.col("linked_sync_id").alias("linked"))
    old_diff = diff.join(F.broadcast(last), (F.col("sync_id") == F.col("last")) | (F.col("sync_id") == F.col("linked")), "left_anti").select("sync_id")
    return old_full.union(old_part).union(old_diff)


def resumable(sync_runs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """R-134: the latest unfinished run that began within the window."""
    fresh = F.col("started_at") > now - F.make_dt_interval(F.lit(days))
    return sync_runs.where(F.col("ended_at").isNull() & fresh).orderBy(F.desc("started_at"), F.desc("sync_id")).limit(1)


def parent_first(sync_runs: DataFrame, depth: int = 64) -> DataFrame:
    """R-132: runs with their place: a parent before its children, else by id. Runs are few: the rounds stop at the deepest chain.
    Chains of more than depth parents, and runs that are their own ancestors, are an error."""
    known = sync_runs.select(F.col("sync_id").alias("known"))
    rows = sync_runs.join(known, F.col("parent_sync_id") == F.col("known"), "left")
    level = rows.where("known is null").select("sync_id", F.lit(0).alias("level"))
    out, n = level, 0
    while not level.isEmpty() and n < depth:
        n += 1
        level = rows.join(level.select(F.col("sync_id").alias("known")), "known").select("sync_id", F.lit(n).alias("level"))
        out = out.union(level)
    left = sync_runs.join(out.select("sync_id"), "sync_id", "left_anti").select("sync_id").orderBy("sync_id").limit(3).collect()
    if left:
        raise ValueError(f"runs with more than {depth} ancestors, or their own ancestors: {', '.join(r.sync_id for r in left)}")
    return out
