"""The event feed folded into present grants (R-160..R-163), and keyed state (R-167)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["entitlement_id", "principal_resource_type_id", "principal_resource_id"]


def changes(events: DataFrame) -> DataFrame:
    """Grants and revocations, each event once (feeds deliver at least once)."""
    return events.where(F.col("event_type").isin("create_grant", "create_revoke")).dropDuplicates(["feed_id", "event_id"])


def order() -> Column:
    return F.struct("occurred_at", "event_id")


def state(events: DataFrame) -> DataFrame:
    """R-161 over a finished feed: the last change of each entitlement and principal, by time and event id."""
    last = changes(events).groupBy(*KEY).agg(F.max_by(F.struct("event_type", "occurred_at", "event_id"), order()).alias("last"))
    return last.select(*KEY, (F.col("last.event_type") == "create_grant").alias("granted"), F.col("last.occurred_at").alias("occurred_at"), F.col("last.event_id").alias("event_id"))


def merged(present: DataFrame, batch: DataFrame) -> DataFrame:
    """The state after a batch: late or repeated events change nothing that a later one has set."""
    every = present.unionByName(state(batch))
    last = every.groupBy(*KEY).agg(F.max_by(F.struct("granted", "occurred_at", "event_id"), order()).alias("last"))
    return last.select(*KEY, "last.*")


def fold_into(path: str):
    """R-163: a foreachBatch that keeps the state in versions of a table: a batch that comes again writes its version again, from the one
    before it."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        empty = state(batch.limit(0))
        before = spark.read.schema(empty.schema).parquet(f"{path}/version={number - 1}") if number else empty
        merged(before, batch).write.mode("overwrite").parquet(f"{path}/version={number}")

    return apply


def run(events: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts the fold of a streaming feed; events come in any order and more than once."""
    return events.writeStream.foreachBatch(fold_into(path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def session_put(present: DataFrame, rows: DataFrame) -> DataFrame:
    """R-167: keys set anew; a null value removes its key."""
    key = ["sync_id", "key"]
    return present.join(rows.select(*key), key, "left_anti").unionByName(rows.where(F.col("value").isNotNull()))


def session_get(present: DataFrame, sync_id: str, prefix: str = "", keys: list[str] | None = None) -> DataFrame:
    """R-167: a run's values, by prefix or by keys."""
    df = present.where(F.col("sync_id") == sync_id)
    df = df.where(F.col("key").startswith(prefix)) if prefix else df
    return df.where(F.col("key").isin(keys)) if keys is not None else df
