"""Merging snapshots by newest observation (R-22..R-24, R-93..R-97, R-100..R-102)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import KEYS


def merge_pair(base: DataFrame, over: DataFrame, table: str) -> DataFrame:
    """R-93: over's row wins where base has none or an older one; equal times keep base's."""
    key = KEYS[table]
    side = lambda df, n: df.select(*key, F.struct(*base.columns).alias(n))
    both = side(base, "b").join(side(over, "o"), key, "full_outer")
    wins = F.col("b").isNull() | (F.col("o.discovered_at") > F.col("b.discovered_at"))
    return both.select(F.when(wins & F.col("o").isNotNull(), F.col("o")).otherwise(F.col("b")).alias("row")).select("row.*")


def recency(rank: str = "rank") -> Column:
    """Order of rows of a key: a null time is older than any (R-96), then the source's rank decides."""
    return F.struct(F.col("discovered_at").isNotNull(), "discovered_at", rank)


def merge_many(sources: list[DataFrame], table: str, tie: str = "newer") -> DataFrame:
    """R-94, R-95: of each key the newest row; of equal times that of the newer (later) source, or of the older (tie='older', as
    R-96's fold). One combined aggregate: the winner is chosen before rows are shuffled."""
    sign = 1 if tie == "newer" else -1
    ranked = [df.withColumn("rank", F.lit(sign * i)) for i, df in enumerate(sources)]
    every = reduce(DataFrame.unionByName, ranked)
    best = every.groupBy(*KEYS[table]).agg(F.max_by(F.struct(*sources[0].columns), recency()).alias("row"))
    return best.select("row.*")


def fold(base: DataFrame, incoming: DataFrame, table: str) -> DataFrame:
    """R-96: strictly newer rows replace; a null incoming time is never newer, a null existing one always loses to a known."""
    return merge_many([base, incoming], table, "older")


def strategy(base_bytes: int, partial_bytes: int, wasted_bytes: int, share: float = 0.10, waste: float = 0.15) -> str:
    """R-97: append to the base's files while the parts and the waste are small, else rewrite them."""
    return "fold" if base_bytes and partial_bytes <= share * base_bytes and wasted_bytes <= waste * base_bytes else "rebuild"


def upsert(existing: DataFrame, rows: DataFrame, table: str, preserve_expansion: bool = False) -> DataFrame:
    """R-22, R-23: rows replace those of their key; the last of a batch that repeats a key wins (column `ordinal`, if it has one). With
    preserve_expansion a known grant keeps its rule and whether it is pending."""
    key = KEYS[table]
    if "ordinal" in rows.columns:
        rows = rows.groupBy(*key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != "ordinal")), "ordinal").alias("r")).select("r.*")
    if preserve_expansion and table == "grants":
        known = existing.select(*key, F.struct("expansion", "needs_expansion").alias("known"))
        rows = rows.join(known, key, "left").withColumns({c: F.when(F.col("known").isNotNull(), F.col(f"known.{c}")).otherwise(F.col(c)) for c in ("expansion", "needs_expansion")}).select(*existing.columns)
    return existing.join(rows.select(*key), key, "left_anti").unionByName(rows.select(*existing.columns))


def without(existing: DataFrame, keys: DataFrame, table: str) -> DataFrame:
    """R-24."""
    return existing.join(keys.select(*KEYS[table]), KEYS[table], "left_anti")
