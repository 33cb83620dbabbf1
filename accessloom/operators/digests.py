"""Set digests of grants (R-110..R-115).

A grant's hash is 60 bits of the MD5 of its identity and its sources, so that any engine with MD5 can check it. A set's digest is
the exclusive or of its hashes with their count: order does not matter and partial digests combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, FULL, WIDEST = 60, 512, 16
IDENTITY = ("entitlement_id", "resource_type_id", "resource_id", "principal_resource_type_id", "principal_resource_id")


def hashed(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, BITS // 4), 16, 10).cast("long")


def escaped(c: Column) -> Column:
    """Parts end in NUL; a NUL within is escaped, so that no two lists of parts make one string."""
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\u0001"), F.lit("\u0001\u0001")), F.lit("\u0000"), F.lit("\u0001\u0002"))


def joined(*parts: Column) -> Column:
    return F.concat_ws("\u0000", *(escaped(p) for p in parts))


def with_hashes(grants: DataFrame) -> DataFrame:
    """R-110: content_hash and principal_hash; ids, times and directness are no part of the content."""
    sources = F.array_join(F.sort_array(F.coalesce(F.map_keys("sources"), F.array().cast("array<string>"))), "\u0000")
    content = F.concat_ws("\u0000", joined(*(F.col(c) for c in IDENTITY)), sources)
    return grants.withColumns({"content_hash": hashed(content), "principal_hash": hashed(joined(F.col("principal_resource_type_id"), F.col("principal_resource_id")))})


def digest() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.bit_xor("content_hash").alias("digest")]


def roots(grants: DataFrame) -> DataFrame:
    """R-111: of each entitlement."""
    return with_hashes(grants).groupBy("entitlement_id").agg(*digest())


def global_root(grants: DataFrame) -> DataFrame:
    return with_hashes(grants).agg(*digest())


def width(n: Column) -> Column:
    """R-112: the least w for which 2**w buckets of FULL rows hold n, WIDEST at most."""
    out = F.lit(WIDEST)
    for w in reversed(range(WIDEST)):
        out = F.when(n <= FULL << w, w).otherwise(out)
    return out


def bucket(principal_hash: Column, w: Column) -> Column:
    """The top w bits."""
    return F.call_function("shiftright", principal_hash, F.lit(BITS) - w)


def buckets(grants: DataFrame, widths: DataFrame | None = None) -> DataFrame:
    """R-112, R-114: count and digest of each bucket; widths (entitlement_id, width): of the counts, unless given."""
    rows = with_hashes(grants)
    if widths is None:
        widths = rows.groupBy("entitlement_id").agg(F.count(F.lit(1)).alias("n")).select("entitlement_id", width(F.col("n")).alias("width"))
    rows = rows.join(widths, "entitlement_id")
    return rows.groupBy("entitlement_id", "width", bucket(F.col("principal_hash"), F.col("width")).alias("bucket")).agg(*digest())


def node(nodes: DataFrame, entitlement_id: str, index: int | None = None) -> DataFrame:
    """R-114: an entitlement's buckets, or one of them; an index beyond its width is an error."""
    own = nodes.where(F.col("entitlement_id") == entitlement_id)
    if index is None:
        return own
    top = own.select("width").limit(1).collect()
    if index < 0 or (top and index >= 1 << top[0][0]):
        raise IndexError(f"no bucket {index}")
    return own.where(F.col("bucket") == index)


def dirty(old: DataFrame, new: DataFrame) -> DataFrame:
    """R-113: buckets of two sets of grants that differ. Both are cut at the narrower width of an entitlement; one that only one side
    has is dirty as a whole (bucket null)."""
    count = lambda df, n: df.groupBy("entitlement_id").agg(width(F.count(F.lit(1))).alias(n))
    both = count(old, "a").join(count(new, "b"), "entitlement_id", "full_outer")
    one = both.where("a is null or b is null").select("entitlement_id", F.lit(None).cast("long").alias("bucket"))
    shared = both.where("a is not null and b is not null").select("entitlement_id", F.least("a", "b").alias("width"))
    side = lambda df, n: buckets(df, shared).select("entitlement_id", "bucket", F.struct("n", "digest").alias(n))
    pairs = side(old, "x").join(side(new, "y"), ["entitlement_id", "bucket"], "full_outer")
    return pairs.where(~F.col("x").eqNullSafe(F.col("y"))).select("entitlement_id", "bucket").union(one)


def repaired(stored: DataFrame, grants: DataFrame, invalid: DataFrame) -> DataFrame:
    """R-115: stored roots with those of invalid (entitlement_id) partitions, and of partitions without one, computed anew."""
    known = stored.join(invalid, "entitlement_id", "left_anti")
    todo = grants.join(known.select("entitlement_id"), "entitlement_id", "left_anti")
    return known.unionByName(roots(todo).select(*stored.columns))
