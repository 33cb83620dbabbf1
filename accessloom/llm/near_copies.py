"""Links between near copies that SimHash fingerprints do not show, found exactly.

A text is the set of hashes of its runs of WORDS words. Two sets of similarity 4/5 or more share an element among the first
n - ceil(4n/5) + 1 of each under any common order (prefix filter); the order puts the shingles that most texts have there last,
counted over all texts (the list of LAST affects speed alone). Rows that meet in such an element are candidates, as far as sizes,
places and parity bitmaps (which bound the sets' difference from below) allow a similarity of 4/5. First a tree over each
element's candidates is verified on the texts, together with the pairs of near fingerprints; then all candidates that are not
connected yet. So only pairs that could still join two components are ever compared.

Two rows that meet in an element have mostly met in an earlier one. A row carries the BEFORE shared elements that precede it in
its text; rows that have one of them in common are passed over, as they are candidates there too (earlier places allow no less).
The last candidates are found by longer bitmaps, of those texts alone that are a candidate of any other.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, over
from .components import components
from .hashing import blocks, gram_hashes, lowered, span_hashes, text_bytes, word_spans

WORDS = 5
#: Texts whose first shingles hold one that is put last, and how many shingles are put last at most.
FREQUENT, LAST = 16, 200_000
BITS = 512
#: Bits of the last candidates' bitmaps: so many that few pairs pass them that are not near copies.
WIDE = 4096
#: Shared elements before its own that a row carries; a pair that has none of them in common is made again.
BEFORE = 4
#: Rows of a key of which each looks for another that allows a similarity of 4/5; of more rows by sizes alone.
FEW = 16
#: Sets that a task remembers to have given.
SEEN = 1_000_000


def shingle_sets(column: pa.Array):
    """The set of each text, as a sorted array."""
    data, offsets = text_bytes(column)
    for at, to in blocks(offsets):
        low, high = int(offsets[at]), int(offsets[to])
        part = lowered(data[low:high])
        starts, ends, bounds = word_spans(part, offsets[at : to + 1] - low)
        words = span_hashes(part, starts, ends) if len(starts) else np.empty(0, np.uint64)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield np.unique(gram_hashes(words[a:b], min(WORDS, int(b - a)))) if b > a else np.empty(0, np.uint64)


def parity(found: np.ndarray, bits: int = BITS) -> bytes:
    """For each of that many classes of shingles, whether the set has an odd number of them."""
    return np.packbits(np.bincount((found >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1 > 0).tobytes()


def fingerprint(found: np.ndarray) -> np.uint64:
    """The SimHash of a set: bits that over half its elements have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 16):
        part = found[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0]


def set_rows(batches):
    """Of each text: at, the hash of its set (node), its size, parity bitmap and fingerprint."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        sets = list(shingle_sets(batch.column(1)))
        nodes = np.fromiter((xxh64_intdigest(x.tobytes()) for x in sets), np.uint64, len(sets))
        prints = np.fromiter(map(fingerprint, sets), np.uint64, len(sets))
        columns = [batch.column(0), pa.array(nodes.view(np.int64)), pa.array([len(x) for x in sets], pa.int32()), pa.array(map(parity, sets), pa.binary()), pa.array(prints.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "node", "n", "bits", "print"])


def wide_rows(batches):
    """Of each text (node, text): its node and its long parity bitmap."""
    for batch in batches:
        bits = [parity(x, WIDE) for x in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["node", "bits"])


def prefix_rows(last: np.ndarray):
    """The elements of each text's prefix, with its node and the place of each in the order. Of equal sets a task gives one."""

    def run(batches):
        from xxhash import xxh64_intdigest

        seen: set[int] = set()
        for batch in batches:
            keys, sizes, counts, nodes = [], [], [], []
            for found in shingle_sets(batch.column(0)):
                node = xxh64_intdigest(found.tobytes())
                if node in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(node)
                n = len(found)
                if len(last) and n:
                    found = found[np.argsort(last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found, kind="stable")]
                keys.append(found[: n - -(-4 * n // 5) + 1] if n else found)
                sizes.append(n)
                counts.append(len(keys[-1]))
                nodes.append(node)
            if keys:
                places = np.concatenate([np.arange(c, dtype=np.int32) for c in counts])
                own = np.repeat(np.array(nodes, np.uint64).view(np.int64), counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(own), pa.array(np.repeat(np.array(sizes, np.int32), counts)), pa.array(places)], names=["key", "node", "n", "place"])

    return run


def may_be(n, m, i, j):
    """Whether sets of n and m elements whose first common one is at place i and j can have a similarity of 4/5."""
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * np.minimum(n - i, m - j) >= 4 * (n + m))


def grouped(batches):
    """The rows of whole keys, of a table sorted by key, n and node; equal rows once."""
    for part in whole_keys(batches):
        key, node = part.column(0).to_numpy(), part.column(1).to_numpy()
        again = np.concatenate([[False], (key[1:] == key[:-1]) & (node[1:] == node[:-1])])
        yield part.filter(pa.array(~again)) if again.any() else part


def whole_keys(batches):
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rest = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        keys = rest.column(0).to_numpy()
        to = int(np.searchsorted(keys, keys[-1]))
        if to:
            yield rest.slice(0, to)
            rest = rest.slice(to)
    if rest is not None:
        yield rest


def bounds_of(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))


def meeting(batches):
    """The rows that may be near copies of another of their key (of large keys by sizes alone), in rows sorted by key, n and node."""
    for part in grouped(batches):
        key, n, place = part.column(0).to_numpy(), part.column(2).to_numpy().astype(np.int64), part.column(3).to_numpy().astype(np.int64)
        sizes = np.diff(bounds_of(key))
        few = np.repeat(sizes <= FEW, sizes)
        met = np.zeros(len(key), bool)
        for step in range(1, min(FEW, int(sizes.max(initial=0)))):
            x = np.flatnonzero((key[step:] == key[:-step]) & (5 * n[:-step] >= 4 * n[step:]) & (few[step:] | (step == 1)))
            y = x + step
            x, y = (z[~few[x] | may_be(n[x], n[y], place[x], place[y])] for z in (x, y))
            met[x] = met[y] = True
        yield part.filter(pa.array(met))


def candidates(tree: bool):
    """Pairs (u, v) of the rows of a key (key, node, n, place, root, bits, and the elements before; sorted by key) that have
    different roots and may be near copies: all of them, or only a tree of each connected group of them. Rows with a common
    element before are left to it."""

    def run(batches):
        for part in grouped(batches):
            key, node, n, place, root = (part.column(i).to_numpy() for i in range(5))
            n = n.astype(np.int64)
            before = [part.column(i).to_numpy() for i in range(6, part.num_columns)]
            bits = np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint64).reshape(len(key), -1)

            def new(x, y):
                """The rows of y that the row x has not met before."""
                for a in before:
                    for b in before:
                        y = y[a[y] != b[x]]
                return y

            def near(x, y):
                """The rows of y that may be near copies of the row x."""
                y = y[(root[y] != root[x]) & may_be(n[y], n[x], place[y], place[x])]
                if not tree:
                    y = new(x, y)
                return y[9 * np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64) <= n[y] + n[x]]

            us, vs = [], []
            bounds = bounds_of(key)
            for a, b in zip(bounds[:-1], bounds[1:]):
                rest = np.arange(a, b)
                if tree:
                    while len(rest):
                        stack, rest = [rest[0]], rest[1:]
                        while stack and len(rest):
                            x = stack.pop()
                            y = near(x, rest)
                            stack.extend(y)
                            rest = rest[~np.isin(rest, y, assume_unique=True)]
                            y = new(x, y)
                            us.append(np.full(len(y), node[x]))
                            vs.append(node[y])
                    continue
                roots, of, counts = np.unique(root[a:b], return_inverse=True, return_counts=True)
                if len(roots) > 1:  # all but the rows of the most frequent root, each with the rows that are not of its own
                    for x in a + np.flatnonzero(of != counts.argmax()):
                        y = near(x, rest)
                        us.append(np.full(len(y), node[x]))
                        vs.append(node[y])
            u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in (us, vs))
            pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["u", "v"])

    return run


def similar(batches):
    for batch in batches:
        good = []
        for a, b in zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3))):
            good.append(9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b)))
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


#: Only the texts that pairs name are shuffled: Spark's Bloom filters over join keys, of bounded size, at any size of the tables.
FILTERS = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
}


@contextmanager
def filters(spark: SparkSession):
    before = {k: spark.conf.get(k) for k in FILTERS}
    for k, v in FILTERS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def verified(pairs: DataFrame, texts: DataFrame, places: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are similar; places: node, at of one of its texts; texts: at, text."""
    placed = cut(pairs.join(places.toDF("u", "x"), "u").join(places.toDF("v", "y"), "v").select("u", "v", "x", "y"))
    with filters(pairs.sparkSession):
        both = placed.where("u < v").join(texts.toDF("x", "a"), "x").join(texts.toDF("y", "b"), "y").select("u", "v", "a", "b")
        return cut(over(both, similar, "u long, v long"))


def wide_bits(nodes: DataFrame, texts: DataFrame, places: DataFrame) -> DataFrame:
    """node, bits: the long parity bitmaps of the nodes (node); at is never negative (Spark filters by sides that have a condition)."""
    placed = cut(nodes.join(places, "node").select("at", "node"))
    with filters(nodes.sparkSession):
        return cut(over(placed.where("at >= 0").join(texts, "at").select("node", "text"), wide_rows, "node long, bits binary"))


def frequent(texts: DataFrame) -> np.ndarray:
    """The shingles, sorted, that stand in most texts' prefixes before any are put last."""
    counts = over(texts.select("text"), prefix_rows(np.empty(0, np.uint64)), PREFIXES).groupBy("key").count().where(f"count >= {FREQUENT}")
    most = counts.orderBy(F.desc("count"), "key").limit(LAST).select("key").toPandas()
    return np.sort(most["key"].to_numpy(np.int64).view(np.uint64))


PREFIXES = "key long, node long, n int, place int"


def meetings(texts: DataFrame) -> DataFrame:
    """The rows of prefixes that meet in a key, with the BEFORE keys that precede each in its text (where there is none, its node)."""
    prefixes = over(texts.select("text"), prefix_rows(frequent(texts)), PREFIXES).repartition("key").sortWithinPartitions("key", "n", "node")
    order = Window.partitionBy("node").orderBy("place")
    before = [F.coalesce(F.lag("key", i).over(order), "node").alias(f"before{i}") for i in range(1, BEFORE + 1)]
    return over(prefixes, meeting, PREFIXES).select("*", *before)


def pairs(met: DataFrame, nodes: DataFrame, tree: bool) -> DataFrame:
    """Pairs (u, v) of nodes (node, root, bits) that meet; see candidates."""
    before = [c for c in met.columns if c.startswith("before")]
    rows = met.join(nodes, "node").select("key", "node", "n", "place", "root", "bits", *before)
    return over(rows.repartition("key").sortWithinPartitions("key", "n", "node"), candidates(tree), "u long, v long")


def near_components(nodes: DataFrame, texts: DataFrame, likely: DataFrame) -> DataFrame:
    """node, root of the nodes that are linked; nodes: node, at, bits, each node once; texts: at, text; likely: pairs (u, v)."""
    places = nodes.select("node", "at")
    met = cut(meetings(texts))
    alone = nodes.select("node", F.col("node").alias("root"), "bits")
    tried = cut(likely.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).union(pairs(met, alone, True)).distinct())
    roots = components(verified(tried, texts, places))
    root_of = cut(places.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    able = tried.select("u").union(tried.select("v")).distinct().toDF("node")  # a node that may be linked to any is in a tree
    held = root_of.join(wide_bits(able, texts, places), "node").select("node", "root", "bits")
    rest = cut(pairs(met, held, False).distinct().join(tried, ["u", "v"], "left_anti"))
    if rest.isEmpty():
        return roots
    joined = verified(rest, texts, places).join(root_of.toDF("u", "x"), "u").join(root_of.toDF("v", "y"), "v").select(F.col("x").alias("u"), F.col("y").alias("v"))
    tops = components(joined).toDF("root", "top")
    return root_of.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
