"""Near-duplicates by SimHash with Golay-code fuzzy hashing.

A fingerprint of 64 bits falls into segments of 23, 23 and 18 bits. The binary Golay code of length 23 corrects three
errors and is perfect, so every 23-bit word decodes to one codeword; a segment gets as keys the codewords of all words
within one bit of it (six at most), and two segments that differ in one bit or two share a key. Three differing bits over three
segments leave either one segment equal and another with one error at most (key: the equal segment and a codeword of the
other), or one error in each (key: codewords of the first two and the half of the third that has no error). Rows that
meet in a key are verified; only links that are needed to connect a key's rows are passed on, never all its pairs.

Contract: A-Z are lower-cased, words lie between \\t \\n \\v \\f \\r and blanks. A null text counts as empty, its fingerprint
is zero and linked like any other. Every row gives a row; a null doc_id is never a smallest id, and a component of
null ids alone has a null component_id. Rows that repeat an id count as one document. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, over
from .components import components

SEED = 42
#: Differing bits up to which fingerprints link. The keys below are made for this number.
REACH = 3
#: Rows of a key that are compared in one piece; more are dealt out as pairs of such blocks.
BLOCK = 4096
#: Up to so many rows, a key's rows are compared pair by pair.
FEW = 12
#: Bits of hashes that are counted at once.
CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a text's three-word shingles, as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < 3:
        return xxh64_intdigest(b" ".join(words), SEED)
    hashes = np.fromiter((xxh64_intdigest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])), "<u8", len(words) - 2)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_rows(batches):
    for batch in batches:
        prints = np.fromiter(map(fingerprint, batch.column(1).cast(pa.binary()).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])


# The binary Golay code: generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR, _LENGTH, _CHECKS = 0xC75, 23, 11


def _remainder(word: int) -> int:
    for bit in range(_LENGTH - 1, _CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - _CHECKS)
    return word


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 23 single bits, and by remainder the word of three bits at most that leaves it."""
    single = np.array([_remainder(1 << i) for i in range(_LENGTH)], np.int64)
    errors = np.zeros(1 << _CHECKS, np.int64)
    for i in range(_LENGTH):
        errors[single[i]] = 1 << i
        for j in range(i):
            errors[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return single, errors


def decode(words: np.ndarray, tables) -> np.ndarray:
    """The index (its 12 upper bits) of the codeword nearest to each word."""
    single, errors = tables
    syndrome = np.zeros_like(words)
    for i in range(_LENGTH):
        syndrome ^= np.where(words >> i & 1, single[i], 0)
    return (words ^ errors[syndrome]) >> _CHECKS


def near_keys(words: np.ndarray, bits: int, tables) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the indices of the codewords of the words within one bit of it: a column for each flip, and whether
    it is the first of its value in its row."""
    flips = np.array([0, *(1 << i for i in range(bits))], np.int64)
    keys = np.sort(decode((words[:, None] ^ flips[None, :]).ravel(), tables).reshape(len(words), -1), axis=1)
    first = np.ones(keys.shape, bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys, first


def keys_of(prints: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints, and the place of the fingerprint of each."""
    mask = np.uint64((1 << 23) - 1)
    parts = [(prints & mask).astype(np.int64), (prints >> np.uint64(23) & mask).astype(np.int64), (prints >> np.uint64(46)).astype(np.int64)]
    near = [near_keys(part, bits, tables) for part, bits in zip(parts, (23, 23, 18), strict=True)]
    out, at = [], []
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))):
        keys, first = near[j]
        row, col = np.nonzero(first)
        out.append(tag << 40 | parts[i][row] << 12 | keys[row, col])
        at.append(row)
    (a, a_first), (b, b_first) = near[:2]
    width = int(a_first.sum(axis=1).max(initial=1))
    order = np.argsort(~a_first, axis=1, kind="stable")[:, :width]
    for col in range(width):  # the k-th codeword of the first segment with all of the second
        pick = np.take_along_axis(a, order[:, col : col + 1], 1)[:, 0]
        has = np.take_along_axis(a_first, order[:, col : col + 1], 1)[:, 0]
        row, other = np.nonzero(b_first & has[:, None])
        both = pick[row] << 21 | b[row, other] << 9
        out += [6 << 40 | both | parts[2][row] & 511, 7 << 40 | both | parts[2][row] >> 9]
        at += [row, row]
    return np.concatenate(out), np.concatenate(at)


def key_rows(batches):
    tables = golay_tables()
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            prints = batch.column(0).slice(start, 2000).to_numpy().view(np.uint64)
            keys, at = keys_of(prints, tables)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[at].view(np.int64))], names=["key", "print"])


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links among all the fingerprints connect: fewer than there are fingerprints."""
    rest = np.unique(prints)
    us, vs = [], []
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            near = np.bitwise_count(rest ^ x) <= REACH
            if near.any():
                found, rest = rest[near], rest[~near]
                us.append(np.full(len(found), x, np.uint64))
                vs.append(found)
                stack.extend(found)
    none = np.empty(0, np.uint64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


LINKS = "u long, v long, key long, block int"


def linked(block: int | None):
    """Links among rows of equal keys, in rows sorted by key. With a block, the rows of keys that have as many are given
    back under their key, numbered by block (u: the fingerprint)."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64()), ("block", pa.int32())])

    def links(us, vs):
        us, vs = np.minimum(us, vs), np.maximum(us, vs)
        pairs = np.unique(np.stack([us, vs], axis=1), axis=0) if len(us) else np.empty((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0]).view(np.int64)), pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64)), pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.int32())], schema=schema)

    def put_back(key, prints, number):
        n = len(prints)
        return pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.nulls(n, pa.int64()), pa.array(np.full(n, key)), pa.array(np.full(n, number, np.int32))], schema=schema)

    def compare(keys, prints):
        bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
        sizes = np.diff(bounds)
        us, vs = [], []
        for k in np.flatnonzero(sizes > FEW):
            u, v = forest(prints[bounds[k] : bounds[k + 1]])
            us.append(u)
            vs.append(v)
        few = np.repeat(sizes <= FEW, sizes)
        keys, prints = keys[few], prints[few]
        for step in range(1, FEW):
            same = keys[step:] == keys[:-step]
            if not same.any():
                break
            x, y = prints[step:][same], prints[:-step][same]
            near = (np.bitwise_count(x ^ y) <= REACH) & (x != y)
            us.append(x[near])
            vs.append(y[near])
        return links(np.concatenate(us), np.concatenate(vs)) if us else None

    def run(batches):
        keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)
        hot, number = None, 0
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy().view(np.uint64)])
            if hot is not None:  # the rest of a key that has been put back so far
                n = int(np.searchsorted(keys, hot, "right"))
                if n < len(keys):
                    if n:
                        yield put_back(hot, prints[:n], number)
                    keys, prints, hot, number = keys[n:], prints[n:], None, 0
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if last and (out := compare(keys[:last], prints[:last])) is not None:
                yield out
            keys, prints = keys[last:], prints[last:]
            while block and len(keys) >= block:
                hot = int(keys[0])
                yield put_back(hot, prints[:block], number)
                keys, prints, number = keys[block:], prints[block:], number + 1
        if hot is not None:
            if len(keys):
                yield put_back(hot, prints, number)
        elif len(keys) and (out := compare(keys, prints)) is not None:
            yield out

    return run


def links_of(prints: DataFrame) -> DataFrame:
    """u, v: links that connect all fingerprints (column print, distinct) of REACH differing bits or fewer."""
    rows = over(prints.select("print"), key_rows, "key long, print long").repartition("key").sortWithinPartitions("key")
    found = cut(over(rows, linked(BLOCK), LINKS))
    hot = found.where("key is not null")
    blocks = hot.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block"))))
    pairs = hot.join(blocks, "key").select("key", "block", F.col("u").alias("print"), other.alias("other"))
    pairs = pairs.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("pair"), "print").repartition("pair").sortWithinPartitions("pair")
    return found.where("key is null").select("u", "v").union(over(pairs, linked(None), LINKS).select("u", "v"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id that links lead to)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = cut(over(rows, fingerprint_rows, "doc_id long, print long"))
    nodes = cut(prints.groupBy("print").agg(F.min("doc_id").alias("first")))
    roots = components(links_of(nodes)).toDF("print", "root")
    members = roots.join(nodes, "print")
    least = members.groupBy("root").agg(F.min("first").alias("least"))
    placed = nodes.join(roots.join(least, "root").select("print", "least"), "print", "left").select("print", F.coalesce("least", "first").alias("component_id"))
    return prints.join(placed, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def likely_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes (node, print) whose fingerprints are equal or link: of equal ones each with the least node."""
    least = cut(nodes.groupBy("print").agg(F.min("node").alias("least")))
    equal = nodes.join(least, "print").where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    links = cut(links_of(least.select("print"))).toDF("a", "b")
    near = links.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b")
    return equal.union(near.select(F.least("x", "y"), F.greatest("x", "y")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 4/5 or
    more. Pairs whose SimHash fingerprints (of those sets) link by Golay keys are verified on the texts; what three bits do not
    reach, most links of that similarity, near_copies completes exactly.

    The row that stays has the component's smallest doc_id (null is the last), then the smallest hash of text. Rows are told apart by
    themselves, so rows that repeat an id or have none are judged like others. A text of fewer words is one shingle; null counts as
    empty, and empty texts are copies of each other. All columns are kept, whatever their names.
    """
    from .near_copies import near_components, set_rows

    at = free_name("row_at", docs.columns)
    rows = cut(docs.withColumn(at, F.monotonically_increasing_id()))
    texts = rows.select(F.col(at).alias("at"), F.col("text").cast("string").alias("text"))
    sets = cut(over(texts, set_rows, "at long, node long, n int, bits binary, print long"))
    ids = rows.select(F.col(at).alias("at"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "at")
    nodes = cut(sets.join(ids, "at").groupBy("node").agg(F.min(rank).alias("first"), F.first("bits").alias("bits"), F.first("print").alias("print")))
    roots = near_components(nodes.select("node", F.col("first.at").alias("at"), "bits"), texts, likely_pairs(nodes.select("node", "print")))
    kept = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    return rows.join(kept.select(F.col("first.at").alias(at)), at, "left_semi").select(*(rows[f"`{c}`"] for c in docs.columns))
