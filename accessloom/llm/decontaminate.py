"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and each run of other characters than letters and digits becomes one blank. An item of n characters
may differ by RATE * n edits; cut into one piece more than that, it leaves a piece untouched wherever it occurs. All pieces
are sought at once (Aho-Corasick), and around each hit the item's least edit distance to any stretch of the text is found by
Myers' bit-parallel method, all of the item in one integer.

Documents are not shuffled. The benchmark is sent to the workers by broadcast, PASS_BYTES of it at most; a larger one is worked
through in passes, and what a pass has found is written before the next. Within a pass a worker holds the automaton of one block of
MAX_ITEMS items at a time, and goes through the blocks with CHUNK characters of text after another.

Contract: null or empty texts match nothing, nor do items without letters or digits. An item too short for any edit matches whole
words only. Rows that repeat a doc_id or an item_id
are all matched; equal results are one row. An item or document without id keeps its null. Empty tables give no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, over

#: Edits allowed for each character of an item, and the least length of a piece (short items get fewer edits).
RATE, LEAST_PIECE = 0.06, 12
#: Items of one block: their pieces and automaton stay under some 200 MB in each worker.
MAX_ITEMS = 20_000
#: Bytes of benchmark text that are broadcast at once, and characters of documents that are held while blocks change.
PASS_BYTES, CHUNK = 64 << 20, 16 << 20

_GAP = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def budget(n: int, rate: float = RATE, least: int = LEAST_PIECE) -> int:
    """Edits that an item of n characters may have."""
    return max(0, min(int(rate * n), n // least - 1))


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of the item, of equal length within one, and where they begin."""
    at = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:])]


def myers(pattern_masks: dict[str, int], m: int, text: str) -> int:
    """The least edit distance of the pattern to any stretch of text."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = pattern_masks.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        score += bool(up & top) - bool(down & top)
        best = min(best, score)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
    return best


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """The items of a block, ready for search."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, least: int):
        import ahocorasick

        self.items = []
        for i, x in items:
            edits = budget(len(x), rate, least)
            self.items.append((i, x if edits else f" {x} ", edits, masks(x) if edits else {}, len(x)))
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, x, edits, *_) in enumerate(self.items):
            for at, piece in pieces(x, edits):
                places.setdefault(piece, []).append((k, at + len(piece) - 1))
        for piece, found in places.items():
            self.automaton.add_word(piece, found)
        self.automaton.make_automaton()

    def matches(self, text: str):
        """(number of the item, distance) of each item that the text holds within its budget."""
        text = f" {text} "
        hits: dict[int, set[int]] = {}
        for end, found in self.automaton.iter(text):
            for k, at in found:
                hits.setdefault(k, set()).add(end - at)
        for k, starts in hits.items():
            _, item, edits, mask, _ = self.items[k]
            best = edits + 1
            run: list[int] = []
            for start in [*sorted(starts), None]:  # hits whose stretches overlap are verified together
                if run and (start is None or start - run[-1] > 2 * edits + 1):
                    window = text[max(0, run[0] - edits) : run[-1] + len(item) + edits]
                    best = min(best, 0 if item in window else myers(mask, len(item), window))
                    run = []
                if best == 0:
                    break
                run.append(start)
            if best <= edits:
                yield k, best


def passes_of_items(benchmark: DataFrame):
    """The benchmark's items, normalised, in passes of bounded size; those without content are left out."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    passes = -(-size // PASS_BYTES) or 1
    for k in range(passes):
        own = rows if passes == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        items = sorted(((r[0], normal(r[1])) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if items := [(i, x) for i, x in items if x]:
            yield items


def with_matches(texts_at: int, items, rate: float, least: int, max_items: int, put):
    """A function over batches: put(batch, found), found having (place in the batch, number of the item, distance) and the items."""

    def run(batches):
        held, size, ready = [], 0, None
        for batch in batches:
            held.append((batch, [normal(x) for x in batch.column(texts_at).to_pylist()]))
            size += sum(map(len, held[-1][1]))
            if size >= CHUNK:
                out, ready = worked(held, ready)
                yield from out
                held, size = [], 0
        if held:
            yield from worked(held, ready)[0]

    def worked(held, ready):
        every, found = items.value, [[] for _ in held]
        for at in range(0, len(every), max_items):
            if ready is None or ready[0] != at:
                ready = at, Matcher(every[at : at + max_items], rate, least)
            for own, (_, texts) in zip(found, held, strict=True):
                own += [(row, at + k, d) for row, text in enumerate(texts) if text for k, d in ready[1].matches(text)]
        return [put(batch, own, every) for (batch, _), own in zip(held, found, strict=True)], ready

    return run


MATCHES = "doc_id long, item_id long, n_chars int, budget int, distance int"


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST_PIECE, max_items: int = MAX_ITEMS) -> DataFrame:
    """doc_id, item_id, n_chars (of the normalised item), budget and distance (edits) of each item that a document holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def put(batch, found, items):
        ids = batch.column(0).to_pylist()
        out = [(ids[row], items[k][0], len(items[k][1]), budget(len(items[k][1]), rate, least), d) for row, k, d in found]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 5, types, strict=True)], names=["doc_id", "item_id", "n_chars", "budget", "distance"])

    spark, done = docs.sparkSession, []
    for items in passes_of_items(benchmark):
        found = over(rows, with_matches(1, spark.sparkContext.broadcast(items), rate, least, max_items, put), MATCHES)
        done = [*done[:-1], *map(cut, done[-1:]), found]
    if not done:
        return spark.createDataFrame([], MATCHES)
    out = done[0]
    for found in done[1:]:
        out = out.union(found)
    return out.distinct()


def without_benchmark(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST_PIECE, max_items: int = MAX_ITEMS) -> DataFrame:
    """docs, all their columns, without the rows whose text holds an item of the benchmark."""
    at, spark, kept = docs.columns.index("text"), docs.sparkSession, None

    def put(batch, found, items):
        gone = {row for row, _, _ in found}
        return batch.filter(pa.array([row not in gone for row in range(batch.num_rows)], pa.bool_()))

    for items in passes_of_items(benchmark):
        kept = over(docs if kept is None else cut(kept), with_matches(at, spark.sparkContext.broadcast(items), rate, least, max_items, put), docs.schema)
    return docs if kept is None else kept
