"""Repeated passages by a sparse suffix array.

Of all suffixes (by words, A-Z lower-cased) only those are retained that begin at minimisers: of the GRAM-word runs in each
window of `words` words, the first with the least hash. Two equal windows select the same place in both. The suffixes are
sorted by the hash of their first words, then by the hash of all words to the left and right that the windows of the minimiser
cover, then by document and place: in ranges, so that a frequent suffix is split among as many tasks as it needs, and within
them. Each suffix is compared with its neighbour before it; the neighbours across the bounds of ranges are compared on the
driver, from three rows a range. Matches are then extended: a suffix whose neighbour agrees in all that is covered is a match
over all of it; where neighbours agree at first but their surroundings differ, their windows are compared one by one. Runs
of matched windows make maximal passages.

A passage is a run of words, each in a window of `words` words that also occurs earlier: in a document of a smaller id or
further left in the same one. The first occurrence is never reported; each passage names an earlier occurrence.

Contract: a null text counts as empty. A null doc_id ranks after all others; rows that repeat an id count as one document.
Other columns are ignored. An empty table gives no rows. Hashes have 64 bits; all comparisons are of hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, over
from .hashing import BASE, BASE_INV, U, blocks, char_counts, gram_hashes, lowered, mix, powers, span_hashes, text_bytes, word_spans

#: Words of the least passage, and of the runs among which minimisers are chosen.
WORDS, GRAM = 50, 8

SUFFIXES = "suffix long, around long, doc_id long, first int, n int, start int, stop int"


def hashed_words(data: np.ndarray, bounds: np.ndarray):
    """Word hashes of a block of texts, their spans, and the bounds of each text's words."""
    data = lowered(data)
    starts, ends, of_text = word_spans(data, bounds)
    return span_hashes(data, starts, ends), starts, ends, of_text


def suffix_rows(words: int, gram: int):
    """suffix: hash of the run at a minimiser; around: of all words that its windows cover; first: its first window (in
    words), n: how many windows it has; start, stop: characters of what they cover."""
    schema = pa.schema([("suffix", pa.int64()), ("around", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int32()) for c in ("first", "n", "start", "stop"))])

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            whole, offsets = text_bytes(batch.column(1))
            for lo, hi in blocks(offsets):
                data, bounds = whole[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                hashes, starts, ends, of_text = hashed_words(data, bounds)
                if len(hashes) < words:
                    continue
                text = np.repeat(np.arange(hi - lo), np.diff(of_text))
                grams = gram_hashes(hashes, gram)
                at = np.flatnonzero(text[: len(text) - words + 1] == text[words - 1 :])
                if not len(at):
                    continue
                least = (np.arange(len(hashes) - words + 1) + sliding_window_view(grams, words - gram + 1).argmin(axis=1))[at]
                new = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
                a, b, p = at[new], at[np.concatenate([new[1:], [len(at)]]) - 1], least[new]
                prefix = np.zeros(len(hashes) + 1, U)
                np.cumsum(hashes * powers(BASE, len(hashes)), out=prefix[1:])
                around = mix((prefix[b + words] - prefix[a]) * powers(BASE_INV, len(hashes))[a])
                around = mix(around + mix((p - a).astype(U) << U(32) | (b - a).astype(U)))
                chars, doc = char_counts(data), text[a]
                zero = chars[bounds[doc]]
                cols = (grams[p].view(np.int64), around.view(np.int64), ids.take(pa.array(doc + lo)), *(x.astype(np.int32) for x in (a - of_text[doc], b - a + 1, chars[starts[a]] - zero, chars[ends[b + words - 1]] - zero)))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], schema=schema)

    return run


#: What comparing neighbours finds: a match with the neighbour before, a suffix whose windows are wanted, and of each range its
#: first row (turns: whether the suffix of that row has other surroundings further on), its last, and the first of the last one's suffix.
MATCH, WANTED, FIRST, LAST, HEAD = range(5)
MARKS = "kind int, range int, suffix long, around long, none boolean, doc_id long, first int, n int, start int, stop int, turns boolean, source_none boolean, source long, source_first int"
SORTED = ["suffix", "around", "none", "doc_id", "first", "n", "start", "stop"]


def neighbour_rows(batches):
    """Marks of one sorted range of suffixes. Rows that repeat a document and place are left out."""
    number = TaskContext.get().partitionId()
    schema = pa.schema([(c, {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for c, t in (x.split() for x in MARKS.split(", "))])
    before = begin = head = None
    runs, turns = 0, False

    def marks(kind, rows, sources=None, turns=False):
        size = len(rows["suffix"])
        none, source, first = (sources[c] for c in SORTED[2:5]) if sources else (np.zeros(size, bool), np.zeros(size, np.int64), np.zeros(size, np.int32))
        cols = [np.full(size, kind), np.full(size, number), *rows.values(), np.full(size, turns), none, source, first]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    for batch in batches:
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in SORTED}
        if not len(rows["suffix"]):
            continue
        one = lambda rows, i: {c: v[i : i + 1] if i >= 0 else v[-1:] for c, v in rows.items()}
        prior = {c: np.concatenate([(before or one(rows, 0))[c], v[:-1]]) for c, v in rows.items()}
        equal = {c: rows[c] == prior[c] for c in SORTED[:5]}
        if before is None:
            begin = one(rows, 0)
            equal["suffix"][0] = False
        suffix = equal["suffix"]
        around = suffix & equal["around"]
        new = ~(around & equal["none"] & equal["doc_id"] & equal["first"])
        some = lambda rows, at: {c: v[at] for c, v in rows.items()}
        yield marks(MATCH, some(rows, around & new), some(prior, around & new))
        # Where surroundings change within a suffix, the windows of that row and of the suffix's first row are wanted.
        change, run = suffix & ~around, np.cumsum(~suffix)
        begins, changed = np.flatnonzero(~suffix), np.unique(run[change])
        yield marks(WANTED, some(rows, np.concatenate([np.flatnonzero(change), begins[changed[changed > 0] - 1]])))
        if len(changed) and changed[0] == 0:
            yield marks(WANTED, head)
        turns |= bool((changed + runs == 1).any())
        runs += len(begins)
        head = one(rows, int(begins[-1])) if len(begins) else head
        before = one(rows, -1)
    if before:
        yield marks(FIRST, begin, turns=turns)
        yield marks(LAST, before)
        yield marks(HEAD, head)


def across_ranges(edges: list[dict]) -> list[dict]:
    """The marks of neighbours in different ranges, from the FIRST, LAST and HEAD marks of all."""
    out, head, last = [], None, None
    for number in sorted({e["range"] for e in edges}):
        mine = {e["kind"]: e for e in edges if e["range"] == number}
        first, goes_on = mine[FIRST], last is not None and last["suffix"] == mine[FIRST]["suffix"]
        if goes_on:
            same = last["around"] == first["around"]
            place = lambda e: (e["none"], e["doc_id"], e["first"])
            if same and place(last) != place(first):
                out.append(first | {"kind": MATCH, "source_none": last["none"], "source": last["doc_id"], "source_first": last["first"]})
            if not same:
                out.append(first | {"kind": WANTED})
            if not same or first["turns"]:
                out.append(head | {"kind": WANTED})
        last = mine[LAST]
        if not goes_on or last["suffix"] != first["suffix"]:
            head = mine[HEAD]
    return out


WINDOWS = "window long, doc_id long, first int, start int, stop int"


def window_rows(words: int):
    """The hash of each wanted window; wanted: first and n of runs of windows."""
    schema = pa.schema([("window", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int32()) for c in ("first", "start", "stop"))])

    def run(batches):
        for batch in batches:
            ids, wanted = batch.column(0), batch.column(2).to_pylist()
            whole, offsets = text_bytes(batch.column(1))
            for lo, hi in blocks(offsets):
                data, bounds = whole[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                hashes, starts, ends, of_text = hashed_words(data, bounds)
                found = gram_hashes(hashes, words)
                doc = np.concatenate([np.full(x["n"], i) for i in range(lo, hi) for x in wanted[i]]) - lo
                first = np.concatenate([np.arange(x["first"], x["first"] + x["n"]) for i in range(lo, hi) for x in wanted[i]])
                fits = of_text[doc] + first + words <= of_text[doc + 1]
                doc, first = doc[fits], first[fits]
                at, chars = of_text[doc] + first, char_counts(data)
                zero = chars[bounds[doc]]
                cols = (found[at].view(np.int64), ids.take(pa.array(doc + lo)), *(x.astype(np.int32) for x in (first, chars[starts[at]] - zero, chars[ends[at + words - 1]] - zero)))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], schema=schema)

    return run


PASSAGES = "doc_id long, start int, length int, first_word int, n_words int, source_doc_id long, source_word int"


def merged(batches):
    """Maximal passages of each document, from matches in order of doc_id and first word."""
    names = ["doc_id", "start", "length", "first_word", "n_words", "source_doc_id", "source_word"]
    schema = pa.schema([(c, pa.int64() if "id" in c else pa.int32()) for c in names])
    now, out = None, []
    for batch in batches:
        for doc, first, last, start, stop, source, source_word in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "first", "last", "start", "stop", "source", "source_first")), strict=True):
            if now and now[0] == doc and first <= now[2]:
                now[2], now[4] = max(now[2], last), max(now[4], stop)
                continue
            if now:
                out.append(now)
            now = [doc, first, last, start, stop, source, source_word]
        if len(out) > 20_000:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (d, s, e - s, f, t - f, q, w))) for d, f, t, s, e, q, w in out], schema=schema)
            out = []
    out += [now] if now else []
    yield pa.RecordBatch.from_pylist([dict(zip(names, (d, s, e - s, f, t - f, q, w))) for d, f, t, s, e, q, w in out], schema=schema)


def repeated_passages(docs: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """doc_id, start and length (characters of the original text), first_word and n_words of every repeated passage, and
    source_doc_id and source_word of an earlier occurrence of its beginning."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    suffixes = cut(over(rows, suffix_rows(words, gram), SUFFIXES))
    keyed = suffixes.withColumn("none", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long"))).select(SORTED)
    marks = cut(over(keyed.repartitionByRange(*SORTED[:5]).sortWithinPartitions(*SORTED[:5]), neighbour_rows, MARKS))
    # Three rows a range, whatever the documents hold.
    edges = [r.asDict() for r in marks.where(F.col("kind") >= FIRST).collect()]
    marks = marks.union(docs.sparkSession.createDataFrame([tuple(e.values()) for e in across_ranges(edges)], MARKS))
    marks = marks.withColumn("doc_id", F.when(~F.col("none"), F.col("doc_id"))).withColumn("source", F.when(~F.col("source_none"), F.col("source")))
    whole = marks.where(F.col("kind") == MATCH)
    whole = whole.select("doc_id", "first", (F.col("first") + F.col("n") + (words - 1)).alias("last"), "start", "stop", "source", "source_first")
    wanted = marks.where(F.col("kind") == WANTED).groupBy(F.col("doc_id").alias("want_id")).agg(F.collect_set(F.struct("first", "n")).alias("wanted"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "first")
    again = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["want_id"])).select("doc_id", "text", "wanted")
    windows = cut(over(again, window_rows(words), WINDOWS))
    firsts = windows.groupBy("window").agg(F.min(rank).alias("head"), F.max(rank).alias("tail")).where("head <> tail").select("window", "head")
    single = windows.join(firsts, "window").where(rank != F.col("head"))
    single = single.select("doc_id", "first", (F.col("first") + words).alias("last"), "start", "stop", F.col("head.doc_id").alias("source"), F.col("head.first").alias("source_first"))
    matches = whole.union(single).repartition("doc_id").sortWithinPartitions("doc_id", "first", "last")
    return over(matches, merged, PASSAGES)
