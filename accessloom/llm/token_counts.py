"""Token counts by distinct pre-tokens.

A text is cut where no merge of the vocabulary can reach across: before each run of blanks and at line feeds. Each
distinct pre-token is counted once by the tokenizer, where its rows meet, and the counts are summed by document over
the pre-token frequencies. Token ids of documents are never made.

Contract: a null text counts as empty (0 bytes, 0 tokens). Every row of the input gives one row, repeated rows and null
ids included. Other columns are ignored. An empty table gives no rows. Texts of any length are counted whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over

#: Documents to a batch at most (their places in it fit 16 bits), and bytes of text unless one text alone has more.
BATCH, BATCH_BYTES = 32768, 24 << 20
#: A pre-token that a batch holds more often than this is hot: its rows are dealt over SALTS groups.
HOT, SALTS = 256, 64
#: Batches whose sums a task holds before it passes them on.
HELD = 64

_CUT = re.compile("\n[^▁\n]*|▁*[^▁\n]+|▁+")

_processors: dict = {}


def processor(path: str):
    import sentencepiece

    if path not in _processors:
        _processors[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _processors[path]


def pieces_by_line(text: str) -> list[str]:
    """The keys of a text's pre-tokens by the general rule: a run of blanks joins what follows it, one blank left out."""
    return [x[1:] if x[0] == "▁" else x for x in _CUT.findall("▁" + text.replace(" ", "▁"))] if text else []


def count_keys(keys: list[str], path: str) -> np.ndarray:
    """Tokens of each pre-token. The tokenizer puts a blank before what it is given: that is the one its key left out;
    before a line feed there was none."""
    counts = np.fromiter(map(len, processor(path).encode(keys, num_threads=1)), np.int64, len(keys)) if keys else np.empty(0, np.int64)
    line = np.fromiter((x[:1] == "\n" for x in keys), bool, len(keys))
    blank = np.fromiter((x == "" for x in keys), bool, len(keys))
    return np.where(blank, 1, counts - line)


def batch_keys(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Of each pre-token of the texts: the place of its text (16 bits), and its key."""
    lined = pc.replace_substring(texts, "\n", " \n")
    odd = pc.or_(pc.or_(pc.match_substring(lined, "  "), pc.match_substring(lined, "▁")), pc.or_(pc.starts_with(lined, " "), pc.ends_with(lined, " ")))
    filled = pc.greater(pc.binary_length(texts), 0)
    plain = np.flatnonzero(pc.and_(filled, pc.invert(odd)).to_numpy(zero_copy_only=False))
    parts = pc.split_pattern(lined if len(plain) == len(lined) else lined.take(pa.array(plain)), " ")
    del lined
    at = [np.repeat(plain.astype(np.uint16), pc.list_value_length(parts).to_numpy(zero_copy_only=False))]
    keys = [parts.flatten()]
    del parts
    for i in np.flatnonzero(pc.and_(filled, odd).to_numpy(zero_copy_only=False)):
        found = pieces_by_line(texts[int(i)].as_py())
        at.append(np.full(len(found), i, np.uint16))
        keys.append(pa.array(found, texts.type))
    return np.concatenate(at), pa.chunked_array(keys, texts.type).combine_chunks() if len(keys) > 1 else keys[0]


def parted(texts: pa.Array):
    """Ranges of texts that make a batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, "right"))
        to = min(max(at + 1, fits), at + BATCH)
        yield at, to
        at = to


PARTS = "key string, salt int, batch long, places binary, ids binary, sizes binary, nulls binary"


def split_texts(batches):
    """For each batch: a row with its ids and sizes, and a row for each distinct pre-token with the places it stands at."""
    task, n = TaskContext.get().partitionId(), 0
    schema = pa.schema([("key", pa.string()), ("salt", pa.int32()), ("batch", pa.int64()), ("places", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("nulls", pa.binary())])
    for whole in batches:
        for start, stop in parted(whole.column(1)):
            batch = whole.slice(start, stop - start)
            number, n = (task << 32) | n, n + 1
            texts = batch.column(1).fill_null("")
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(([None], [n % SALTS], [number], [None], [ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes()], [pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], [ids.is_null().to_numpy(zero_copy_only=False).tobytes()]), schema.types)],
                schema=schema,
            )
            at, keys = batch_keys(texts)
            if not len(at):
                continue
            coded = keys.dictionary_encode()
            del keys
            codes = coded.indices.to_numpy(zero_copy_only=False)
            counts = np.bincount(codes, minlength=len(coded.dictionary))
            places = at[np.argsort(codes, kind="stable")].tobytes()
            bounds = np.concatenate([[0], np.cumsum(counts)]) * 2
            distinct = coded.dictionary
            del coded, codes, at, texts, batch
            held = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(places)])
            salt = np.where(counts > HOT, n % SALTS, 0).astype(np.int32)
            none = pa.nulls(len(counts), pa.binary())
            rows = pa.RecordBatch.from_arrays([distinct, pa.array(salt), pa.array(np.full(len(counts), number)), held, none, none, none], schema=schema)
            for k in range(0, rows.num_rows, 20_000):
                yield rows.slice(k, 20_000)
            del rows, held, distinct, places
            pa.default_memory_pool().release_unused()


#: Of one batch, what a task has summed: the places that it has, and their sums (unsigned, 16 and 64 bits).
SUMS = "batch long, places binary, sums binary, ids binary, sizes binary, nulls binary"


def sum_places(path: str):
    """Counts each distinct pre-token once, in rows sorted by key, and sums the counts by batch and place. A batch's sums
    are one row: a document's sum is spread over at most as many rows as it has distinct pre-tokens."""
    schema = pa.schema([("batch", pa.int64()), *((c, pa.binary()) for c in ("places", "sums", "ids", "sizes", "nulls"))])

    def passed(sums):
        for number, total in sums.items():
            place = np.flatnonzero(total)
            parts = (number, place.astype(np.uint16).tobytes(), total[place].tobytes(), None, None, None)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(parts, schema.types, strict=True)], schema=schema)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        last: tuple[str | None, int] = (None, 0)
        for rows in batches:
            own = rows.filter(rows.column("key").is_null())
            if own.num_rows:
                none = pa.nulls(own.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([own.column("batch"), none, none, *(own.column(c).cast(pa.binary()) for c in ("ids", "sizes", "nulls"))], schema=schema)
            rows = rows.filter(rows.column("key").is_valid())
            if not rows.num_rows:
                continue
            coded = rows.column("key").dictionary_encode()  # sorted: only the first can have come before
            keys = coded.dictionary.to_pylist()
            counts = count_keys(keys[1:], path) if keys[0] == last[0] else count_keys(keys, path)
            counts = np.concatenate([[last[1]], counts]) if keys[0] == last[0] else counts
            last = (keys[-1], int(counts[-1]))
            held = rows.column("places").cast(pa.binary())
            ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1] // 2
            places = np.frombuffer(held.buffers()[2], np.uint16)[ends[0] : ends[-1]]
            weight = np.repeat(counts[coded.indices.to_numpy(zero_copy_only=False)], np.diff(ends))
            numbers = rows.column("batch").to_numpy(zero_copy_only=False)
            of = np.repeat(numbers, np.diff(ends))
            for number in np.unique(numbers):
                here = of == number
                total = sums.setdefault(int(number), np.zeros(BATCH, np.int64))
                total += np.bincount(places[here], weights=weight[here], minlength=BATCH).astype(np.int64)
            if len(sums) > HELD:
                yield from passed(sums)
                sums = {}
        yield from passed(sums)

    return run


def sum_batches(batches):
    """The sums of each document, from rows sorted by batch."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    total, docs, last = np.zeros(BATCH, np.int64), None, None

    def rows():
        ids, sizes, nulls = docs
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(sizes), pa.array(total[: len(ids)])], schema=schema)

    for batch in batches:
        for number, places, sums, ids, sizes, nulls in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if number != last:
                if last is not None:
                    yield rows()
                total, docs, last = np.zeros(BATCH, np.int64), None, number
            if ids is None:
                np.add.at(total, np.frombuffer(places, np.uint16), np.frombuffer(sums, np.int64))
            else:
                docs = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), np.frombuffer(nulls, bool)
    if last is not None:
        yield rows()


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each document; model: path of a sentencepiece file
    on every worker."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = over(rows, split_texts, PARTS).repartition("key", "salt", F.when(F.col("key").isNull(), F.col("batch"))).sortWithinPartitions("key")
    sums = over(parts, sum_places(model), SUMS).repartition("batch").sortWithinPartitions("batch")
    found = over(sums, sum_batches, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
