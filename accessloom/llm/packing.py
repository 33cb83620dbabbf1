"""Packing along a space-filling curve.

Each document becomes a hashed vector (damped word counts over 2**BUCKET_BITS hash buckets, of unit length), projected to DIMS
Gaussian directions; each coordinate is spread evenly by the normal distribution function and cut to BITS bits, and the
cell's number on the Hilbert curve is the document's key. Documents are range-sorted by (key, doc_id), so a key held by very many
documents still spreads over tasks; within each range they are tokenised and laid end to end into sequences of SIZE
tokens, cut where a sequence is full. Only the last sequence of a range can be padded.

White space never lies within the vocabulary's pre-tokens, so each of them is encoded once and remembered (a bounded store in
each worker).

The ranges, of RANGE_BYTES at most on average, come from a sample that grows with their number (for their bounds alone; every
document is packed) and hold like amounts of text, so that long documents, which lie close together, do not meet in one task. The
sample is picked by a hash of the row, so the result is the same for any layout of files.

Contract: a null text counts as empty: its only token is the end id. Every row gives its pieces, repeated rows and null ids
included. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over
from .hashing import U, blocks, lowered, mix, span_hashes, text_bytes, word_spans

SIZE, END = 2048, 1
BUCKET_BITS, DIMS, BITS = 10, 4, 8
#: Words whose ids a worker remembers.
HELD = 600_000
#: Bytes of text to a range (there are as many ranges as shuffle partitions at least), and documents of the sample for their
#: bounds: so many in all, or to a range if that is more.
RANGE_BYTES, SAMPLE, TO_A_RANGE = 256 << 20, 20_000, 50


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (a row of coordinates below 2**bits each)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations, from the top bit down
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> bit & 1
    return key


def word_buckets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash bucket of each whole word (A-Z lower-cased), and the bounds of each text's words. Characters of three bytes or more
    in UTF-8 are words by themselves: most such scripts have no blanks between words."""
    data = lowered(data)
    starts, ends, of_text = word_spans(data, bounds)
    if (data >= 0xE0).any():
        begins = np.zeros(len(data) + 1, bool)
        begins[starts] = True
        wide = np.flatnonzero(data >= 0xE0)
        begins[wide] = True
        after = wide + 3 + (data[wide] >= 0xF0)
        stops = np.zeros(len(data) + 1, bool)
        stops[ends] = True
        after = after[~stops[after]]  # what follows a wide character within a word begins another
        begins[after] = True
        starts = np.flatnonzero(begins)
        cuts = np.flatnonzero(begins | stops)
        ends = cuts[np.searchsorted(cuts, starts, "right")]
        of_text = np.searchsorted(starts, bounds)
    return (span_hashes(data, starts, ends) >> U(64 - BUCKET_BITS)).astype(np.int64), of_text


def curve_keys(texts: pa.Array) -> np.ndarray:
    directions = np.random.default_rng(6).standard_normal((1 << BUCKET_BITS, DIMS))
    whole, offsets = text_bytes(texts)
    out = np.zeros(len(texts), np.int64)
    for lo, hi in blocks(offsets):
        bucket, of_text = word_buckets(whole[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        step = 2000  # texts at a time: their counts are a matrix
        for a in range(0, hi - lo, step):
            b = min(a + step, hi - lo)
            sizes = np.diff(of_text[a : b + 1])
            cell = (np.repeat(np.arange(b - a), sizes) << BUCKET_BITS) + bucket[of_text[a] : of_text[b]]
            counts = np.bincount(cell, minlength=(b - a) << BUCKET_BITS).reshape(b - a, -1)
            row, at = np.nonzero(counts)
            damped = np.log1p(counts[row, at])
            norm = np.sqrt(np.bincount(row, weights=damped * damped, minlength=b - a))
            z = np.stack([np.bincount(row, weights=damped * directions[at, d], minlength=b - a) for d in range(DIMS)], axis=1)
            spread = 1 / (1 + np.exp(-1.702 * z / np.where(norm, norm, 1)[:, None]))
            out[lo + a : lo + b] = hilbert(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)
    return out


def key_rows(bounds: np.ndarray | None):
    """doc_id, text and key of each document, and its range: of equal bounds at its key, one that its id picks."""

    def run(batches):
        for batch in batches:
            keys = curve_keys(batch.column(1))
            if bounds is None:
                size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys), size], names=["curve", "size"])
                continue
            first, last = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
            pick = mix(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) % (last - first + 1).astype(U)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys), pa.array((first + pick.astype(np.int64)).astype(np.int32))], names=["doc_id", "text", "curve", "part"])

    return run


def range_bounds(rows: DataFrame, least: int) -> np.ndarray:
    """Upper bounds of all ranges but the last, by the text that a bounded sample has below them."""
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    parts = max(least, -(-size // RANGE_BYTES))
    sample = max(SAMPLE, TO_A_RANGE * parts)
    share = 1 << 40 if n <= sample else (sample << 40) // n
    some = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < share)
    found = over(some, key_rows(None), "curve long, size long").limit(2 * sample).toPandas().sort_values(["curve", "size"])
    total = (found["size"] + 100).cumsum().to_numpy()
    if not len(total):
        return np.empty(0, np.int64)
    return found["curve"].to_numpy()[np.searchsorted(total, total[-1] * np.arange(1, parts) / parts)]


def _ranges(kinds: str) -> str:
    """The characters of a general category in the range that PLAIN covers, for a character class."""
    return "".join(map(re.escape, (c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] in kinds)))


#: Characters that the library might compose, decompose or cut in another way than the pattern below; texts with these are cut
#: into runs between white space, and runs with them are encoded by the library itself.
ODD = re.compile("[^\t-\r -~\xa1-\xac\xae-\u012f\u0131-\u024f]|<\\|")
#: The vocabulary's pre-tokens in all other texts (fixed: the pattern of its file).
_PRE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_ranges('L')}]+|[{_ranges('N')}]|[^\t-\r {_ranges('LN')}]+")


class Words(dict):
    """Ids of words, encoded when first asked for."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level letters: these bytes stand for themselves
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {**{b: b for b in visible}, **{b: 256 + i for i, b in enumerate(hidden)}}

    def __missing__(self, word: str) -> bytes:
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        found = self[word] = array("I", [t.id for t in tokens]).tobytes()
        return found


class Encoder:
    """Ids of texts as little-endian 32-bit numbers, equal to the library's own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Words(self.tokenizer.model)

    def ids(self, text: str) -> bytes:
        if len(self.words) > HELD:
            self.words.clear()
        if ODD.search(text):
            return b"".join(map(self.run, text.encode().split()))
        return b"".join(map(self.words.__getitem__, _PRE.findall(text.lower())))

    def run(self, run: bytes) -> bytes:
        text = run.decode()
        if ODD.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.words.__getitem__, _PRE.findall(text.lower())))


_encoders: dict[str, Encoder] = {}

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(path: str, size: int, end: int):
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])

    def run(batches):
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder, last = _encoders[path], array("I", [end]).tobytes()
        sequence, used = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), (encoder.ids(x or "") for x in batch.column(1).to_pylist()), strict=True):
                ids += last
                n, start = len(ids) // 4, 0
                while start < n:
                    length = min(size - used, n - start)
                    out.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, sequence, used))
                    start, used = start + length, used + length
                    if used == size:
                        sequence, used = sequence + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [()] * 7)], schema=schema)

    return run


def packed_pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END) -> DataFrame:
    """A row for each piece of a document in a sequence: start and length in the document's ids, the CRC-32 of its ids, all
    the document's tokens, its sequence and its place there. vocabulary: path of a tokenizers file on every worker."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounds = range_bounds(rows, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = over(rows, key_rows(bounds), "doc_id long, text string, curve long, part int")
    ranged = keyed.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("curve", "doc_id", "text")
    return over(ranged.select("doc_id", "text"), packed(vocabulary, size, end), PIECES)
