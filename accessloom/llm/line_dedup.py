"""Substring de-duplication by hashing lines, cut at sentence and clause ends, or paragraphs.

Units are the stretches of a text up to a mark that ends a clause or a line (MARKS), or its paragraphs (between empty lines). A
unit's text is normalised (A-Z lower-cased, runs of white space made one blank, ends trimmed) and hashed (the first eight bytes of
MD5). Digests are grouped over all documents. The earliest occurrence by (doc_id, hash of text, unit) stays; a later one is
removed, its place in the original text kept, if it stands in a run of later occurrences that follow one another and have
LEAST_RUN normalised characters together. Short units repeat by chance in any large corpus; in a run they repeat as part of
something. Every unit is hashed, whatever its length and script. With least_run=1 each later occurrence goes.

Contract: a null text has no units; units without content are passed over and do not end a run. A null doc_id ranks after all
others. Rows that repeat an id with another text rank by the hash of text; rows that repeat id and text are one document: their
runs are given once, and both rows lose them. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, over

LEAST_RUN = 200
#: Marks that end a clause, and the line feed.
MARKS = ".!?,;:。！？，、；：\n"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
CLAUSE = f"[^{MARKS}]*[{MARKS}]+|[^{MARKS}]+"
_CLAUSE = re.compile(CLAUSE)
_PARAGRAPH = re.compile(r"(?:[^\n]|\n(?!\n))+")

UNITS = "doc_id long, hash long, unit int, start int, length int, weight int, digest long"
RUNS = "doc_id long, unit int, n_units int, start int, length int, digest string, first_doc_id long, first_unit int"
#: Units that are passed on at once.
BATCH = 20_000


def units(text: str, paragraphs: bool):
    """Number, start, length, normalised characters and digest of each unit with content."""
    number = 0
    for m in (_PARAGRAPH if paragraphs else _CLAUSE).finditer(text):
        words = m[0].encode().translate(_LOWER).split()
        if words:
            norm = b" ".join(words)
            yield number, m.start(), m.end() - m.start(), len(norm.decode()) + 1, int.from_bytes(md5(norm).digest()[:8], "big", signed=True)
            number += 1


def unit_rows(paragraphs: bool):
    from xxhash import xxh64_intdigest

    schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.int32()) for c in UNITS.split(", ")])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types, strict=True)], schema=schema)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                digest = xxh64_intdigest(text.encode())
                own = digest - (digest >> 63 << 64)
                for unit in units(text, paragraphs):
                    rows.append((doc, own, *unit))
                    if len(rows) >= BATCH:
                        yield batch_of(rows)
                        rows = []
            yield batch_of(rows)

    return run


def run_rows(least: int):
    """Runs of later occurrences, from rows in order of document and unit: doc_id, hash, unit, start, length, weight, digest,
    first_doc_id, first_unit. A run's digest and first are those of its longest unit, the first of equal ones."""

    def runs(part: pa.Table, begins: np.ndarray):
        column = {c: part.column(c).combine_chunks() for c in part.column_names}
        weight = column["weight"].to_numpy().astype(np.int64)
        total = np.add.reduceat(weight, begins)
        sizes = np.diff(np.append(begins, len(weight)))
        place = np.arange(len(weight))
        longest = len(weight) - 1 - np.maximum.reduceat(weight * len(weight) + len(weight) - 1 - place, begins) % len(weight)
        good = total >= least
        first, last, main = pa.array(begins[good]), (begins + sizes - 1)[good], pa.array(longest[good])
        start, length = column["start"].to_numpy(), column["length"].to_numpy()
        found = {
            "doc_id": column["doc_id"].take(first),
            "hash": column["hash"].take(first),
            "unit": column["unit"].take(first),
            "n_units": pa.array(sizes[good], pa.int32()),
            "start": column["start"].take(first),
            "length": pa.array(start[last] + length[last] - start[begins[good]], pa.int32()),
            "digest": pa.array(["%016x" % (x % (1 << 64)) for x in column["digest"].take(main).to_pylist()], pa.string()),
            "first_doc_id": column["first_doc_id"].take(main),
            "first_unit": column["first_unit"].take(main),
        }
        return pa.RecordBatch.from_arrays(list(found.values()), names=list(found))

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            unit, own = held.column("unit").to_numpy(), held.column("hash").to_numpy()
            doc, none = held.column("doc_id").fill_null(0).to_numpy(), held.column("doc_id").is_null().to_numpy()
            same = (own[1:] == own[:-1]) & (doc[1:] == doc[:-1]) & (none[1:] == none[:-1])
            again = np.concatenate([[False], same & (unit[1:] == unit[:-1])])  # of a row that repeats id and text
            if again.any():
                held = held.filter(pa.array(~again))
                unit, same = unit[~again], same[~again[1:]]
            begins = np.concatenate([[0], np.flatnonzero(~(same & (unit[1:] == unit[:-1] + 1))) + 1])
            if len(begins) > 1:  # the last run may go on in the next batch
                yield runs(held.slice(0, int(begins[-1])), begins[:-1])
                held = held.slice(int(begins[-1]))
        if held is not None:
            yield runs(held, np.zeros(1, np.int64))

    return run


def found_runs(docs: DataFrame, paragraphs: bool, least_run: int) -> DataFrame:
    """The runs to remove, with the hash of the text that each stands in."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = over(rows, unit_rows(paragraphs), UNITS)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "unit")
    # Combined before the shuffle: a digest of very many units is a row a task. The join is Spark's to split where a digest is hot.
    firsts = every.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first <> last").select("digest", "first")
    later = every.join(firsts, "digest").where(rank != F.col("first"))
    later = later.select("doc_id", "hash", "unit", "start", "length", "weight", "digest", F.col("first.doc_id").alias("first_doc_id"), F.col("first.unit").alias("first_unit"))
    inner = RUNS.replace("doc_id long, unit", "doc_id long, hash long, unit", 1)
    return over(later.repartition("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "unit"), run_rows(least_run), inner)


def repeated_units(docs: DataFrame, paragraphs: bool = False, least_run: int = LEAST_RUN) -> DataFrame:
    """The runs of units to remove: doc_id, unit (the number of its first among those with content), n_units, start and length
    (characters of the original text), and of its longest unit the digest and the occurrence that stays (first_doc_id, first_unit)."""
    return found_runs(docs, paragraphs, least_run).drop("hash")


def without_units(docs: DataFrame, paragraphs: bool = False, least_run: int = LEAST_RUN) -> DataFrame:
    """docs, all their columns, with the runs cut out of text, and removed_spans (start, length in the original text; another
    underscore is added while docs have a column of that name). Paragraphs go with the end of their line."""
    names = docs.columns
    at = names.index("text")
    spans, own = free_name("removed_spans", names), free_name("text_hash", names)
    doc, text = free_name("cut_doc", names), free_name("cut_text", names)
    found = found_runs(docs, paragraphs, least_run).groupBy(F.col("doc_id").alias(doc), F.col("hash").alias(text))
    cuts = found.agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias(spans))

    def hashed(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            found = [None if x is None else xxh64_intdigest(x.encode()) for x in batch.column(at).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else x - (x >> 63 << 64) for x in found], pa.int64())], names=[*batch.schema.names, own])

    def clipped(text, cuts):
        kept, to = [], 0
        for cut in cuts:
            kept.append(text[to : cut["start"]])
            to = cut["start"] + cut["length"]
            to += paragraphs and text[to : to + 1] == "\n"
        return "".join([*kept, text[to:]])

    def clean(batches):
        for batch in batches:
            columns = list(batch.columns)
            texts = zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)
            columns[at] = pa.array([clipped(t, c) if t is not None and c else t for t, c in texts], batch.schema.types[at])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    keyed = over(docs, hashed, T.StructType([*docs.schema.fields, T.StructField(own, T.LongType())]))
    same = keyed["doc_id"].cast("long").eqNullSafe(cuts[doc]) & (keyed[own] == cuts[text])
    joined = keyed.join(cuts, same, "left").select(*(keyed[c] for c in names), cuts[spans])
    return over(joined, clean, joined.schema)


def oracle(least_run: int = LEAST_RUN) -> str:
    """The runs in every whole document, as repeated_units() finds them; ids are taken to be distinct."""
    marks = MARKS.replace("\n", "\\n")
    return rf"""
WITH parts AS (
  SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS nth
  FROM (SELECT doc_id, regexp_extract_all(text, '[^{marks}]*[{marks}]+|[^{marks}]+') AS p FROM documents WHERE text IS NOT NULL)
), placed AS (
  SELECT doc_id, nth, length(part) AS length,
    trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+', ' ', 'g')) AS norm,
    sum(length(part)) OVER (PARTITION BY doc_id ORDER BY nth) - length(part) AS start
  FROM parts
), units AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS unit, start, length, length(norm) + 1 AS weight, left(md5(norm), 16) AS digest
  FROM placed WHERE norm <> ''
), firsts AS (SELECT digest, min(row(doc_id, unit)) AS first FROM units GROUP BY digest),
later AS (
  SELECT u.*, f.first[1] AS first_doc_id, f.first[2] AS first_unit, u.unit - row_number() OVER (PARTITION BY u.doc_id ORDER BY u.unit) AS run
  FROM units u JOIN firsts f USING (digest) WHERE row(u.doc_id, u.unit) <> f.first
)
SELECT doc_id, min(unit)::INTEGER AS unit, count(*)::INTEGER AS n_units, min(start)::INTEGER AS start, (max(start + length) - min(start))::INTEGER AS length,
  arg_max(digest, row(weight, -unit)) AS digest, arg_max(first_doc_id, row(weight, -unit)) AS first_doc_id, arg_max(first_unit, row(weight, -unit))::INTEGER AS first_unit
FROM later GROUP BY doc_id, run HAVING sum(weight) >= {least_run}
"""
