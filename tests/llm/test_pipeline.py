import zlib
from array import array

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from accessloom.llm import decontaminate, pii
from tests.llm.test_near_copies import leaders

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, path):
    rng = np.random.default_rng(21)
    syllables = "the of and er on ing re st nd an it is".split()
    words = lambda n: ["".join(rng.choice(syllables, int(rng.integers(1, 4)))) for _ in range(n)]
    items = [" ".join(words(30)) for _ in range(4)]
    rows = []
    for i in range(260):
        w = words(int(rng.integers(60, 160)))
        if i % 20 == 3:
            w = [x.upper() + "!!###" for x in w]
        elif i % 20 == 5:
            w = w[:30] + items[i % 4].split() + w[30:]
        elif i % 20 == 7:
            w.insert(10, "ann.smith@mail.example.com")
        elif i % 20 == 9:
            w = rows[i - 8][1].split() + ["extra"]
        text = " ".join(w)
        rows.append((i, text, "en", "s1", len(text)))
    rows += [(1000, None, None, None, None), (1001, "too short", "en", "s1", 9)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return {r[0]: r for r in rows}, items


def test_every_stage_takes_effect(spark, tmp_path):
    rows, items = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            docs = P.cut(out)
            kept[name] = {r.doc_id: r for r in docs.collect()}
    first = kept["quality_rules"]
    assert not any(i % 20 == 3 or i >= 1000 for i in first) and len(first) == 260 - 13
    ids = sorted(first)
    assert sorted(kept["near_dedup"]) == leaders([(i, first[i].text) for i in ids])
    assert set(kept["decontaminate"]) == {i for i, r in kept["near_dedup"].items() if not any(decontaminate.normal(x) in decontaminate.normal(r.text) for x in items)}
    replacer = pii.Replacer(pii.key_of(spark))
    for i, r in kept["surrogates"].items():
        assert r.text == replacer.text(rows[i][1])[0] and "ann.smith" not in r.text and r.n_chars == len(r.text)
    pieces = P.run(spark, str(tmp_path)).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: lib.encode(r.text, add_special_tokens=False).ids + [1] for i, r in kept["surrogates"].items()}
    assert {p.doc_id for p in pieces} == set(want)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(array("I", want[p.doc_id][p.start : p.start + p.length]).tobytes())
    assert sum(p.length for p in pieces) == sum(map(len, want.values()))


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_repeated_null_and_clashing_rows_go_through(spark, tmp_path):
    """Rows that repeat an id, have none, are ties or very long; more columns, with names that the operators use themselves."""
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join("".join(rng.choice("the of and er on ing re st nd an it is".split(), int(rng.integers(1, 4)))) for _ in range(n))
    a, b, c, long = prose(60), prose(70), prose(80), prose(30_000)
    rows = [(1, a, "en", "s", len(a), 5, "p"), (1, "bad", "en", "s", 3, 6, "q"), (None, "junk", None, None, 4, 7, "r"), (None, b, "en", "s", len(b), 8, "s"), (2, a, "en", "s", len(a), 9, "t"), (2, c, "en", "s", len(c), 1, "u"), (3, long, "de", "s", len(long), 2, "v"), (3, long, "de", "s", len(long), 2, "v"), (4, None, None, None, None, 3, "w"), (None, b, "en", "s", len(b), 4, "x")]
    docs = spark.createDataFrame(rows, SCHEMA + ", node int, text_hash string")
    spark.createDataFrame([(1, "no such passage in any of these texts, whatever they say")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = P.cut(out)
    got = sorted((r.doc_id or 0, r.text) for r in docs.collect())
    assert got == sorted([(1, a), (0, b), (2, c), (3, long)])
    pieces = P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {1, 2, 3, None}
