import numpy as np
import pytest

from accessloom.llm import suffix_dedup as S
from accessloom.llm.suffix_dedup import repeated_passages


def brute(texts, n):
    """For each (rank of doc) the set of words in a window that occurred earlier."""
    seen, out = set(), {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        hit = set()
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            if x in seen:
                hit |= set(range(k, k + n))
            seen.add(x)
        out[i] = hit
    return out


@pytest.fixture
def many_ranges(spark):
    """So many ranges that suffixes, and rows of one suffix, lie on both sides of their bounds."""
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "61"}
    old = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_neighbours_across_ranges(spark, many_ranges):
    test_passages_equal_brute_force(spark)


def test_across_ranges_carries_the_first_row_of_a_suffix_on():
    row = lambda kind, number, around, doc, turns=False: {"kind": kind, "range": number, "suffix": 7, "around": around, "none": False, "doc_id": doc, "first": 0, "turns": turns}
    ranges = [(0, 1, 10, 1, 10), (1, 1, 11, 1, 11), (3, 1, 11, 1, 12), (4, 2, 9, 2, 13)]
    edges = [row(k, n, a, d) for n, a, d, z, e in ranges for k, a, d in ((S.FIRST, a, d), (S.LAST, z, e), (S.HEAD, a, d))]
    got = [(e["kind"], e["doc_id"], e.get("source")) for e in S.across_ranges(edges)]
    assert got == [(S.MATCH, 11, 10), (S.WANTED, 9, None), (S.WANTED, 10, None)]
    edges[6]["turns"] = True
    assert (S.WANTED, 10) in [(e["kind"], e["doc_id"]) for e in S.across_ranges(edges[:9])]


def test_passages_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    vocab = ["wörd%d" % i if i % 7 == 0 else "w%d" % i for i in range(300)]
    pick = lambda n: list(rng.choice(vocab, n))
    shared = [pick(int(rng.integers(15, 60))) for _ in range(6)]
    texts = []
    for i in range(60):
        w = pick(int(rng.integers(0, 60)))
        for s in rng.choice(6, int(rng.integers(0, 3))):
            part = shared[s]
            cut = int(rng.integers(0, 12))
            w += part[cut:] + pick(int(rng.integers(0, 15)))
        text = " ".join(w)
        texts.append((i, text.upper() if i % 9 == 0 else text.replace(" ", "\n\t", 3)))
    texts += [(60, texts[5][1]), (61, texts[5][1]), (62, None), (63, ""), (64, "same " * 3000), (65, "same " * 200)]
    texts = [(i, t.replace("Ö", "ö") if t else t) for i, t in texts]
    docs = spark.createDataFrame([(i, t, 4, 5) for i, t in texts], "doc_id long, text string, first int, suffix int")
    want = brute(texts, 20)
    got = {i: set() for i, _ in texts}
    whole = dict(texts)
    for r in repeated_passages(docs, 20, 5).collect():
        span = set(range(r.first_word, r.first_word + r.n_words))
        assert not span & got[r.doc_id] and r.n_words >= 20
        got[r.doc_id] |= span
        words = whole[r.doc_id].split()
        assert whole[r.doc_id][r.start : r.start + r.length].split() == words[r.first_word : r.first_word + r.n_words]
        source = (whole[r.source_doc_id].lower().split())[r.source_word : r.source_word + 20]
        assert [w.lower() for w in words[r.first_word : r.first_word + 20]] == source
        assert (r.source_doc_id, r.source_word) < (r.doc_id, r.first_word)
    assert got == want


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    text = " ".join("t%d" % i for i in range(80))
    docs = spark.createDataFrame([(4, text), (4, text), (None, text), (9, "x " * 49)], "doc_id long, text string")
    got = [(r.doc_id, r.first_word, r.n_words, r.source_doc_id) for r in repeated_passages(docs).collect()]
    assert got == [(None, 0, 80, 4)]
