import numpy as np

import corpus_pipeline as P
from accessloom.llm import near_copies as N
from accessloom.llm import simhash_golay as S


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def leaders(rows):
    """The rows that stay, by comparing all with all."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                group = [group[j] if g == group[i] else g for g in group]
    return sorted(min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group))


def corpus():
    rng = np.random.default_rng(4)
    vocab = ["w%d" % i for i in range(500)]
    common = " ".join(rng.choice(vocab, 12))
    texts = [None, "", "one two", "ONE\ttwo", "one two three"]
    for n in range(30):
        base = list(rng.choice(vocab, int(rng.integers(60, 200))))
        for k in range(40 if n == 0 else 5):  # similarities on both sides of 4/5
            near = list(base)
            for at in rng.choice(len(near), int(rng.integers(0, len(near) // 30 + 1)), replace=False):
                near[at] = "c%d" % rng.integers(1000)
            texts.append(" ".join(near).upper() + " " + common)
    return [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]


def test_the_stage_leaves_one_of_all_texts_of_similarity_four_fifths(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = P.near_dedup(spark, docs, "")
    assert out.dtypes == docs.dtypes
    assert sorted(r.doc_id for r in out.collect()) == leaders(rows)


def test_frequent_shingles_last_give_the_same(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    held = N.frequent
    monkeypatch.setattr(N, "frequent", lambda texts: seen.append(held(texts)) or np.empty(0, np.uint64))
    assert sorted(r.doc_id for r in S.one_of_each(docs).collect()) == leaders(rows) and len(seen[0]) > 0


def test_null_and_repeated_ids_and_empty_table(spark):
    assert S.one_of_each(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    docs = spark.createDataFrame([(None, a), (5, a), (5, a), (5, b), (None, b), (None, "alone"), (None, "alone")], "doc_id long, text string")
    assert sorted(S.one_of_each(docs).collect(), key=str) == sorted([(5, a), (5, b), (None, "alone")], key=str)
    one = spark.createDataFrame([(1, "a b c d", 7, 8), (2, "a b c d", 7, 9), (2, "unique text", 1, 2)], "doc_id long, text string, row_at int, node int")
    assert sorted(S.one_of_each(one).collect()) == [(1, "a b c d", 7, 8), (2, "unique text", 1, 2)]


def test_pairs_are_linked_by_trees_first():
    """Of 300 copies that differ in a word or two, fewer pairs are compared than there are copies, key by key."""
    rng = np.random.default_rng(1)
    base = ["w%d" % x for x in rng.integers(0, 10_000, 120)]
    texts = [" ".join(base[:k] + ["x%d" % k] + base[k + 1 :]) for k in range(3, 103)]
    sets = [next(iter(N.shingle_sets(N.pa.array([t])))) for t in texts]
    common = set.intersection(*({int(x) for x in s} for s in sets))
    n = len(sets)
    columns = [[min(common, default=0)] * n, list(range(n)), [len(s) for s in sets], [0] * n, list(range(n))]
    batch = N.pa.RecordBatch.from_arrays([*(N.pa.array(c, N.pa.int64()) for c in columns), N.pa.array([N.parity(s) for s in sets])], names=["key", "node", "n", "place", "root", "bits"])
    [tree] = list(N.candidates(True)(iter([batch])))
    assert tree.num_rows == n - 1
    [every] = list(N.candidates(False)(iter([batch])))
    assert every.num_rows == n * (n - 1) // 2


def edited(base, changes, rng):
    """The text with that many words changed, far enough apart that each changes five shingles."""
    words = list(base)
    for at in rng.choice(len(base) // 6, changes, replace=False):
        words[6 * at + 2] = "e%d" % rng.integers(1 << 40)
    return " ".join(words)


def test_pairs_that_meet_in_many_shingles_are_made_about_once(spark):
    """Pairs are as good as distinct over tasks and batches, and the same ones as without the keys before."""
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(3):
        base = ["w%d" % x for x in rng.integers(0, 10_000, 400)]
        texts += [edited(base, int(rng.integers(3, 6)), rng) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "at long, text string")
    met = N.cut(N.meetings(docs))
    sets = N.cut(N.over(docs, N.set_rows, "at long, node long, n int, bits binary, print long"))
    nodes = N.cut(sets.selectExpr("node", "node as root", "bits"))
    plain = met.select("key", "node", "n", "place")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(batch)
    for tree in (True, False):
        spark.conf.set(batch, 500)
        try:
            made, often = ([tuple(sorted((r.u, r.v))) for r in N.pairs(x, nodes, tree).collect()] for x in (met, plain))
        finally:
            spark.conf.set(batch, was)
        assert len(made) < 1.3 * len({*made})
        if not tree:
            assert {*made} == {*often} and len(often) > 2 * len({*often})
            continue
        for found in ({*made}, {*often}):
            group = {x: x for r in found for x in r}
            for u, v in found:
                a, b = group[u], group[v]
                group = {x: a if g == b else g for x, g in group.items()}
            assert len(group) == len(texts) and len({*group.values()}) == 3


def test_long_bitmaps_pass_few_pairs_that_are_no_near_copies():
    """Texts of 396 shingles whose sets differ in 100 (88 are allowed): few of the pairs that 512 bits let pass remain."""
    rng = np.random.default_rng(7)
    base = ["w%d" % x for x in rng.integers(0, 10_000, 400)]
    sets = [next(iter(N.shingle_sets(N.pa.array([edited(base, 5, rng)])))) for _ in range(40)]
    passed = {}
    for bits in (N.BITS, N.WIDE):
        maps = [np.frombuffer(N.parity(s, bits), np.uint64) for s in sets]
        apart = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.setxor1d(sets[i], sets[j])) == 100]
        passed[bits] = sum(9 * int(np.bitwise_count(maps[i] ^ maps[j]).sum()) <= 2 * 396 for i, j in apart)
    assert len(apart) > 300 and passed[N.WIDE] < passed[N.BITS] / 5


def test_a_large_group_on_both_sides_of_four_fifths(spark):
    rng = np.random.default_rng(8)
    rows = []
    for n, words in enumerate((400, 1500)):
        base = ["w%d" % x for x in rng.integers(0, 10_000, words)]
        low, high = (3, 8) if words == 400 else (14, 24)
        rows += [(1000 * n + i, edited(base, int(rng.integers(low, high)), rng)) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = leaders(rows)
    assert 10 < len(want) < 130
    assert sorted(r.doc_id for r in S.one_of_each(docs).collect()) == want
