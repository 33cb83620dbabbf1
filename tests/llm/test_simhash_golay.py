import numpy as np
import xxhash

from accessloom.llm import simhash_golay as S


def brute(texts):
    prints = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    return prints


def closure(ids, prints):
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return [min(d for d, g in zip(ids, group) if g == mine and d is not None) for mine in group]


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = ["w%d" % i for i in range(400)]
    texts = []
    for _ in range(25):
        base = list(rng.choice(vocab, int(rng.integers(60, 200))))
        texts.append(" ".join(base))
        for _ in range(4):
            near = list(base)
            near[int(rng.integers(len(near)))] = "changed"
            texts.append(" ".join(near).upper() if rng.random() < 0.5 else "\n".join(near))
    texts += [None, "", " \n ", "one", "one two", "ONE\ttwo", "x " * 30000]
    ids = [int(x) for x in rng.permutation(len(texts))]
    docs = spark.createDataFrame([(i, t, "c") for i, t in zip(ids, texts)], "doc_id long, text string, print string")
    got = {r.doc_id: r for r in S.simhash_groups(docs).collect()}
    prints = brute(texts)
    assert [got[i].fingerprint for i in ids] == ["%016x" % p for p in prints]
    assert [got[i].component_id for i in ids] == closure(ids, prints)


def test_all_pairs_within_three_bits_share_a_key():
    rng = np.random.default_rng(5)
    tables = S.golay_tables()
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    for n in (1, 2, 3):
        other = base.copy()
        for i in range(len(base)):
            for b in rng.choice(64, n, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        (k, at), (l, to) = S.keys_of(base, tables), S.keys_of(other, tables)
        assert len({*zip(k.tolist(), at.tolist())} & {*zip(l.tolist(), to.tolist())}) > 0
        shared = {i for _, i in {*zip(k.tolist(), at.tolist())} & {*zip(l.tolist(), to.tolist())}}
        assert shared == set(range(len(base)))
    assert all(S.decode(np.array([w]), tables)[0] == w >> 11 for w in [S._GENERATOR, S._GENERATOR << 5, 0])


def test_hot_keys_are_compared_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = np.random.default_rng(9)
    prints = {0x1234567890ABCDEF}
    while len(prints) < 120:
        x = int(rng.choice(sorted(prints)))
        for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
            x ^= 1 << int(b)
        prints.add(x)
    prints |= {int(x) for x in rng.integers(0, 1 << 62, 30)}
    signed = [int(np.uint64(p).astype(np.int64)) for p in sorted(prints)]
    links = S.links_of(spark.createDataFrame([(p,) for p in signed], "print long")).collect()
    group = {p: p for p in signed}
    for r in links:
        a, b = group[r.u], group[r.v]
        group = {p: a if g == b else g for p, g in group.items()}
    want = closure(signed, [p & (1 << 64) - 1 for p in signed])
    seen = {}
    for p, w in zip(signed, want):
        assert seen.setdefault(w, group[p]) == group[p]
    assert len({*group.values()}) == len({*want})


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert S.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in S.simhash_groups(docs).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (None, None)], key=str)
    assert sorted(((r.doc_id, r.text) for r in S.one_of_each(docs).collect()), key=str) == sorted([(5, "a b c d"), (None, None)], key=str)
