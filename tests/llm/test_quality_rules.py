import re
from collections import Counter

import numpy as np

from accessloom.llm import quality_rules as Q


def base(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    dup = len(lines) - len(set(lines))
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def some_texts():
    rng = np.random.default_rng(4)
    vocab = ["the", "wörd", "x", "a#b", "of", "\U0001f600k", "<p>", "long" * 4]
    out = [None, "", " \n\t", "one", "a b c d e " * 5, "\x0bone\x0ctwo\rthree", "x\n\nx\n x\nx", "w " * 20_000]
    for _ in range(80):
        words = [str(w) for w in rng.choice(vocab, int(rng.integers(0, 60)))]
        out.append("".join(w + str(rng.choice([" ", "\n", "  ", "\t"], p=[0.7, 0.2, 0.05, 0.05])) for w in words))
    return out


def test_base_statistics_equal_brute_force(spark):
    texts = some_texts()
    docs = spark.createDataFrame([(i, t, None, None, 9) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int")
    got = {r.doc_id: r for r in Q.quality(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), repr(t)[:200]
        assert not (r.base_failed and r.kept)


def spread_of(x, mean, cov):
    y = x - mean
    return np.einsum("ij,ij->i", y, np.linalg.solve(cov, y.T).T)


def concentrated(x, mean, cov, steps=60):
    """Concentration steps with the exact h nearest, to the end: (log determinant, mean, covariance)."""
    h = int(np.ceil(len(x) * Q.H))
    for _ in range(steps):
        near = x[np.argsort(spread_of(x, mean, cov), kind="stable")[:h]]
        mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) * Q.SCALE + np.diag(np.array(Q.FLOORS) ** 2)
    return np.linalg.slogdet(cov)[1] / 2, mean, cov


def best_of_many(x, starts=200):
    """The least determinant that concentration finds from many random starts (small groups: the true minimum)."""
    rng = np.random.default_rng(0)
    out = []
    for _ in range(starts):
        near = x[rng.choice(len(x), Q.D + 1, replace=False)]
        out.append(concentrated(x, near.mean(axis=0), np.cov(near.T, bias=True) + np.diag(np.array(Q.FLOORS) ** 2), 25))
    return min(out, key=lambda r: r[0])


def group_rows(spark, groups):
    rows = [(g, i, *map(int, v)) for g, x in groups.items() for i, v in enumerate(np.round(x * Q.UNIT).astype(int))]
    return spark.createDataFrame(rows, "key string, pick long, " + ", ".join(f"x{i} long" for i in range(Q.D)))


def contaminated(seed, n, share, shift):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(Q.D, Q.D))
    x = rng.multivariate_normal(rng.normal(size=Q.D) * 3, a @ a.T / Q.D + np.eye(Q.D), n)
    x[: int(n * share)] += shift * rng.choice([-1, 1], Q.D)
    return np.round(x * Q.UNIT) / Q.UNIT


def test_determinants_are_the_least_over_all_starts(spark):
    groups = {"a": contaminated(1, 400, 0.2, 25), "b": contaminated(2, 60, 0.22, 12), "c": contaminated(3, 150, 0.1, 6), "d": contaminated(4, 90, 0.0, 0)}
    members = group_rows(spark, groups)
    kept = []
    concentrate = Q.concentrated

    def seen(members, state, small):
        kept.append((state, concentrate(members, state, small)))
        return kept[-1][1]

    Q.concentrated = seen
    try:
        found = {r.key: r for r in Q.robust_estimates(members).collect()}
    finally:
        Q.concentrated = concentrate
    state = kept[0][1].collect()
    assert {(r.key, r.start) for r in state} == {(g, k) for g in groups for k in range(Q.STARTS)}
    scale = 0.975 / Q.chi2_cdf(Q.chi2_quantile(0.975, Q.D), Q.D + 2)
    for g, x in groups.items():
        logdet, mean, cov = best_of_many(x)
        own = min(r.logdet for r in state if r.key == g)
        assert abs(own - logdet) < 0.1, g  # of five starts and two hundred
        sure = x[spread_of(x, mean, cov) <= Q.chi2_quantile(0.975, Q.D)]
        want = np.cov(sure.T, bias=True) * scale + np.diag(np.array(Q.FLOORS) ** 2)
        r = found[g]
        assert np.abs(np.array([r[f"m{i}"] for i in range(Q.D)]) - sure.mean(axis=0)).max() < 0.2, g
        factor = np.zeros((Q.D, Q.D))
        factor[np.tril_indices(Q.D)] = [r[f"w{i}{j}"] for i in range(Q.D) for j in range(i + 1)]
        ratio = -np.linalg.slogdet(factor @ factor.T)[1] - np.linalg.slogdet(want)[1]
        assert abs(ratio) < 0.4, (g, ratio)


def test_subsets_have_h_vectors(spark):
    x = contaminated(5, 333, 0.2, 9)
    members = group_rows(spark, {"a": x})
    eye = {f"w{i}{j}": float(i == j) for i in range(Q.D) for j in range(i + 1)}
    states = [dict(key="a", start=k, **{f"m{i}": float(k) for i in range(Q.D)}, **eye) for k in range(3)]
    near = Q.nearest(members, spark.createDataFrame(states), True).collect()
    assert len(near) == 3 and all(abs(r.n - np.ceil(333 * Q.H)) < 1e-6 for r in near)
    for r in near:
        d = np.sort(((x - r.start) ** 2).sum(axis=1))
        ordered = x[np.argsort(((x - r.start) ** 2).sum(axis=1))][: int(r.n + 0.5)]
        assert np.allclose([r[f"s{i}"] / r.n / Q.UNIT for i in range(Q.D)], ordered.mean(axis=0), atol=0.1), d[:3]


def test_junk_goes_and_clean_stays(spark):
    rng = np.random.default_rng(7)
    syllables = "the of and er on ing re st nd an it is".split()
    word = lambda: "".join(rng.choice(syllables, int(rng.integers(1, 4))))
    docs = []
    for i in range(330):
        w = [word() for _ in range(int(rng.integers(30, 200)))]
        junk = i % 11 == 0
        docs.append((i, " ".join(x.upper() + "!!" if junk else x for x in w), "en" if i % 3 else None, f"s{i % 2}" if i % 5 else "rare", junk))
    got = {r.doc_id: r.kept for r in Q.quality(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, x0 boolean")).collect()}
    assert [got[i] for i, *_ in docs] == [not junk for *_, junk in docs]
    kept = Q.kept_rows(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, x0 boolean"))
    assert kept.columns[-1] == "x0" and kept.count() == 300


def test_rows_are_judged_by_themselves(spark):
    good = "a quiet harbour lay below the village where boats were mended through winter"
    rows = [(1, good, 5, "p"), (1, "bad", 6, "q"), (None, "junk", 7, "r"), (None, good, 8, "s"), (2, "x" * 3_000_000 + " " + good, 9, "t"), (3, None, 1, "u"), (1, good, 5, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, row string")
    kept = Q.kept_rows(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted((r.n_words, r.row) for r in kept.collect() if r.row != "t") == [(5, "p"), (5, "p"), (8, "s")]
    assert Q.kept_rows(docs.limit(0)).collect() == []


def test_empty_table_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert Q.quality(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b c d e f g h i j k", "en", "s"), (1, "a b c d e f g h i j k", "en", "s"), (1, "a b c d e f g h i j k", "en", "s")]
    assert [r.kept for r in Q.quality(spark.createDataFrame(rows, schema)).collect()] == [True] * 3


def test_chi_square():
    assert abs(Q.chi2_quantile(0.5, 2) - 1.3862943611) < 1e-8 and abs(Q.chi2_quantile(0.975, 7) - 16.012764) < 1e-5
