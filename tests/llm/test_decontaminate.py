import numpy as np

from accessloom.llm import decontaminate as D


def least_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def cases():
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("etaoinshé"), int(rng.integers(2, 8))))
    items = [" ".join(word() for _ in range(int(rng.integers(1, 30)))) for _ in range(25)]
    texts = []
    for i in range(70):
        part = list(items[i % 25])
        for _ in range(int(rng.integers(0, 12))):
            at = int(rng.integers(len(part) + 1))
            part[at : at + int(rng.integers(0, 2))] = list(rng.choice(list("xyz "), int(rng.integers(0, 2))))
        own = [word() for _ in range(20)]
        texts.append(" ".join(own[:10]) + " " + "".join(part).upper() + "!! \n" + " ".join(own[10:]))
    return items, texts


def test_matches_equal_brute_force(spark):
    items, texts = cases()
    texts += [None, "", "... !!", items[3] + " a" * 20_000]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "?!"), (92, "")], "item_id long, text string")
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    want = set()
    for i, t in enumerate(texts[:-1]):
        for k, x in enumerate(items):
            x = D.normal(x)
            d = least_distance(x, D.normal(t)) if t else 99
            if not D.budget(len(x)):  # whole words alone
                d = 0 if f" {x} " in f" {D.normal(t)} " else 99
            if x and d <= D.budget(len(x)):
                want.add((i, k, d))
    for n in (7, 1000):
        got = {(r.doc_id, r.item_id, r.distance) for r in D.benchmark_matches(docs, bench, max_items=n).collect()}
        assert {g for g in got if g[0] != len(texts) - 1} == want
        assert (len(texts) - 1, 3, 0) in got
    kept = {r.doc_id for r in D.without_benchmark(docs, bench, max_items=7).collect()}
    assert kept == set(range(len(texts))) - {i for i, _, _ in got}
    assert D.without_benchmark(docs, bench).columns == docs.columns


def test_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "the very same passage"), (1, "the very same passage"), (1, "the very same passage")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.benchmark_matches(docs, none).collect() == [] and D.without_benchmark(docs, none).count() == 3
    bench = spark.createDataFrame([(5, "The very same passage."), (None, "the VERY same passage")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.benchmark_matches(docs, bench).collect()}
    assert got == {(None, 5), (1, 5), (None, None), (1, None)}
    assert D.benchmark_matches(docs.limit(0), bench).collect() == []


def test_short_items_match_whole_words(spark):
    bench = spark.createDataFrame([(1, "art"), (2, "Of the")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a party started"), (2, "modern ART!"), (3, "roof then"), (4, "of, the"), (5, "art")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.distance) for r in D.benchmark_matches(docs, bench).collect()} == {(2, 1, 0), (4, 2, 0), (5, 1, 0)}


def test_blocks_are_one_scan_and_one_worker(spark, monkeypatch):
    items, texts = cases()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(D.without_benchmark(docs, bench, max_items=10)).count("MapInArrow") == 1
    assert plan(D.benchmark_matches(docs, bench, max_items=10)).count("MapInArrow") == 1
    one = {tuple(r) for r in D.benchmark_matches(docs, bench).collect()}
    monkeypatch.setattr(D, "PASS_BYTES", 400)  # several passes, several chunks
    monkeypatch.setattr(D, "CHUNK", 300)
    assert {tuple(r) for r in D.benchmark_matches(docs, bench, max_items=2).collect()} == one
    assert {r.doc_id for r in D.without_benchmark(docs, bench, max_items=2).collect()} == set(range(len(texts))) - {r[0] for r in one}
