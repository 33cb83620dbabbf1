import zlib

import numpy as np

from accessloom.llm import quality_gam as G


def corpus(n=700):
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice("th er on an re he in ed nd ha".split(), int(rng.integers(1, 4))))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(int(rng.integers(15, 120)))]
        kind = rng.choice(["good", "shout", "symbols", "repeat"], p=[0.7, 0.1, 0.1, 0.1])
        if kind == "shout":
            w = [x.upper() + "!!" for x in w]
        elif kind == "symbols":
            w = [x + "###" for x in w]
        elif kind == "repeat":
            w = w[:8] * (len(w) // 8 + 1)
        docs.append((i, " ".join(w), "en", 5.0))
        labels.append((i, int(kind == "good"), 0))
    return docs, labels


def test_held_out_accuracy_and_scores(spark):
    docs, labels = corpus()
    docs += [(None, None, None, None), (9000, "", "x", 1.0), (9001, "word " * 50_000, "x", 2.0), (5, docs[5][1], "en", 5.0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, quality string, score double")
    got = G.quality_scores(frame, spark.createDataFrame([*labels, (77777, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: r for r in got}
    right, n = 0, 0
    for i, quality, _ in labels:
        r = by_id[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        if r.held_out:
            right, n = right + (r.predicted == quality), n + 1
    assert n > 100 and right / n > 0.97
    assert not by_id[None].held_out and 0 <= by_id[9000].score <= 1 and by_id[9001].predicted == 0


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.random((500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = G.train(x, y)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.9  # only a pair can tell
    for row in x[:20]:
        total = model.intercept
        for j, v in enumerate(row):
            total += model.tables[j][sum(v >= c for c in model.cuts[j])]
        for (i, j), table in zip(model.pairs, model.pair_tables):
            total += table[sum(row[i] >= c for c in model.coarse[i]), sum(row[j] >= c for c in model.coarse[j])]
        assert abs(G.logistic(total) - model.scores(row[None])[0]) < 1e-12


def test_empty_tables_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.score, r.predicted) for r in G.quality_scores(docs, none).collect()] == [(0.5, 0)]
    assert G.quality_scores(docs.limit(0), none).collect() == []
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert 0 < G.quality_scores(docs, one).collect()[0].score < 1
