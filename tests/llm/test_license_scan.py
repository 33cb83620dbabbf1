import re

import numpy as np

from accessloom.llm import license_scan as L


def brute(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    own, best = set(), 0.5 if starts else 0.0
    for label, key, text in L.TEMPLATES:
        t, k = text.split(), key.split()
        shift = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
        for i in range(len(words)):
            if words[i : i + len(k)] == k:
                b = i - shift
                share = sum(0 <= b + j < len(words) and words[b + j] == w for j, w in enumerate(t)) / len(t)
                if share >= L.MATCHED:
                    own.add(label)
                    best = max(best, share)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | own)), round(best, 9)


def test_rows_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    bits = [t for _, _, t in L.TEMPLATES] + list(L.BASE) + ["cc BY-NC 4.0", "MIT License MIT License", "Licensed under the Apache License, Version 2.0."]
    texts = [None, "", " ", "...", "MIT", "license mit license", "gnu general public", "é cc by"]
    for _ in range(120):
        parts = [str(x) for x in rng.choice(["public", "the", "software", "a", "domain", "İX", "use", "x1"], int(rng.integers(0, 9)))]
        for b in rng.choice(len(bits), int(rng.integers(0, 4))):
            w = bits[b].split()
            if rng.random() < 0.4:
                w[int(rng.integers(len(w)))] = "changed"
            parts += [*w, *(str(x) for x in rng.choice(["and", "of", "z"], 2))]
        texts.append([" ", "\n", ", "][int(rng.integers(3))].join(parts).title() if rng.random() < 0.5 else " ".join(parts))
    texts += ["public domain " * 20_000 + "Released under the MIT License.", "same mit license", "same mit license"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, word string, row int")
    got = {r.doc_id: tuple(r)[1:7] + (round(r.score, 9),) for r in L.licences(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (i, (t or "")[:300])


def test_empty_table_and_null_ids(spark):
    assert L.licences(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(None, "Released under the MIT License."), (None, None)], "doc_id long, text string")
    assert sorted((r.labels, r.n_words) for r in L.licences(docs).collect()) == [("", 0), ("mit", 5)]
