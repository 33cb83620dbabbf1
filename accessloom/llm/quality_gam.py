"""Quality classifier: a generalised additive model with pairwise interactions.

Features (shares and lengths of the whole text, never its id, language, source or labels) fall into bins. Boosting goes round the
features in turn and gives each a shallow tree over its bins, fitted to the present gradient; its leaves are added to the
feature's lookup table. Then the pairs whose best cross cut gains most on what is left are boosted the same way over coarser bins.
A score is the logistic of the intercept and the table entries of a text's bins: additions over arrays.

Training: labelled documents whose crc32(doc_id) mod FOLDS is not HELD, about MAX_ROWS of them if there are more (those whose hashed
id falls below the share that gives as many), are collected by the driver: a bounded sample, some MB. Everything else covers all documents.

Contract: a null text counts as empty and is scored like any other. Labels that are null or without a document are left out; a
document labelled more than once counts as often. Without labels all scores are 0.5. Every row of documents gives a row, repeated
rows and null ids included (null ids are never held out); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, over
from .text_stats import add_stats

FOLDS, HELD, MAX_ROWS, SPREAD = 4, 2, 40_000, 1 << 40
BINS, COARSE, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, LEAST = 120, 60, 0.1, 3, 5.0

FEATURES = ("log_words", "word_length", "line_words", "symbols", "dup_lines", "repeats", "capitals", "marks")


def feature_columns() -> list[Column]:
    at_least = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    n, chars, lines = at_least("n_words"), at_least("word_chars"), at_least("n_lines")
    parts = (F.log1p("n_words"), F.col("word_chars") / n, F.col("n_words") / lines, F.col("n_symbols") / chars, F.col("n_dup_lines") / lines, F.col("n_repeat_words") / n, F.col("n_upper") / chars, F.col("n_marks") / chars)
    return [x.cast("double").alias(name) for x, name in zip(parts, FEATURES, strict=True)]


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Gam:
    """Lookup tables over the bins of features, and of pairs of features."""

    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fine = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)])
        return fine, np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.coarse)])

    def margins(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[fine[j]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[i], coarse[j]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.margins(x))


def gain(g, h):
    return g * g / (h + 1.0)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf values by bin of a tree of so many leaves, grown by the cut that gains most; g, h: sums by bin."""
    parts = [(0, len(g))]
    sums = lambda a, b: (g[a:b].sum(), h[a:b].sum())
    while len(parts) < leaves:
        best = (1e-9, None)
        for a, b in parts:
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = sums(a, b)
            gains = gain(left_g, left_h) + gain(all_g - left_g, all_h - left_h) - gain(all_g, all_h)
            gains = np.where((left_h < LEAST * 0.05) | (all_h - left_h < LEAST * 0.05), -1.0, gains)
            if len(gains) and gains.max() > best[0]:
                best = (gains.max(), (a, a + 1 + int(gains.argmax()), b))
        if best[1] is None:
            break
        a, at, b = best[1]
        parts = sorted([p for p in parts if p != (a, b)] + [(a, at), (at, b)])
    out = np.zeros(len(g))
    for a, b in parts:
        sum_g, sum_h = sums(a, b)
        out[a:b] = sum_g / (sum_h + 1.0)
    return out


def cross_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of both features of a pair: what it gains, and the values of its four quarters by bin."""
    n, m = g.shape
    best_gain, best = 0.0, np.zeros((n, m))
    if n < 2 or m < 2:
        return best_gain, best
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quarter = lambda c: (q := c[:-1, :-1], c[-1:, :-1] - q, c[:-1, -1:] - q, c[-1, -1] - c[-1:, :-1] - c[:-1, -1:] + q)
    gs, hs = quarter(cg), quarter(ch)
    gains = sum(gain(a, b) for a, b in zip(gs, hs, strict=True)) - gain(cg[-1, -1], ch[-1, -1])
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    values = [a[i, j] / (b[i, j] + 1.0) for a, b in zip(gs, hs, strict=True)]
    best[: i + 1, : j + 1], best[i + 1 :, : j + 1], best[: i + 1, j + 1 :], best[i + 1 :, j + 1 :] = values
    return float(gains[i, j]), best


def train(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of the features, then of the pairs that gain most."""
    quantiles = lambda k: [np.unique(np.quantile(c, np.arange(1, k) / k)) if len(c) else np.empty(0) for c in x.T]
    # Quantiles of a feature that is mostly zero fall together: the rest of its range is cut by its own quantiles.
    spread = lambda k: [np.unique(np.concatenate([q, np.quantile(c[c > 0], np.arange(k // 2) / (k // 2))])) if (c > 0).any() else q for q, c in zip(quantiles(k), x.T, strict=True)]
    model = Gam(spread(BINS), spread(COARSE))
    if not len(y):
        model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
        return model
    model.intercept = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    fine, coarse = model.bins(x)
    margin = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            p = logistic(margin)
            step = RATE * shallow_tree(np.bincount(fine[j], y - p, len(table)), np.bincount(fine[j], p * (1 - p), len(table)), LEAVES)
            table += step
            margin += step[fine[j]]
    shape = [len(c) + 1 for c in model.coarse]

    def sums(i, j, w):
        return np.bincount(coarse[i] * shape[j] + coarse[j], w, shape[i] * shape[j]).reshape(shape[i], shape[j])

    p = logistic(margin)
    every = [(i, j) for i in range(x.shape[1]) for j in range(i)]
    ranked = sorted(every, key=lambda ij: -cross_cut(sums(*ij, y - p), sums(*ij, p * (1 - p)))[0])
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            p = logistic(margin)
            step = RATE * cross_cut(sums(i, j, y - p), sums(i, j, p * (1 - p)))[1]
            table += step
            margin += step[coarse[i], coarse[j]]
    return model


def score_rows(model: Gam):
    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(name).to_numpy(zero_copy_only=False) for name in FEATURES], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.scores(x))], names=["doc_id", "held_out", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from the threshold on) of each document."""
    stats = add_stats(docs, [F.col("doc_id").cast("long").alias("doc_id")])
    rows = cut(stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *feature_columns()))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    labelled = rows.where("not held_out").join(known, "doc_id").select(*FEATURES, "quality", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).alias("place"))
    n = labelled.count()
    taken = labelled.where(F.col("place") < int(SPREAD * min(1.0, max_rows / max(n, 1)))).limit(2 * max_rows).toPandas().sort_values(["place", *FEATURES, "quality"])
    model = train(taken[list(FEATURES)].to_numpy(float), taken["quality"].to_numpy(float))
    scored = over(rows, score_rows(model), "doc_id long, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
