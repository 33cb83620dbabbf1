"""Quality rules: robust multivariate outliers by minimum covariance determinants, in DataFrame functions alone.

Base rule: a text of fewer than 10 words, or with over a fifth of its words in repeated five-word windows, fails. The statistics
of the others, transformed (FEATURES), make a vector; for each language and source the h = H share of vectors with the
covariance of least determinant is sought by concentration steps (FAST-MCD): distances under the present mean and
covariance, the h nearest, their mean and covariance, and so on. The starts are the coordinate-wise median with the median
absolute deviation, and small hashed subsets; steps go on until no determinant falls any more, the least determinant wins, and one
reweighting step follows. A vector whose squared Mahalanobis distance exceeds CUTOFF is rejected. Languages and sources with
fewer than LEAST documents use the estimate of their language, or of all documents, however few.

The h nearest are found without a sort: distances fall into fixed bins, each bin's count, sums and products are one
combined aggregate, the bins are accumulated in order, and of the bin in which the h-th vector falls the mean vector and mean
products count as often as vectors lack to h. So every start has a subset of the same size. Vectors are whole numbers
(hundredths), so sums are exact and equal on every run. FLOORS are added to the variances: a statistic that hardly varies does
not reject what differs a little.

Contract: null texts count as empty and fail the base rule. Null lang or source are a value of their own. Every row
gives a row and is judged by itself, repeated rows, repeated ids and null ids included; other columns are ignored (kept_rows()
keeps them, whatever their names); an empty table gives no rows. Words longer than LONGEST on average count as that long. A text
is one value of a row: it must fit the JVM's limit for one (2 GB).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut
from .text_stats import STATS, add_stats

LEAST_WORDS, REPEATED = 10, 20
H, STARTS = 0.75, 10
#: Concentration steps between two tests whether determinants still fall, such rounds at most, and what counts as falling
#: (of the logarithm of the determinant's root).
STEPS, ROUNDS, STILL = 1, 20, 1e-3
#: Squared distance beyond which a document is rejected: the chi-square quantile of this probability.
SURE = 1 - 1e-6
PER_OCTAVE, BINS = 32, 960
#: Rows of estimates (some 400 bytes each) that are broadcast at most.
FEW = 10_000
UNIT, LONGEST = 100, 1000

#: The transformed statistics, and the least deviation that counts as one (added to the variance, squared).
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "marks")
FLOORS = (0.3, 0.4, 0.4, 0.8, 0.8, 0.5, 0.5)
D = len(FEATURES)
#: Documents that an estimate of their own takes.
LEAST = 5 * D


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the incomplete gamma function."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return low


#: Makes the covariance of the nearest H share consistent for normal vectors.
SCALE = H / chi2_cdf(chi2_quantile(H, D), D + 2)
CUTOFF = chi2_quantile(SURE, D)


def vector() -> list[Column]:
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    share = lambda x, of: F.log1p(100 * F.col(x) / of)
    parts = (F.log(n), F.least(chars / n, F.lit(LONGEST)), share("n_symbols", chars), share("n_dup_lines", lines), share("n_repeat_words", n), share("n_upper", chars), share("n_marks", chars))
    return [F.round(x * UNIT).cast("long").alias(f"x{i}") for i, x in enumerate(parts)]


#: The places of a lower triangle, row by row.
TRIANGLE = [(i, j) for i in range(D) for j in range(i + 1)]

# The expressions below are written as SQL: as columns, each of their hundreds of nodes would be a call to the JVM.


def squared_distance() -> Column:
    """Of x0.. from m0.. under w00.., the inverse of the covariance's Cholesky factor."""
    parts = ["(" + " + ".join(f"w{i}{j} * (x{j} / {UNIT}D - m{j})" for j in range(i + 1)) + ")" for i in range(D)]
    return F.expr(" + ".join(f"{y} * {y}" for y in parts))


MOMENTS = ["n", *(f"s{i}" for i in range(D)), *(f"p{i}{j}" for i, j in TRIANGLE)]


def moments() -> list[Column]:
    sums = ["count(1)", *(f"sum(x{i})" for i in range(D)), *(f"sum(x{i} * x{j})" for i, j in TRIANGLE)]
    return [F.expr(f"{x} AS {c}") for x, c in zip(sums, MOMENTS, strict=True)]


def estimate(df: DataFrame, scale: float, keys: list[str]) -> DataFrame:
    """keys, means m0.., the inverse w00.. of the Cholesky factor of the covariance, and the log determinant of the factor, from
    moments. The factor and its inverse are made element by element over one array (row by row; element (i, j) follows
    i * (i + 1) / 2 + j others), so no expression holds another twice."""
    array = lambda parts: f"array({', '.join(parts)})"
    floor = array(f"{FLOORS[i] ** 2 if i == j else 0.0}D" for i, j in TRIANGLE)
    covariance = array(f"(p{i}{j} / n / {UNIT**2}D - s{i} / n / {UNIT}D * (s{j} / n / {UNIT}D)) * {scale}D" for i, j in TRIANGLE)
    df = df.selectExpr(*keys, *(f"s{i} / n / {UNIT}D AS m{i}" for i in range(D)), f"zip_with({covariance}, {floor}, (c, f) -> c + f) AS c", f"{floor} AS f")
    place = array(f"struct({i} AS i, {j} AS j)" for i, j in TRIANGLE)
    spot = lambda i, j: f"int({i} * ({i} + 1) / 2 + {j} + 1)"
    of = lambda a, i, j: f"{a}[{spot(i, j)} - 1]"
    dot = lambda low, high, x, y: f"aggregate(IF({low} > {high}, array(), sequence({low}, {high})), 0D, (t, k) -> t + {x} * {y})"
    rest = f"{of('c', 'p.i', 'p.j')} - {dot('0', 'p.j - 1', of('a', 'p.i', 'k'), of('a', 'p.j', 'k'))}"
    element = f"IF(p.i = p.j, sqrt(greatest({rest}, {of('f', 'p.i', 'p.j')} / 4)), ({rest}) / {of('a', 'p.j', 'p.j')})"
    df = df.selectExpr("*", f"aggregate({place}, cast(array() AS array<double>), (a, p) -> concat(a, array({element}))) AS l")
    total = dot("p.j", "p.i - 1", of("l", "p.i", "k"), of("a", "k", "p.j"))
    element = f"(IF(p.i = p.j, 1D, 0D) - {total}) / {of('l', 'p.i', 'p.i')}"
    df = df.selectExpr("*", f"aggregate({place}, cast(array() AS array<double>), (a, p) -> concat(a, array({element}))) AS w")
    logdet = " + ".join(f"log(l[{i * (i + 3) // 2}])" for i in range(D))
    return df.selectExpr(*keys, *(f"m{i}" for i in range(D)), *(f"w[{k}] AS w{i}{j}" for k, (i, j) in enumerate(TRIANGLE)), f"{logdet} AS logdet")


def few(rows: DataFrame) -> bool:
    """Whether a table of estimates has few rows. Then it is broadcast, and vectors are not shuffled by a group's key, which a
    third of them may share; a larger one is left to Spark, which splits skewed joins."""
    return rows.limit(FEW + 1).count() <= FEW


def beside(members: DataFrame, state: DataFrame, small: bool, keys="key") -> DataFrame:
    return members.join(F.broadcast(state) if small else state, keys)


def nearest(members: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """Moments of the H share of each group's vectors that are nearest under each of its states."""
    distance = beside(members, state, small).withColumn("d", squared_distance())
    bins = distance.select("key", "start", F.least(F.floor(PER_OCTAVE * F.log2(1 + F.col("d") * 4)), F.lit(BINS)).alias("bin"), *(f"x{i}" for i in range(D)))
    bins = bins.groupBy("key", "start", "bin").agg(*moments())
    whole = W.partitionBy("key", "start")
    upto = whole.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = bins.select("*", F.sum("n").over(upto).alias("upto"), F.ceil(F.sum("n").over(whole) * H).alias("h"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("h") - F.col("upto") + F.col("n")) / F.col("n")))
    return placed.withColumn("share", share).groupBy("key", "start").agg(*(F.expr(f"sum({c} * share) AS {c}") for c in MOMENTS))


def concentrated(members: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """The states after concentration steps, until no determinant falls."""
    for _ in range(ROUNDS):
        before = state
        for _ in range(STEPS):
            state = estimate(nearest(members, state, small), SCALE, ["key", "start"])
        state = cut(state)
        fell = state.join(before.select("key", "start", F.col("logdet").alias("was")), ["key", "start"]).where(~(F.col("was") - F.col("logdet") <= STILL))
        if fell.isEmpty():
            break
    return state


def robust_estimates(members: DataFrame) -> DataFrame:
    """key, m0.., w00.. and size: the reweighted minimum-covariance-determinant estimate of each group; members: key, pick, x0.."""
    xs = [f"x{i}" for i in range(D)]
    middle = cut(members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *(F.percentile(x, F.lit(0.5)).alias(f"m{i}") for i, x in enumerate(xs))))
    small = few(middle)
    spread = beside(members, middle, small).groupBy("key").agg(*(F.percentile(F.abs(F.col(x) - F.col(f"m{i}")), F.lit(0.5)).alias(f"v{i}") for i, x in enumerate(xs)))
    deviation = [F.sqrt(F.pow(1.4826 * F.col(f"v{i}") / UNIT, 2) + FLOORS[i] ** 2) for i in range(D)]
    central = middle.join(spread, "key").select("key", F.lit(0).alias("start"), *((F.col(f"m{i}") / UNIT).alias(f"m{i}") for i in range(D)), *((1 / deviation[i] if i == j else F.lit(0.0)).alias(f"w{i}{j}") for i, j in TRIANGLE), F.lit(None).cast("double").alias("logdet"))
    some = beside(members, middle.select("key", F.greatest(F.floor(F.col("size") / (2 * D)), F.lit(2)).alias("every")), small)
    some = some.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(1, STARTS)]).cast("array<int>"))).where(F.pmod(F.xxhash64("pick", "start"), "every") == 0)
    hashed = estimate(some.groupBy("key", "start").agg(*moments()), 1.0, ["key", "start"])
    state = concentrated(members, cut(central.unionByName(hashed)), small)
    best = cut(state.groupBy("key").agg(F.min_by(F.struct(*(c for c in state.columns if c != "key")), F.struct("logdet", "start")).alias("b")).select("key", "b.*"))
    within = beside(members, best, small).where(squared_distance() <= chi2_quantile(0.975, D)).select("key", *xs)
    last = estimate(within.groupBy("key").agg(*moments()), 0.975 / chi2_cdf(chi2_quantile(0.975, D), D + 2), ["key"])
    return cut(last.join(middle.select("key", "size"), "key"))


SHOWN = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def stats_of(docs: DataFrame, held: list[Column]) -> DataFrame:
    """held and, by language and source ("=" before a name, as a null has none), the base statistics, their verdict and the vector."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) if c in docs.columns else F.lit("null")
    stats = add_stats(docs, [*held, F.col("doc_id").cast("long").alias("doc_id"), name("lang").alias("lang"), name("source").alias("source")])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    rest = [c for c in stats.columns if c not in STATS]
    return stats.select(*rest, *SHOWN[1:6], failed.alias("base_failed"), *vector())


def estimates(rows: DataFrame) -> tuple[DataFrame, bool]:
    """lang, source, m0.., w00.. for each language and source of rows, and whether these are few."""
    sound = rows.where(~F.col("base_failed"))
    sizes = sound.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    by_lang = sizes.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    pair, lang, every = F.concat_ws("\u0001", "lang", "source"), F.concat(F.lit("lang "), F.col("lang")), F.lit("all")
    level = F.when(F.col("n") >= LEAST, pair).when(F.col("n_lang") >= LEAST, lang).otherwise(every)
    groups = cut(sizes.join(by_lang, "lang").select("lang", "source", level.alias("key")))
    wanted, small = groups.select("key").distinct(), few(groups)
    # A vector counts for its own group, and for its language's and the whole where a small group needs these.
    parts = sound.select(F.explode(F.array(pair, lang, every)).alias("key"), F.xxhash64("doc_id", "n_words", "word_chars").alias("pick"), *(f"x{i}" for i in range(D)))
    members = cut(beside(parts, wanted, small))
    return cut(groups.join(robust_estimates(members).drop("logdet", "size"), "key").drop("key")), small


def judged(rows: DataFrame, known: DataFrame, small: bool) -> DataFrame:
    rows = rows.join(F.broadcast(known) if small else known, ["lang", "source"], "left")
    distance = squared_distance()
    kept = ~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= CUTOFF)
    return rows.withColumns({"kept": kept, "distance": distance})


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and distance (squared; null where nothing was estimated)."""
    rows = cut(stats_of(docs, []))
    return judged(rows, *estimates(rows)).select(*SHOWN)


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, that are not rejected. Each row is judged by its own text, so rows that share an id or
    have none are kept or rejected each by itself. The statistics are made a second time for the verdict, beside the row: that
    neither shuffles nor writes the texts."""
    found = estimates(cut(stats_of(docs, [])))
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    rows = stats_of(docs, [row])
    # An explode of one element: without it the optimiser would write the statistics out at each place that reads them.
    rows = rows.select("row", F.explode(F.array(F.struct(*(c for c in rows.columns if c != "row")))).alias("own")).select("row", "own.*")
    return judged(rows, *found).where("kept").select("row.*")
