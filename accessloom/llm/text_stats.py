"""Statistics of whole texts in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_of, words_of

SYMBOLS = "#*$%&|<>"
#: Words of the windows among which repeats are sought.
WINDOW = 5

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def without(text: Column, chars: str) -> Column:
    """Length of text without those characters."""
    return F.length(F.translate(text, chars, ""))


def add_stats(df: DataFrame, keep: list[Column]) -> DataFrame:
    """keep and, as long columns named by STATS, the words of text, their characters, symbols, lines equal to an earlier one,
    words in windows that the text holds more than once, lines with a word, capitals A-Z and exclamation marks."""
    df = df.select(*keep, text_of().alias("_t"))
    df = df.select("*", words_of(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("_l"))
    word = lambda i: F.get("_w", i)
    hashes = F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - (WINDOW - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *(word(i + k) for k in range(1, WINDOW))))
    df = df.select("*", hashes.alias("_h"))
    # Only texts in which a window comes twice are looked at closely.
    df = df.select("*", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    beside = lambda k: F.get("_s", k)["h"]
    twice = F.filter(
        F.transform("_s", lambda x, k: F.when((F.when(k > 0, beside(k - 1)) == x["h"]) | (beside(k + 1) == x["h"]), x["i"])),
        lambda p: p.isNotNull(),
    )
    df = df.select("*", F.sort_array(twice).alias("_p"))
    covered = F.aggregate(
        F.transform("_p", lambda p, k: F.least(F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    size = F.length("_t")
    kept = [c for c in df.columns if c not in ("_t", "_w", "_l", "_h", "_s", "_p")]
    found = {
        "n_words": F.size("_w"),
        "word_chars": without(F.col("_t"), SPACE),
        "n_symbols": size - without(F.col("_t"), SYMBOLS),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("_l"),
        "n_upper": size - without(F.col("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_marks": size - without(F.col("_t"), "!"),
    }
    return df.select(*kept, *(c.cast("long").alias(n) for n, c in found.items()))
