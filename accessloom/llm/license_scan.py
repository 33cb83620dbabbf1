"""Licence scans by a positional rare-token index, in DataFrame functions alone.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. Base labels stand for short phrases whose
words follow one another. Beyond these, texts are held against templates (the wording of licence notices):

1. The licence words are the words of the templates that few templates share (of each key phrase one at least). Their document frequencies are counted
   over all documents; the other words of the templates rank after them.
2. Each document looks up its words of the highest inverse document frequency, as many as it takes: a template of n words
   stands where at least q of them do, so once all but q - AGREE of its places (of words that the document has) are
   looked up, AGREE places that were looked up agree. A template of which the document has too few words, or not all
   words of the key phrase, asks for none.
3. The postings of these words (template and place in it) are intersected by relative position, document place less template
   place: AGREE places at least must agree on one.
4. A template is verified where they agree: its mandatory key phrase must stand at its place, and the score is the share
   of the template's words that stand at theirs. Of MATCHED or more, the template's label is given.

So the rare words alone decide where a template is looked for, and no place is missed where it stands. All of this is
done within the document's row: only the frequencies are shuffled.

Contract: a null text counts as empty (no words, no places, empty labels, score 0). Every row gives a row, repeated rows and
null ids included; other columns are ignored; an empty table gives no rows; texts of any length are scanned whole.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Label, mandatory key phrase, wording.
TEMPLATES = [
    ("agpl-3.0", "affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation either version 3"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("bsd-3-clause", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "creative commons attribution 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "licensed under cc by sa 4 0"),
    ("gpl-2.0-or-later", "general public license as published by the free software foundation either version 2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or"),
    ("gpl-3.0", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-2.1", "lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("mit", "the mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
]
#: A word in more templates than this share is no licence word; looked-up places that must agree; least score of a label.
COMMON, AGREE, MATCHED = 0.35, 2, 0.7
#: Bits of a position in a vote.
BITS = 40


def template_index() -> tuple[list[dict], set[str], list[str]]:
    """Each template's parts, the licence words, and the other words of the templates, those of most templates last."""
    parts = []
    for label, key, text in TEMPLATES:
        words, phrase = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        least = next(n for n in range(len(words) + 1) if n / len(words) >= MATCHED)
        parts.append({"label": label, "words": words, "key": phrase, "key_at": at, "least": least})
    spread = Counter(w for p in parts for w in set(p["words"]))
    licence = {w for w, n in spread.items() if n <= COMMON * len(parts) and len(w) > 2}
    licence |= {min(p["key"], key=lambda w: (w not in licence, spread[w], w)) for p in parts}
    return parts, licence, sorted(set(spread) - licence, key=lambda w: (spread[w], w))


def spaced(text: Column) -> Column:
    """The words of text, each with a blank before and one after the last; one blank for none."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(lower, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")), F.lit(" "))


def blanks(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(" "), F.lit("")))


def any_of(phrases) -> str:
    return f" (?=(?:{'|'.join(sorted(phrases, key=lambda p: (-len(p), p)))}) )"


def texts(words) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def bound(value: Column, body) -> Column:
    """body(value), with value worked out once however often body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sought_words(own: Column, ranked: list[str], parts: list[dict]) -> Column:
    """The first of own (the document's words of templates, rarest first) that suffice for AGREE agreeing places."""
    rank = {w: i for i, w in enumerate(ranked)}

    def need(p: dict) -> Column:
        commonest_first = texts(sorted(p["words"], key=lambda w: -rank[w]))

        def last(held: Column) -> Column:
            possible = (F.size(held) >= p["least"]) & F.forall(texts(p["key"]), lambda w: F.array_contains(own, w))
            return F.when(possible, F.array_position(own, F.get(held, F.lit(p["least"] - AGREE))))

        return F.coalesce(bound(F.filter(commonest_first, lambda w: F.array_contains(own, w)), last), F.lit(0))

    needs = [need(p) for p in parts]
    return F.slice(own, 1, F.array_max(F.array(*needs)).cast("int"))


def agreed(words: Column, sought: Column, parts: list[dict], reach: int) -> Column:
    """Votes (template, then begin + reach in BITS bits) that AGREE places of sought words have in common."""
    postings: dict[str, list[int]] = {}
    for i, p in enumerate(parts):
        for k, w in enumerate(p["words"]):
            postings.setdefault(w, []).append((i << BITS) + reach - k)
    index = F.create_map(*[c for w, codes in sorted(postings.items()) for c in (F.lit(w), F.array(*[F.lit(x).cast("long") for x in codes]))])
    each = F.transform(words, lambda w, i: F.when(F.array_contains(sought, w), F.transform(F.element_at(index, w), lambda x: x + i)))
    votes = F.sort_array(F.flatten(F.filter(each, lambda x: x.isNotNull())))
    return bound(votes, lambda v: F.array_distinct(F.filter(v, lambda x, k: x == F.get(v, k - (AGREE - 1)))))


def verified(words: Column, votes: Column, parts: list[dict], reach: int) -> Column:
    """label, word (where the template begins) and score of the votes with their key phrase and MATCHED words in place."""
    wording = F.array(*[F.struct(F.lit(p["label"]).alias("label"), texts(p["words"]).alias("words"), texts(p["key"]).alias("key"), F.lit(p["key_at"]).alias("key_at")) for p in parts])

    def match(vote: Column) -> Column:
        begin = (vote.bitwiseAND(F.lit((1 << BITS) - 1)) - reach).cast("int")

        def held(p: Column) -> Column:
            key_from = begin + p["key_at"]
            stands = F.transform(p["words"], lambda w, i: F.when(F.get(words, begin + i) == w, 1).otherwise(0))
            share = F.aggregate(stands, F.lit(0), lambda a, x: a + x) / F.size(p["words"])
            key = (key_from >= 0) & (F.slice(words, F.greatest(key_from + 1, F.lit(1)), F.size(p["key"])) == p["key"])
            return F.when(key, F.struct(p["label"].alias("label"), begin.alias("word"), share.alias("score")))

        return bound(F.get(wording, F.shiftright(vote, BITS).cast("int")), held)

    return F.array_sort(F.filter(F.transform(votes, match), lambda m: m["score"] >= MATCHED))


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; and matches (label, word, score)."""
    parts, licence, others = template_index()
    begun = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spaced(text_of()).alias("spaced"))
    n_words = F.when(F.col("spaced") == "  ", F.lit(0)).otherwise(blanks(F.col("spaced")) - 1)
    #: Texts without any licence word or base phrase need no words of their own (each key phrase has a licence word).
    rare = F.col("spaced").rlike(" (?:" + "|".join(sorted(licence)) + ") ")
    cuts = F.split("spaced", any_of(BASE))
    begun = begun.select("doc_id", n_words.cast("long").alias("n_words"), F.when(rare | F.col("spaced").rlike(any_of(BASE)), F.col("spaced")).alias("spaced"), rare.alias("rare"))
    begun = begun.withColumn("cuts", F.when(F.col("spaced").isNotNull(), cuts))
    n_base = F.coalesce(F.size("cuts") - 1, F.lit(0))
    base_labels = F.array_compact(F.array(*[F.when(F.col("spaced").contains(f" {p} "), F.lit(x)) for p, x in BASE.items()]))
    base = begun.select(
        "doc_id",
        "n_words",
        n_base.cast("long").alias("n_base"),
        F.when(n_base > 0, blanks(F.element_at("cuts", 1)).cast("long")).alias("first_word"),
        F.when(n_base > 0, F.col("n_words") - blanks(F.element_at("cuts", -1)).cast("long")).alias("last_word"),
        F.when(F.col("spaced").isNull(), F.array().cast("array<string>")).otherwise(base_labels).alias("base_set"),
        F.when(F.col("rare"), F.col("spaced")).alias("spaced"),
    )
    base = cut(base)
    split = F.split(F.btrim("spaced"), " ")
    # Document frequencies of the licence words over all documents: as many rows as there are such words, whatever the input.
    own = base.where("spaced is not null").select(F.explode(F.array_intersect(split, texts(sorted(licence)))).alias("word"))
    df = {r["word"]: r["df"] for r in own.groupBy("word").agg(F.count(F.lit(1)).alias("df")).collect()}
    # The rarest come first: of the highest inverse document frequency.
    ranked = sorted(licence, key=lambda w: (df.get(w, 0), w)) + others
    reach = max(len(p["words"]) for p in parts)

    def found(words: Column) -> Column:
        at = lambda own: bound(sought_words(own, ranked, parts), lambda sought: F.when(F.size(sought) > 0, agreed(words, sought, parts, reach)))
        return verified(words, bound(F.array_intersect(texts(ranked), words), at), parts, reach)

    matches = F.when(F.col("spaced").isNotNull(), bound(split, found))
    joined = base.select("*", F.coalesce(matches, F.array().cast("array<struct<label string, word int, score double>>")).alias("matches"))
    labels = F.array_sort(F.array_distinct(F.concat("base_set", "matches.label")))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base_set")), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max("matches.score"), F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
        "matches",
    )


def oracle() -> str:
    """The same rows by comparing every place of every text, as SQL."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"('{label}', {quoted(p.split())})" for p, label in BASE.items())
    templates = ", ".join(f"('{p['label']}', {quoted(p['words'])}, {quoted(p['key'])}, {p['key_at']})" for p in template_index()[0])
    held = "contains(s, ' ' || array_to_string({0}, ' ') || ' ')"
    places = "unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len({0})] = {0}))"
    share = "list_sum(list_transform(range(len(words)), lambda j: CASE WHEN b + j >= 0 AND w[b + j + 1] = words[j + 1] THEN 1 ELSE 0 END)) / len(words)"
    return f"""
WITH t AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM (SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents)),
phrase(label, p) AS (VALUES {phrases}),
template(label, words, key, key_at) AS (VALUES {templates}),
hit AS (SELECT doc_id, label, {places.format("p")} AS i FROM t, phrase WHERE {held.format("p")}),
base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, list(DISTINCT label) AS labels FROM hit GROUP BY 1),
begun AS (SELECT doc_id, label, words, w, {places.format("key")} - key_at AS b FROM t, template WHERE {held.format("key")}),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS best FROM (SELECT doc_id, label, {share} AS share FROM begun) WHERE share >= {MATCHED} GROUP BY 1)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  greatest(coalesce(best, 0.0), CASE WHEN n > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
FROM t LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""
