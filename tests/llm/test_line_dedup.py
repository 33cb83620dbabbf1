import random
import re
from collections import defaultdict

from accessloom.llm.line_dedup import CLAUSE, LEAST_RUN, repeated_units, without_units

LONG = "alpha beta gamma delta epsilon zeta"


def brute(rows, least):
    """(doc_id, unit, n_units, start, length, first_doc_id, first_unit), by comparing units as texts."""
    placed, firsts = [], {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        own = []
        for m in re.finditer(CLAUSE, text or ""):
            norm = " ".join(re.sub("[A-Z]", lambda x: x[0].lower(), m[0]).replace("\x0b", " ").split(None))
            if norm:
                own.append((len(own), m.start(), m.end(), norm, firsts.get(norm)))
                firsts.setdefault(norm, (doc, len(own) - 1))
        placed.append((doc, own))
    out = []
    for doc, own in placed:
        run = []
        for unit in [*own, (None, 0, 0, "", None)]:
            if unit[4]:
                run.append(unit)
                continue
            if sum(len(u[3]) + 1 for u in run) >= max(least, 1):
                main = max(run, key=lambda u: (len(u[3]), -u[0]))
                out.append((doc, run[0][0], len(run), run[0][1], run[-1][2] - run[0][1], *main[4]))
            run = []
    return sorted(out)


def shown(df):
    return sorted(tuple(r[c] for c in ("doc_id", "unit", "n_units", "start", "length", "first_doc_id", "first_unit")) for r in df.collect())


def test_equals_brute_force_on_random_texts(spark):
    r = random.Random(4)
    words = "of the in and to mountain river stone harbour lantern winter 雪 é".split()
    clause = lambda: " ".join(r.choices(words, k=r.randint(1, 6))) + r.choice([".", ", ", "\n", "! ", "。", ".\n\n"])
    shared = ["".join(clause() for _ in range(14)) for _ in range(6)]
    rows = [(i, "".join(r.choice(shared) if r.random() < 0.15 else clause() for _ in range(r.randint(0, 30)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for least in (1, 60, LEAST_RUN):
        assert shown(repeated_units(docs, least_run=least)) == brute(rows, least)


def test_passages_go_and_chance_repeats_stay(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 8)))
    sentence = lambda k: " ".join(word() for _ in range(k)).capitalize() + ". "
    prose = lambda: "".join(sentence(r.randint(4, 9)) for _ in range(25))
    passages = ["".join(sentence(7) for _ in range(9)) for _ in range(10)]
    rows = []
    for i in range(300):
        text = prose() + "All rights reserved.\n" + prose() + "Read more: here, now.\n"
        if i % 3 == 0:  # over 50 words in the middle of a line, begun and ended within a sentence
            place = text.index(" ", r.randint(0, len(text) - 100))
            text = text[:place] + " " + passages[i % 10].strip()[3:-3] + text[place:]
        rows.append((i, text))
    found = {x.doc_id for x in repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    later = {i for i in range(0, 300, 3) if i >= 30}
    assert found == later
    everything = {x.doc_id for x in repeated_units(spark.createDataFrame(rows, "doc_id long, text string"), least_run=1).collect()}
    assert everything == set(range(1, 300))


def test_removal_keeps_columns_of_clashing_names(spark):
    passage = f"{LONG}, {LONG} again. {LONG} once more; {LONG} and so on, {LONG} for ever, {LONG} in the end. "
    texts = {1: "Begun here. " + passage + "Done.", 2: "Another start. " + passage.upper().lower() + "Another end.", 3: None, 4: "", 5: "é. " * 90_000 + passage}
    docs = spark.createDataFrame([(i, t, "a", b"x", 5) for i, t in texts.items()], "doc_id long, text string, removed_spans string, cut_id binary, unit int")
    clean = {r.doc_id: r for r in without_units(docs).collect()}
    assert clean[1].text == texts[1] and clean[3].text is None and clean[4].text == ""
    assert clean[2].text == "Another start. Another end."
    assert clean[2].removed_spans == "a" and [(x.start, x.length) for x in clean[2].removed_spans_][0][0] in (14, 15)
    assert clean[5].text == "é. "


def test_paragraphs_ties_null_ids_and_empty_table(spark):
    par = "one two three\nfour five six"
    rows = [(None, par), (2, f"{par}\n\nother words which stand alone here\n\n{par}"), (2, par), (2, par), (None, par)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.first_doc_id) for r in repeated_units(docs, paragraphs=True, least_run=1).collect()]
    # The two equal rows of id 2 are one document, as are those without an id.
    assert sorted(got, key=str) in ([(2, 2), (2, 2), (None, 2)], [(2, 2), (None, 2)])
    assert len(got) == 3
    assert repeated_units(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert without_units(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_scripts_without_blanks(spark):
    text = "".join(chr(0x4E00 + (i * 37) % 5000) for i in range(240)) + "。"
    got = repeated_units(spark.createDataFrame([(1, text), (2, "x. " + text)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.unit, r.first_doc_id, r.first_unit) for r in got] == [(2, 1, 1, 0)]
