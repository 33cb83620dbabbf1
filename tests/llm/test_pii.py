import itertools
import re

from accessloom.llm import pii

KEY = b"0123456789abcdef-test"


def test_the_order_is_one_cycle():
    s = pii.Surrogates(KEY)
    for n in (1, 2, 7, 100, 1000):
        assert sorted(s.permuted("t", n, x) for x in range(n)) == list(range(n))
        assert all(s.permuted("t", n, s.permuted("t", n, x), back=True) == x for x in range(n))
        assert sorted(s.follower("t", n, x) for x in range(n)) == list(range(n))
        assert n == 1 or all(s.follower("t", n, x) != x for x in range(n))


def test_kinds_keep_their_format():
    r = pii.Replacer(KEY)
    cases = {
        "email": "anna.smith.07@mail8.example.com", "ip": "192.168.4.77", "card": "4111 1111 1111 1111", "ssn": "078-05-1120",
        "phone": "+1 (017) 555-7713", "iban": "DE89 3704 0044 0532 0130 00", "secret": "9233A8ECF7C5B09FE5949719B6B82BC439E9329B",
    }
    for kind, x in cases.items():
        text = f"Write to {x}, today"
        [(got, a, b, new)] = list(r.entities(text))
        assert (got, text[a:b]) == (kind, x) and new != x
        if kind != "ip":
            assert re.sub(r"\d", "9", re.sub("[A-Fa-f]", "a", new)) if kind == "secret" else [c.isdigit() for c in new] == [c.isdigit() for c in x]
            assert [not c.isalnum() for c in new] == [not c.isalnum() for c in x]
    assert r.ip("192.168.4.77").split(".")[0] in ("192", "10", "172")
    assert pii.luhn("".join(c for c in r.card(cases["card"]) if c.isdigit()))
    plain = r.iban(cases["iban"]).replace(" ", "")
    assert pii.iban_check(plain[:2], plain[4:]) == plain[2:4] and plain[:2] == "DE"
    assert r.secret(cases["secret"]).isupper()


def test_names_match_gender_and_script_and_refer_alike():
    r = pii.Replacer(KEY)
    out, n = r.text("Mrs. Mary Jones met Mr John Brown; Mrs Jones and г-жа Анна Иванова left. Plain Mary too, maryland stays")
    assert n == 5
    woman, man, again, other = re.search(r"Mrs\. (\w+ \w+) met Mr (\w+ \w+); Mrs (\w+) and г-жа (\w+ \w+) left\. Plain (?!Mary)\w+ too, maryland stays", out).groups()
    assert woman.split()[0].lower() in pii.NAMES["latin", "f"] and man.split()[0].lower() in pii.NAMES["latin", "m"]
    assert again == woman.split()[1] != "Jones" and woman.split()[0] != "Mary"
    given, family = other.split()
    assert given.lower() in pii.NAMES["cyrillic", "f"] and family.endswith("ва") and family != "Иванова"


def test_distinct_entities_stay_distinct_and_keys_matter():
    r = pii.Replacer(KEY)
    mails = ["".join(x) + ".5@a.example.com" for x in itertools.product("aeb", "bcd")]
    assert len({r.email(x) for x in mails}) == len(mails)
    assert r.email("A.B@X.example.com").lower() == r.email("a.b@x.example.com")
    assert r.phone("(017) 555-7713")[-4:] == r.phone("+1 017 555 7713")[-4:]
    assert pii.Replacer(b"another key, as long").email(mails[0]) != r.email(mails[0])


def test_rows_nulls_long_texts_and_clashing_columns(spark):
    long = "word " * 40_000 + "mail me at a.b@c.example.org now"
    rows = [(1, "call +1 (425) 555-9684", 3, "n"), (None, None, None, None), (2, "", 0, ""), (3, long, len(long), "x"), (3, long, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, kind string")
    out = pii.with_surrogates(docs, KEY, "n_entities")
    assert out.columns == [*docs.columns, "n_entities"]
    got = out.collect()
    assert len(got) == 5 and [r.n_entities for r in got] == [1, 0, 0, 1, 1]
    assert "a.b@c" not in got[3].text and got[3].text == got[4].text and got[4].n_chars == len(got[4].text)
    assert got[1].text is None and got[2].text == "" and got[1].n_chars is None
    assert pii.surrogate_collisions(docs, KEY).collect() == []
    assert pii.with_surrogates(docs.limit(0), KEY).collect() == []


def test_digits_of_all_scripts():
    r = pii.Replacer(KEY)
    out, n = r.text("1 and ٤١١١ ١١١١ ١١١١ ١١١١ end")
    assert n == 1 and re.fullmatch(r"1 and ٤[٠-٩]{3} [٠-٩]{4} [٠-٩]{4} [٠-٩]{4} end", out)
    assert pii.plain_digits(out) == r.text("1 and 4111 1111 1111 1111 end")[0]
    out, n = r.text("id ٠٧٨-٠٥-١١٢٠.")
    assert n == 1 and re.fullmatch(r"id [٠-٩]{3}-[٠-٩]{2}-[٠-٩]{4}\.", out) and "٠٧٨-٠٥-١١٢٠" not in out
    out, n = r.text("host १९२.१६८.४.७७ and 010.1.2.3")
    assert n == 2 and re.match(r"host [०-९]+(\.[०-९]+){3} and \d{3}\.\d\.\d\.\d$", out) and "010.1.2.3" not in out


def test_names_and_mails_of_all_scripts():
    r = pii.Replacer(KEY)
    for text, gone in (("δοκιμή@παράδειγμα.gr", "δοκιμή παράδειγμα"), ("Dr Παπαδόπουλος", "Παπαδόπουλος"), ("Mr 田中", "田中"), ("Mr Łukasz Šimůnek", "Łukasz Šimůnek"), ("г-н Ґжицький", "Ґжицький")):
        out, n = r.text(f"so {text} said")
        assert n == 1 and not any(x in out for x in gone.split()) and len(out) == len(text) + 8, out
    assert r.text("Herr Łukasz")[0][5].isupper()
    out = r.text("Mr. John Smith met Mr. John and John Smith; Johnson stays")[0]
    first, last, alone, again, family = re.fullmatch(r"Mr\. (\w+) (\w+) met Mr\. (\w+) and (\w+) (\w+); Johnson stays", out).groups()
    assert first == alone == again != "John" and last == family != "Smith"


def test_what_has_no_other_value_is_masked():
    r = pii.Replacer(KEY)
    r.family = lambda name: name
    assert r.text("Mr Smith left") == ("[name] left", 1)


def test_collisions_stop_the_job(spark, monkeypatch):
    import pytest

    docs = spark.createDataFrame([(1, "mail a.b@c.example.org or d.e@c.example.org", 7)], "doc_id long, text string, n_entities int")
    assert pii.checked_surrogates(docs, KEY, "n_entities").columns == ["doc_id", "text", "n_entities", "n_entities_"]
    bad = spark.createDataFrame([("email", "A", "x"), ("email", "b", "X"), ("ip", "c", "c"), ("ip", "d", "[ip]"), ("ip", "e", "[ip]")], "kind string, entity string, surrogate string")
    monkeypatch.setattr(pii, "entity_rows", lambda docs, key: bad)
    assert sorted((x.kind, x.n) for x in pii.surrogate_collisions(docs, KEY).collect()) == [("email", 2), ("ip", 1)]
    with pytest.raises(ValueError, match="email, ip"):
        pii.checked_surrogates(docs, KEY)
