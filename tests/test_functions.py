import base64
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from accessloom.functions import ids, records, sanitize, strings
from accessloom.functions.fold import fold

SECRET = b"0123456789abcdef0123456789abcdef!"


def one(spark, rows, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


def test_folding():
    assert fold("ΣΑΣ") == fold("σας") and fold("K") == fold("k") == fold("K") and fold("ſ") == fold("S")
    assert fold("İ") != fold("i") and fold("ı") != fold("I") and fold("ß") == fold("ẞ") and fold("ß") != fold("ss")


def test_sanitised_ids(spark):
    mac = lambda x: base64.b32encode(hmac.new(SECRET, x.encode(), hashlib.sha256).digest()[:12]).decode().rstrip("=")
    rows = [("",), (None,), ("ann",), ("é:x",), ("group:1:member",), ("a@b@c.org",)]
    got = one(spark, rows, "x string", sanitize.sanitize_id(F.col("x"), SECRET))
    assert [g[0] for g in got] == ["", None, *(mac(r[0]) for r in rows[2:])]
    assert one(spark, rows[4:5], "x string", sanitize.sanitize_composite(F.col("x"), SECRET, ["group"]))[0][0] == f"group:{mac('1')}:{mac('member')}"
    assert one(spark, rows[2:3], "x string", sanitize.sanitize_composite(F.col("x"), SECRET, ["ann"]))[0][0] == mac("ann")
    assert one(spark, rows[5:6], "x string", sanitize.sanitize_email(F.col("x"), SECRET))[0][0] == f"{mac('a@b')}@dom-{mac('c.org').lower()}.example"
    text = json.dumps({"a": "x", "b": [1, True, {"c": "y"}], "d": None})
    [out] = one(spark, [(text,)], "x string", sanitize.sanitize_json(F.col("x"), SECRET))
    assert json.loads(out[0]) == {"a": mac("x"), "b": [1, True, {"c": mac("y")}], "d": None}
    with pytest.raises(ValueError):
        sanitize.sanitize_id(F.col("x"), b"short")
    long = b"k" * 100
    assert one(spark, [("ann",)], "x string", sanitize.sanitize_id(F.col("x"), long))[0][0] == base64.b32encode(hmac.new(long, b"ann", hashlib.sha256).digest()[:12]).decode().rstrip("=")


def test_bids(spark):
    made = {"bid:r:group/5678/user/1234": ("r", None), "bid:e:team/5:member": ("e", "member"), "bid:g:org/9/team/5:member:team/5/user/1": ("g", "member"), "bid:r:a\\:b/c\\/d": ("r", None)}
    for text, (kind, slug) in made.items():
        got = ids.parse(text)
        assert (got["kind"], got["slug"]) == (kind, slug)
    assert ids.parse("bid:r:a\\:b/c\\/d")["resource"] == {"parent_type": None, "parent_id": None, "type": "a:b", "id": "c/d"}
    for bad in ("bid:r:a", "bid:x:a/b", "bid:r:a/b:c", "bid:e:a/b", "bid:r:a/", "bid:r:a\\q/b", "r:a/b", "", None, "bid:r:a/b/c"):
        assert ids.parse(bad) is None
    part = ids.part(F.col("t"), F.col("i"), F.col("pt"), F.col("pi"))
    got = one(spark, [("a:b", "c/d\\", None, None), ("u", "1", "g", "2"), ("", "1", None, None), ("u", "1", "g", None)], "t string, i string, pt string, pi string", ids.resource_bid(part))
    assert [g[0] for g in got] == ["bid:r:a\\:b/c\\/d\\\\", "bid:r:g/2/u/1", None, None]
    [row] = one(spark, [("bid:g:t/5:m:u/1",)], "x string", ids.parse_bid(F.col("x")))
    assert row[0].principal.id == "1" and row[0].resource.type == "t"


def test_strings(spark):
    items = [([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)]
    assert [r[0] for r in one(spark, items, "x array<string>", strings.oxford(F.col("x"), empty="none"))] == ["none", "a", "a and b", "a, b, and c"]
    assert one(spark, items[3:], "x array<string>", strings.oxford(F.col("x"), "or", inner="single", outer="square"))[0][0] == "['a', 'b', or 'c']"
    quotes = [("'a'",), ('"b',), ("`",), ("''",), ("''c''",)]
    assert [r[0] for r in one(spark, quotes, "x string", strings.trim_quotes(F.col("x")))] == ["a", '"b', "`", "", "'c'"]
    names = [("Ann Lee Poe",), ("Ann",), ("",)]
    assert [tuple(r[0]) for r in one(spark, names, "x string", strings.split_full_name(F.col("x")))] == [("Ann", "Lee Poe"), ("Ann", ""), ("", "")]
    assert one(spark, [("--a 1 --b --a '2'",)], "x string", strings.parse_flags(F.col("x")))[0][0] == {"a": "1,2", "b": "true"}


def test_annotations_and_arguments(spark):
    ddl = "x array<struct<type_url:string,value:string>>"
    rows = [([("a", "1"), ("b", "2")],), ([],)]
    new = F.struct(F.lit("b").alias("type_url"), F.lit("9").alias("value"))
    got = one(spark, rows, ddl, F.to_json(records.annotation_update(F.col("x"), new)), records.annotation_contains(F.col("x"), "b", "z"), records.annotation_pick(F.col("x"), "a")["value"])
    assert [json.loads(g[0])[-1]["value"] for g in got] == ["9", "9"] and [len(json.loads(g[0])) for g in got] == [2, 1]
    assert [g[1:] for g in got] == [(True, "1"), (False, None)]
    args = [('{"n": 5, "s": "x", "b": true, "l": [1]}',), ('{"n": "no"}',), ("broken",)]
    got = one(spark, args, "a string", records.argument(F.col("a"), "n", "bigint"), records.argument(F.col("a"), "s"), records.argument(F.col("a"), "b", "boolean"), records.ticket_field(F.col("a"), "q", "string", "d"))
    assert got == [(5, "x", True, "d"), (None, None, None, "d"), (None, None, None, "d")]
    assert [r[0] for r in one(spark, args, "a string", records.ticket_valid(F.col("a"), "n", "bigint", True, (5, 6)))] == [True, False, False]
    with pytest.raises(Exception, match="missing argument"):
        one(spark, args[2:], "a string", records.require(F.col("a"), "s"))


def test_rules_and_relations(spark):
    rows = [(5, "abc", ["x", "y"]), (50, "zzz", ["x", "x"]), (None, None, None)]
    rules = [records.Rule("n", least=1, most=9), records.Rule("s", required=True, pattern="^a", suffix="c"), records.Rule("l", unique=True, most=2)]
    relations = {"together": records.relation("together", ["n", "s"]), "one": records.relation("at_least_one", ["n", "l"]), "not both": records.relation("exclusive", ["n", "s"]), "needs": records.relation("dependent", ["n"], ["l"])}
    got = one(spark, rows, "n int, s string, l array<string>", records.problems(rules, relations))
    assert [g[0] for g in got] == [["not both"], ["n", "s", "l", "not both"], ["s", "one"]]


def test_insights(spark):
    ddl = "i struct<risk_score:struct<value:string,normalized_score:int,source_score:string>,issue:struct<value:string,severity:string>>"
    rows = [((("7", 70, "7/10"), None),), ((None, ("leak", "high")),), (None,)]
    got = one(spark, rows, ddl, records.normalized_score(F.col("i")), records.source_score(F.col("i")), records.severity(F.col("i")), records.insight_value(F.col("i")))
    assert got == [(70, "7/10", "", "7"), (0, "", "high", "leak"), (0, "", "", "")]
