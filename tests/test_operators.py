import datetime as dt

import pytest
from pyspark.sql import functions as F

from accessloom.operators import compact, diff, digests, external, ingest, invariants, lookups, scans, search, stats, syncs
from accessloom.plans import catalog
from accessloom.sources.star import conform
from tests.helpers import entitlements, grants

DAY = dt.datetime(2024, 1, 1)


def resources(spark, rows):
    """rows: (type, id, name[, address[, day]])."""
    out = []
    for row in rows:
        kind, rid, name, mail, day = (*row, None, None)[:5]
        out.append((kind, rid, name, ([(mail, True)], "human", name) if mail else None, None if day is None else DAY + dt.timedelta(days=day)))
    ddl = "resource_type_id string, resource_id string, display_name string, user_trait struct<emails:array<struct<address:string,is_primary:boolean>>,account_type:string,login:string>, discovered_at timestamp"
    return conform(spark.createDataFrame(out, ddl), "resources")


def types(spark, **traits):
    return conform(spark.createDataFrame([(k, v) for k, v in traits.items()], "external_id string, traits array<string>"), "resource_types")


def test_merge_ties_and_nulls(spark):
    a = resources(spark, [("u", "1", "a", None, 1), ("u", "2", "a", None, 1), ("u", "3", "a"), ("u", "4", "a")])
    b = resources(spark, [("u", "1", "b", None, 1), ("u", "2", "b", None, 2), ("u", "3", "b", None, 0), ("u", "4", "b"), ("u", "5", "b")])
    names = lambda df: {r.resource_id: r.display_name for r in df.collect()}
    assert names(compact.merge_pair(a, b, "resources")) == {"1": "a", "2": "b", "3": "a", "4": "a", "5": "b"}
    assert names(compact.merge_many([a, b], "resources")) == {"1": "b", "2": "b", "3": "b", "4": "b", "5": "b"}
    assert names(compact.fold(a, b, "resources")) == {"1": "a", "2": "b", "3": "b", "4": "a", "5": "b"}
    assert compact.strategy(100, 10, 0) == "fold" and compact.strategy(100, 11, 0) == "rebuild" and compact.strategy(0, 0, 0) == "rebuild"


def test_diff_and_its_application(spark):
    old = resources(spark, [("u", "1", "a"), ("u", "2", "b"), ("u", "3", "c", "m@x", 1)])
    new = resources(spark, [("u", "2", "B"), ("u", "3", "c", "m@x", 5), ("u", "4", "d")])
    got = {(r.resource_id, r.change, r.display_name) for r in diff.changes(old, new, "resources").collect()}
    assert got == {("1", "deleted", "a"), ("2", "modified", "B"), ("4", "created", "d")}
    back = diff.applied(old, diff.deletions(old, new, "resources"), diff.upserts(old, new, "resources"), "resources")
    assert diff.changes(back, new, "resources").isEmpty()
    assert diff.changes(old, old, "resources").isEmpty() and diff.changes(old.limit(0), old, "resources").count() == 3
    runs = conform(spark.createDataFrame([("base", True)], "sync_id string, supports_diff boolean"), "sync_runs")
    assert {(r.sync_id, r.linked_sync_id, r.parent_sync_id) for r in diff.linked_runs(runs, "up", "del").collect()} == {("up", "del", "base"), ("del", "up", "base")}


def test_retention_with_an_open_run(spark):
    runs = catalog.runs(spark)
    assert {r[0] for r in syncs.deletable(runs, current="r10", keep=2).collect()} == {"r01", "r02", "r04", "r05", "r06", "r03"}
    assert syncs.deletable(runs, keep=9).where("sync_id like 'r0%' and sync_id < 'r05'").isEmpty()
    assert syncs.resolve(runs) == "r11" and syncs.resolve(runs, current="r10") == "r10" and syncs.resolve(runs, "x", "y") == "x"
    with pytest.raises(ValueError):
        syncs.run_for_stats(runs, "r03", "full")
    with pytest.raises(LookupError):
        syncs.run_for_stats(runs, "nope")
    assert syncs.run_for_stats(runs) == "r11"


def test_digests_tell_sets_apart(spark):
    rows = [("g:1:m", "user", str(i)) for i in range(1500)]
    a, b = grants(spark, rows), grants(spark, rows[::-1])
    assert digests.roots(a).collect() == digests.roots(b).collect()
    assert digests.dirty(a, b).isEmpty()
    fewer = grants(spark, rows[1:])
    [found] = digests.dirty(a, fewer).collect()
    own = digests.with_hashes(a).where("principal_resource_id = '0'").select("principal_hash").collect()[0][0]
    assert found.bucket == own >> (digests.BITS - 2)
    nodes = digests.buckets(a)
    assert digests.node(nodes, "g:1:m").count() == 4
    with pytest.raises(IndexError):
        digests.node(nodes, "g:1:m", 4)
    ids = spark.createDataFrame([(n,) for n in (0, 512, 513, 1024, 1025, 1 << 40)], "n long").select(digests.width(F.col("n"))).collect()
    assert [r[0] for r in ids] == [0, 0, 1, 1, 2, 16]
    odd = grants(spark, [("g:1:m", "user", "x\0y"), ("g:1:m", "user\0x", "y")])
    assert odd.count() == digests.with_hashes(odd).select("principal_hash").distinct().count()


def test_exclusion_groups(spark):
    made = lambda e, groups: (e, e.split(":")[0], groups)
    rows = [made("a:1:m", [("x", 0, True)]), made("a:2:m", [("x", 1, True), ("y", 0, False)]), made("b:1:m", [("y", 0, False)])]
    rows += [made(f"a:{i}:k", [("z", i, False)]) for i in range(51)] + [made(f"a:{i}:l", [("w", i, False)]) for i in range(50)]
    df = conform(spark.createDataFrame(rows, "external_id string, resource_type_id string, exclusion_groups array<struct<id:string,`order`:int,is_default:boolean>>"), "entitlements")
    assert {(r.group_id, r.rule) for r in invariants.exclusion_violations(df).collect()} == {("x", "several_defaults"), ("y", "several_types"), ("z", "too_many")}


def test_filters_of_a_fresh_collection(spark):
    kinds = types(spark, user=["USER"], group=["GROUP"])
    ents = entitlements(spark, ["group:1:m", "app:1:m"]).unionByName(entitlements(spark, [":1:m"]))
    assert {r.external_id for r in ingest.fresh_entitlements(ents, kinds).collect()} == {"group:1:m", ":1:m"}
    assert ingest.fresh_entitlements(ents, kinds, "partial").count() == 3
    rule = lambda *t: (["group:9:m"], False, list(t))
    g = grants(spark, [("group:1:m", "user", "1"), ("app:1:m", "user", "1"), ("group:1:m", "bot", "1"), ("group:1:m", "group", "9", None, rule("bot", "user")), ("group:1:m", "group", "9", None, rule("bot")), ("group:1:m", "group", "8", None, rule())])
    out = {r.external_id: r for r in ingest.fresh_grants(g, kinds).collect()}
    assert sorted(out) == ["group:1:m:group:8", "group:1:m:group:9", "group:1:m:group:9#4", "group:1:m:user:1"]
    assert out["group:1:m:group:9"].expansion.resource_type_ids == ["user"] and out["group:1:m:group:9#4"].expansion is None
    assert out["group:1:m:group:8"].expansion.resource_type_ids == [] and not out["group:1:m:group:9#4"].needs_expansion
    good, bad = ingest.valid_records(resources(spark, [("u", "1", "a"), ("u", "", "b"), (None, "2", "c")]), ["resource_type_id", "resource_id"])
    assert good.count() == 1 and bad.collect()[0][0] == 2


def test_external_matching(spark):
    rs = resources(spark, [("user", "1", "ann", "ANN@x.org"), ("user", "2", "bob", "bob@x.org"), ("group", "3", "crew")]).withColumn("profile", F.when(F.col("resource_id") == "2", F.lit('{"team": "ΣΑΣ"}')).otherwise(F.lit('{"team": "red", "n": 5}')))
    found = external.candidates(rs, types(spark, user=["USER"], group=["GROUP"], app=["APP"]))
    base = grants(spark, [("app:1:m", "ext", "?")])
    asked = lambda kind, trait, key, value: base.withColumn("external_match", F.struct(F.lit(kind).alias("kind"), F.lit(trait).alias("trait"), F.lit(key).alias("key"), F.lit(value).alias("value")))
    ids = lambda df: sorted(r.external_id for r in df.collect())
    assert ids(external.match_all(asked("all", "USER", "", ""), found)) == ["app:1:m:user:1", "app:1:m:user:2"]
    assert ids(external.match_id(asked("id", "", "", "3"), found)) == ["app:1:m:group:3"]
    assert ids(external.match_key_value(asked("kv", "USER", "email", "ann@X.ORG"), found)) == ["app:1:m:user:1"]
    assert ids(external.match_key_value(asked("kv", "USER", "team", "σας"), found)) == ["app:1:m:user:2"]
    assert ids(external.match_key_value(asked("kv", "GROUP", "team", "RED"), found)) == ["app:1:m:group:3"]
    both = asked("id", "", "", "3").unionByName(base)
    done = external.finished(both, external.match_id(asked("id", "", "", "3"), found))
    assert ids(done) == ["app:1:m:ext:?", "app:1:m:group:3"]


def test_compare_principals(spark):
    a = resources(spark, [("u", "1", "ann", "a@x"), ("u", "2", "bob", "b@x"), ("g", "9", "bob"), ("u", "3", "cat", "c@x")])
    b = resources(spark, [("u", "1", "zed", "z@x"), ("v", "7", "other", "B@X"), ("h", "8", "cat"), ("v", "6", "extra", "e@x")])
    got = {(r.side, r.resource_type_id, r.resource_id) for r in lookups.compare_principals(a, b).collect()}
    assert got == {("missing", "g", "9"), ("missing", "u", "3"), ("extra", "h", "8"), ("extra", "v", "6")}


def test_search_skips_what_cannot_be_evaluated(spark):
    rs = resources(spark, [("user", "1", "Ann", "a@x"), ("user", "2", "Bob", "b@x"), ("app", "3", "Ann app")]).withColumn("profile", F.when(F.col("resource_id") == "1", F.lit('{"team": "red", "size": 3}')))
    ids = lambda e: sorted(r.resource_id for r in search.search_resources(rs, e).collect())
    assert ids("resource.profile['team'] == 'red'") == ["1"]
    assert ids("resource.profile.email.endsWith('x') && !(resource.display_name.startsWith('A'))") == ["2"]
    assert ids("resource.type in ['app', 'x'] || resource.id == \"2\"") == ["2", "3"]
    assert ids("resource.profile['size'] == ''") == ["1"]  # what is no text reads as empty
    from accessloom.functions.expressions import ExpressionError

    for bad in ("resource.nope == 1", "resource.id ==", "resource.id.call()", "1 + ", "a b"):
        with pytest.raises(ExpressionError):
            ids(bad)


def test_pages_and_requests(spark):
    df = grants(spark, [("g:1:m", "user", str(i)) for i in range(7)])
    first = scans.page(df, ["external_id"], 3).collect()
    assert len(first) == 4
    rest = scans.page(df, ["external_id"], 3, (first[2].external_id,)).collect()
    assert rest[0].external_id == first[3].external_id
    assert scans.page_size(0) == scans.page_size(99_999) == 10_000 and scans.page_size(5) == 5
    assert scans.where(df, resource_type_id="", principal_resource_id=None).count() == 7
    with pytest.raises(ValueError):
        scans.grants_for_entitlements(df, [str(i) for i in range(129)])
    with pytest.raises(ValueError):
        scans.grants_for_principal_type(df, "")


def test_missing_rows_and_dropped_edges(spark):
    g = grants(spark, [("g:1:m", "user", "1")])
    rs = resources(spark, [("user", "2", "x")])
    [row] = lookups.hydrate_grants(g, entitlements(spark, ["g:2:m"]), rs, types(spark, user=["USER"])).collect()
    assert row.entitlement_name == "MISSING ENTITLEMENT (g:1:m)" and row.principal_name == "MISSING RESOURCE (user:1)" and row.resource_type_name == "MISSING RESOURCE TYPE (g)"
    dropped = spark.createDataFrame([("missing", "a", str(i)) for i in range(9)], "reason string, src string, dst string")
    [got] = stats.dropped_edges(dropped, 2).collect()
    assert (got.n, got.examples) == (9, ["a -> 0", "a -> 1"])
