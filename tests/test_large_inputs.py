"""Plans whose memory, shuffles and passes over the input are to stay in proportion to it."""

from pyspark.sql import functions as F

from accessloom.operators import diff, expand, external, graph, lookups
from accessloom.plans import catalog
from accessloom.sources.star import conform

from .helpers import entitlements, grants, shown


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def nested(spark):
    """A rule from team:1 to team:2 among entitlements that no rule names."""
    gs = grants(spark, [("team:1:in", "user", "a"), ("team:2:in", "team", "1", None, (["team:1:in"], False, [])), ("team:9:in", "user", "z")])
    return gs, entitlements(spark, [f"team:{i}:in" for i in range(10)])


def test_rules_meet_only_the_entitlements_that_they_name(spark):
    gs, ents = nested(spark)
    found = graph.judged_rules(gs, ents)
    assert [(r.src, r.dst, r.verdict) for r in found.collect()] == [("team:1:in", "team:2:in", "ok")]
    assert sorted(r.external_id for r in graph.named(ents, graph.rules(gs)).collect()) == ["team:1:in", "team:2:in"]
    assert plan(found).count("Join LeftSemi") == 2
    gone = graph.invalid(graph.edges(gs, ents), ents.where("external_id <> 'team:1:in'"))
    assert [tuple(r) for r in gone.collect()] == [("team:1:in", "team:2:in", "unknown src")]


def test_expansion_deals_out_no_other_grants(spark):
    gs, ents = nested(spark)
    out = expand.expand(gs, ents).grants
    assert "Join" not in plan(out)
    assert {r[0] for r in shown(out)} == {"team:1:in:user:a", "team:2:in:team:1", "team:9:in:user:z", "team:2:in:user:a"}


def test_many_and_few_entitlements_give_the_same_rows(spark, monkeypatch):
    gs, ents = nested(spark)
    lone = gs.withColumn("entitlement_id", gs.entitlement_id.substr(1, 0)).limit(0).unionByName(gs)
    few = shown(expand.expand(lone, ents).grants)
    monkeypatch.setattr(expand, "FEW", 0)
    assert shown(expand.expand(lone, ents).grants) == few


def test_counts_of_principals_are_dealt_by_the_size_of_the_input(spark):
    gs, ents = nested(spark)
    gs = gs.union(gs)
    counts = lookups.access_counts(gs)
    assert {tuple(r) for r in counts.collect()} == {("team", "1", "user", 1), ("team", "2", "team", 1), ("team", "9", "user", 1)}
    assert "RepartitionByExpression" in plan(counts)
    types = spark.createDataFrame([("user", ["USER"])], "external_id string, traits array<string>")
    things = ents.select("resource_type_id", "resource_id").where("resource_id < '3'")
    users = lookups.user_counts(gs, things, types)
    assert {(r.resource_id, r.users) for r in users.collect()} == {("0", 0), ("1", 1), ("2", 0)}
    assert "RepartitionByExpression" in plan(users)


def test_a_difference_carries_no_column_that_is_not_asked_for(spark):
    gs, _ = nested(spark)
    later = gs.where("external_id <> 'team:9:in:user:z'").withColumn("immutable", gs.principal_resource_id == "a")
    found = diff.changes(gs, later, "grants")
    assert {(r.external_id, r.change, r.immutable) for r in found.collect()} == {("team:9:in:user:z", "deleted", False), ("team:1:in:user:a", "modified", True)}
    assert found.columns == [*gs.columns, "change"]
    joined = plan(found.select("external_id", "change")).split("Join FullOuter")[1]
    assert "discovered_at" not in joined.replace("LogicalRDD", "Relation").split("Relation")[0]
    assert "struct(" not in joined


def test_an_addition_reads_the_base_once(spark):
    gs, _ = nested(spark)
    base = gs.where("principal_resource_id <> 'z'")
    found = diff.additive(base, gs.where("resource_id = '9'").union(gs.where("resource_id <> '9'")), "grants", "d")
    assert {(r.external_id, r.sync_id) for r in found.collect()} == {("team:9:in:user:z", "d")}
    assert plan(found).count("Join") == 1


def test_principals_are_merged_with_grants_not_broadcast(spark):
    gs, _ = nested(spark)
    rs = conform(spark.createDataFrame([("user", "a", '{"email": "A@x"}')], "resource_type_id string, resource_id string, profile string"), "resources")
    found = external.candidates(rs, spark.createDataFrame([("user", ["USER"])], "external_id string, traits array<string>"))
    asked = gs.where("resource_id = '9'")
    match = lambda kind, key, value: asked.withColumn("external_match", F.struct(F.lit(kind).alias("kind"), F.lit("USER").alias("trait"), F.lit(key).alias("key"), F.lit(value).alias("value")))
    by_id, by_mail = external.match_id(match("id", "", "a"), found), external.match_key_value(match("kv", "email", "a@X"), found)
    for df in (by_id, by_mail):
        assert [r.external_id for r in df.collect()] == ["team:9:in:user:a"]
        assert "strategy=merge" in plan(df)


def test_bids_deal_grants_by_their_resource(spark):
    bids = catalog.grant_bids(spark, "/root/testdata/sf0.001")
    assert "strategy=merge" in plan(bids)
    assert bids.count() == catalog.new(spark, "/root/testdata/sf0.001").grants.count()
