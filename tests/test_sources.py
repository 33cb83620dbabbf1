import datetime as dt

import pytest
from pyspark.sql import functions as F

from accessloom.operators import digests
from accessloom.plans import jobs
from accessloom.schemas import schema
from accessloom.sources import connector, export, star
from accessloom.sources.store import Store
from accessloom.streaming import feed

DIR = "/root/testdata/sf0.001"


def small(spark):
    g = star.graph(spark, DIR)
    keep = "resource_type_id <> 'part'"
    return star.Graph(g.resource_types, g.resources.where(keep), g.entitlements.where(keep), g.grants.where(keep))


def run_row(spark, sync_id):
    return star.conform(spark.createDataFrame([(sync_id, "full", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))], "sync_id string, sync_type string, started_at timestamp, ended_at timestamp"), "sync_runs")


def test_collect_copy_and_convert(spark, tmp_path):
    store, g = Store(spark, str(tmp_path / "a")), small(spark)
    assert store.runs().isEmpty() and store.read("grants").schema == schema("grants")
    done = jobs.collect(store, g, run_row(spark, star.NEW))
    assert store.read("grants", star.NEW).count() == done.grants.count() > g.grants.count()
    jobs.collect(store, g, run_row(spark, star.NEW).limit(0))  # once more, as after a cut: the same rows
    assert store.read("grants").count() == done.grants.count() and store.runs().count() == 1
    jobs.targeted(store, star.Graph(*(getattr(g, t).withColumn("sync_id", F.lit("part-1")) for t in ("resource_types", "resources", "entitlements", "grants"))), star.NEW, run_row(spark, "part-1"))
    report = store.convert(str(tmp_path / "b"), star.NEW).collect()
    assert [(r.sync_id, r.reason) for r in report] == [("part-1", "not chosen")]
    other = Store(spark, str(tmp_path / "b"))
    assert digests.global_root(other.read("grants")).collect() == digests.global_root(done.grants).collect()
    assert jobs.checked(done).where("violations > 0").select("invariant").collect() == [("I5",)]


def test_compaction_job(spark):
    g = small(spark)
    older = star.Graph(g.resource_types, g.resources, g.entitlements, g.grants.where("principal_resource_id <> '1'"))
    out = jobs.compacted([older, g], "merged")
    whole = jobs.compacted([g], "merged")
    assert digests.global_root(out["grants"]).collect() == digests.global_root(whole["grants"]).collect()
    assert out["stats"].where("item = 'resource_types'").collect()[0].n == 6


def test_sanitised_snapshot_keeps_its_shape(spark):
    g = small(spark)
    out = jobs.sanitised(g, b"s" * 32, ["customer", "nation", "org", "part", "region", "supplier"], dt.datetime(2030, 1, 1))
    assert out.grants.join(out.entitlements.select(F.col("external_id").alias("entitlement_id")), "entitlement_id").count() == g.grants.count()
    assert out.resources.select("resource_type_id", "resource_id").distinct().count() == g.resources.count()
    assert out.resources.where("display_name = 'Organisation' or profile like '%Customer%'").isEmpty()
    assert str(out.grants.agg(F.max("discovered_at")).collect()[0][0]) == "2030-01-01 00:00:00"


class Pages:
    """A connector of three pages."""

    def list(self, kind, parent, token):
        n = int(token or 0)
        return [{"external_id": f"{parent}{n}{i}", "entitlement_id": "e"} for i in range(2)], str(n + 1) if n < 2 else ""


class Loop(Pages):
    def list(self, kind, parent, token):
        return [], "again"


class Feed:
    def events(self, cursor):
        n = int(cursor or 0)
        at = dt.datetime(2024, 1, 1)
        rows = [{"feed_id": "f", "event_id": str(i), "occurred_at": at + dt.timedelta(minutes=i), "event_type": "create_grant" if i % 3 else "create_revoke", "entitlement_id": "e", "principal_resource_type_id": "user", "principal_resource_id": str(i % 2)} for i in range(max(0, 2 * n - 1), 2 * n + 2)]
        return (rows, str(n + 1), n < 4) if n < 5 else ([], str(n), False)


def ship(spark):
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.environment["PYTHONPATH"] = root


def test_connector_source(spark):
    ship(spark)
    connector.register(spark)
    read = lambda c: spark.read.format("access_connector").option("connector", f"tests.test_sources:{c}").option("table", "grants").option("parents", "a,b").load()
    assert sorted(r.external_id for r in read("Pages").collect()) == sorted(f"{p}{n}{i}" for p in "ab" for n in range(3) for i in range(2))
    with pytest.raises(Exception, match="twice"):
        read("Loop").collect()
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert connector.retried(flaky, wait=0) == "ok"


def test_feed_stream_equals_the_batch(spark, tmp_path):
    ship(spark)
    connector.register(spark)
    events = spark.readStream.format("access_feed").option("feed", "tests.test_sources:Feed").load()
    query = feed.run(events, str(tmp_path / "state"), str(tmp_path / "check"), processingTime="0 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    versions = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "state").iterdir() if p.name.startswith("version"))
    got = spark.read.parquet(f"{tmp_path}/state/version={versions[-1]}")
    rows = [tuple(r.get(c) for c in schema("events").names) for n in range(5) for r in Feed().events(str(n))[0]]
    batch = feed.state(spark.createDataFrame(rows, schema("events")))
    assert sorted(got.collect()) == sorted(batch.collect()) and batch.count() == 2


def test_late_and_repeated_batches_change_nothing(spark):
    events = star.events(spark, DIR)
    whole = feed.state(events)
    first, late = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    step = feed.merged(feed.merged(feed.merged(feed.state(late.limit(0)), late), first), late)
    assert sorted(step.collect()) == sorted(whole.collect())


def test_sessions_and_outputs(spark, tmp_path):
    ddl = "sync_id string, key string, value binary"
    now = spark.createDataFrame([("s", "a/1", b"x"), ("s", "a/2", b"y"), ("t", "a/1", b"z")], ddl)
    now = feed.session_put(now, spark.createDataFrame([("s", "a/1", None), ("s", "b", b"n")], ddl))
    assert sorted(r.key for r in feed.session_get(now, "s").collect()) == ["a/2", "b"]
    assert [r.key for r in feed.session_get(now, "s", "a/").collect()] == ["a/2"]
    g = small(spark)
    rows = export.csv_rows(g.resource_types, g.resources, g.entitlements, g.grants)
    export.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert tuple(back.columns) == export.HEADERS and back.count() == rows.count()
    assert export.json_lines(g.resource_types).count() == 6
