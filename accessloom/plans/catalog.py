"""The queries over the access graph, each with SQL that another engine can run on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, records, sanitize, strings
from ..functions.fold import fold_key
from ..operators import compact, diff, digests, expand, external, graph, ingest, invariants, lookups, scans, search, stats, syncs
from ..sources import export, star
from ..sources.star import NEW, OLD
from ..streaming import feed
from .lineage import dealt, written
from .oracle import GRAPH

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SECRET = b"accessloom sanitiser secret, 32 bytes or more"


def query(sql: str | None, plain: bool = False):
    """Registers a query under its name; sql follows the projected graph's tables unless plain."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql if plain else GRAPH + sql
        return f

    return add


def new(spark, d):
    return star.graph(spark, d, NEW)


def old(spark, d):
    return star.graph(spark, d, OLD)


def expanded(spark, d):
    g = new(spark, d)
    return expand.expand(g.grants, g.entitlements).grants


PRINCIPAL = ["principal_resource_type_id", "principal_resource_id"]
RESOURCE = ["resource_type_id", "resource_id"]


# Scans.


@query("SELECT external_id, display_name, trait FROM resource_types")
def list_resource_types(spark, d):
    return scans.list_resource_types(new(spark, d).resource_types).select("external_id", "display_name", F.get("traits", F.lit(0)).alias("trait"))


@query("SELECT rt AS resource_type_id, rid AS resource_id, name AS display_name FROM resources WHERE rt = 'customer' AND prt = 'nation' AND prid = '3'")
def list_resources_by_parent(spark, d):
    return scans.list_resources(new(spark, d).resources, "customer", "nation", "3").select(*RESOURCE, "display_name")


@query("SELECT eid AS external_id, slug, name AS display_name FROM entitlements WHERE rt = 'part' AND rid = '7'")
def list_entitlements_by_resource(spark, d):
    return scans.list_entitlements(new(spark, d).entitlements, "part", "7").select("external_id", "slug", "display_name")


@query("SELECT rt || ':' || rid || ':viewer' AS external_id, rt AS resource_type_id, rid AS resource_id FROM resources WHERE rt = 'nation'")
def static_entitlements(spark, d):
    declared = spark.createDataFrame([("nation", "viewer")], "resource_type_id string, slug string")
    return scans.static_entitlements(declared, new(spark, d).resources).select("external_id", *RESOURCE)


@query("SELECT gid AS external_id FROM grants WHERE rt = 'part' AND eid = 'part:7:buyer' AND pt IN ('customer','supplier')")
def list_grants_generic(spark, d):
    return scans.list_grants(new(spark, d).grants, resource_type_id="part", entitlement_id="part:7:buyer", principal_types=("customer", "supplier")).select("external_id")


@query("SELECT gid AS external_id, pt AS principal_resource_type_id, pid AS principal_resource_id FROM grants WHERE eid = 'region:1:member' AND pt = 'supplier'")
def list_grants_by_entitlement(spark, d):
    return scans.list_grants(new(spark, d).grants, entitlement_id="region:1:member", principal_types=("supplier",)).select("external_id", *PRINCIPAL)


@query("SELECT gid AS external_id, eid AS entitlement_id FROM grants WHERE pt = 'customer' AND pid = '11'")
def list_grants_by_principal(spark, d):
    return scans.list_grants(new(spark, d).grants, principal_type_id="customer", principal_id="11").select("external_id", "entitlement_id")


@query("SELECT gid AS external_id, src AS source, shallow FROM grants WHERE src IS NOT NULL")
def grants_with_expansion(spark, d):
    own = scans.pending_expansion(new(spark, d).grants)
    return own.select("external_id", F.explode("expansion.entitlement_ids").alias("source"), "expansion.shallow")


@query("SELECT gid AS external_id FROM grants WHERE rt = 'region'")
def grants_for_entitlement_type(spark, d):
    return scans.grants_for_entitlement_type(new(spark, d).grants, "region").select("external_id")


@query("SELECT gid AS external_id FROM grants WHERE pt = 'nation'")
def grants_for_principal_type(spark, d):
    return scans.grants_for_principal_type(new(spark, d).grants, "nation").select("external_id")


BATCH = ["part:9:buyer", "part:2:supplier", "region:0:member", "part:9:buyer"]


@query("SELECT gid AS external_id, p.position FROM grants g JOIN (VALUES ('part:9:buyer', 0), ('part:2:supplier', 1), ('region:0:member', 2)) p(eid, position) ON g.eid = p.eid")
def grants_for_entitlement_batch(spark, d):
    return scans.grants_for_entitlements(new(spark, d).grants, BATCH).select("external_id", "position").orderBy("position", "external_id")


@query("SELECT DISTINCT pt AS principal_resource_type_id, pid AS principal_resource_id FROM grants WHERE eid = 'part:5:buyer'")
def principal_keys(spark, d):
    return scans.principal_keys(new(spark, d).grants, "part:5:buyer")


@query("SELECT eid AS external_id, name AS display_name FROM entitlements WHERE eid = 'nation:4:member'")
def get_entitlement(spark, d):
    return scans.get(new(spark, d).entitlements, external_id="nation:4:member").select("external_id", "display_name")


@query("SELECT eid AS external_id FROM entitlements WHERE rt = 'part' AND CAST(rid AS INTEGER) % 5 = 0 AND slug = 'buyer'")
def bulk_entitlements(spark, d):
    g = new(spark, d)
    asked = g.resources.where("resource_type_id = 'part' and cast(resource_id as int) % 5 = 0").select(F.concat_ws(":", "resource_type_id", "resource_id", F.lit("buyer")).alias("external_id"))
    return scans.get_many(g.entitlements, asked).select("external_id")


@query("SELECT gid AS external_id FROM grants WHERE (eid, gid) > ('part:1:buyer', 'part:1:buyer:customer:2') ORDER BY eid, gid LIMIT 51")
def page_keyset(spark, d):
    return scans.page(new(spark, d).grants, ["entitlement_id", "external_id"], 50, ("part:1:buyer", "part:1:buyer:customer:2")).select("external_id")


@query("SELECT CAST(gid AS VARCHAR) AS external_id FROM grants WHERE gid >= 'nation:2' ORDER BY gid LIMIT 26")
def page_by_row_id(spark, d):
    return scans.page(new(spark, d).grants, ["external_id"], 25, ("nation:2",), inclusive=True).select("external_id")


# Lookups and access.


@query("""SELECT g.gid AS external_id, coalesce(e.name, 'MISSING ENTITLEMENT (' || g.eid || ')') AS entitlement_name,
  coalesce(p.name, 'MISSING RESOURCE (' || g.pt || ':' || g.pid || ')') AS principal_name, r.name AS resource_name, t.display_name AS resource_type_name, u.display_name AS principal_type_name
FROM grants g LEFT JOIN entitlements e ON g.eid = e.eid AND NOT (e.rt = 'part' AND CAST(e.rid AS INTEGER) % 40 = 3)
LEFT JOIN resources p ON p.rt = g.pt AND p.rid = g.pid AND NOT (p.rt = 'customer' AND CAST(p.rid AS INTEGER) % 50 = 7)
LEFT JOIN resources r ON r.rt = g.rt AND r.rid = g.rid JOIN resource_types t ON t.external_id = g.rt JOIN resource_types u ON u.external_id = g.pt""")
def grants_hydrated(spark, d):
    g = new(spark, d)
    df = lookups.hydrate_grants(g.grants, some_entitlements(g), some_resources(g), g.resource_types)
    return df.select("external_id", "entitlement_name", "principal_name", "resource_name", "resource_type_name", "principal_type_name")


def some_resources(g):
    """Without some customers, so that references dangle."""
    return g.resources.where("not (resource_type_id = 'customer' and cast(resource_id as int) % 50 = 7)")


def some_entitlements(g):
    return g.entitlements.where("not (resource_type_id = 'part' and cast(resource_id as int) % 40 = 3)")


def some_parts(g):
    return g.resources.where("not (resource_type_id = 'part' and cast(resource_id as int) % 60 = 5)")


@query("SELECT r.rt AS resource_type_id, r.rid AS resource_id, t.display_name AS resource_type_name, p.name AS parent_name FROM resources r JOIN resource_types t ON r.rt = t.external_id LEFT JOIN resources p ON p.rt = r.prt AND p.rid = r.prid")
def resources_hydrated(spark, d):
    g = new(spark, d)
    return lookups.hydrate_resources(g.resources, g.resource_types).select(*RESOURCE, "resource_type_name", "parent_name")


@query("SELECT e.eid AS external_id, r.name AS resource_name, t.display_name AS resource_type_name FROM entitlements e JOIN resources r ON r.rt = e.rt AND r.rid = e.rid JOIN resource_types t ON t.external_id = e.rt")
def entitlements_hydrated(spark, d):
    g = new(spark, d)
    return lookups.hydrate_entitlements(g.entitlements, g.resources, g.resource_types).select("external_id", "resource_name", "resource_type_name")


@query("SELECT pt AS principal_resource_type_id, pid AS principal_resource_id, split_part(eid, ':', 1) AS resource_type_id, split_part(eid, ':', 2) AS resource_id, count(*) AS n, string_agg(eid, ',' ORDER BY eid) AS entitlements FROM expanded GROUP BY 1, 2, 3, 4")
def effective_access(spark, d):
    g = new(spark, d)
    return lookups.effective_access(expanded(spark, d), g.entitlements).select(*PRINCIPAL, *RESOURCE, F.size("entitlements").cast("long").alias("n"), F.array_join("entitlements", ",").alias("entitlements"))


@query("SELECT pt AS principal_resource_type_id, pid AS principal_resource_id, string_agg(eid, ',' ORDER BY eid) AS entitlements FROM grants WHERE rt = 'part' AND rid = '3' GROUP BY 1, 2")
def access_for_resource(spark, d):
    return lookups.access_for_resource(new(spark, d).grants, "part", "3").select(*PRINCIPAL, F.array_join("entitlements", ",").alias("entitlements"))


@query("SELECT rt AS resource_type_id, rid AS resource_id, pt AS principal_resource_type_id, count(DISTINCT pid) AS principals FROM grants GROUP BY 1, 2, 3")
def access_counts_by_type(spark, d):
    return lookups.access_counts(new(spark, d).grants)


@query("SELECT rt AS resource_type_id, rid AS resource_id FROM resources r WHERE EXISTS (SELECT 1 FROM grants g WHERE g.pt = r.rt AND g.pid = r.rid)")
def principals_distinct(spark, d):
    g = new(spark, d)
    return lookups.principals(g.grants, g.resources).select(*RESOURCE)


@query("SELECT rt AS resource_type_id, rid AS resource_id FROM resources r WHERE rt IN ('customer','supplier') AND EXISTS (SELECT 1 FROM grants g WHERE g.pt = r.rt AND g.pid = r.rid AND g.rt = 'region')")
def principals_user_only(spark, d):
    g = new(spark, d)
    return lookups.user_principals(scans.where(g.grants, resource_type_id="region"), g.resources, g.resource_types).select(*RESOURCE)


@query("SELECT r.rt AS resource_type_id, r.rid AS resource_id, count(DISTINCT CASE WHEN g.pt IN ('customer','supplier') THEN g.pt || ':' || g.pid END) AS users FROM resources r LEFT JOIN grants g ON g.rt = r.rt AND g.rid = r.rid GROUP BY 1, 2")
def resources_user_counts(spark, d):
    g = new(spark, d)
    return lookups.user_counts(g.grants, g.resources, g.resource_types).select(*RESOURCE, "users")


COMPARED = """, a AS (SELECT DISTINCT r.* FROM resources r JOIN grants g ON g.pt = r.rt AND g.pid = r.rid WHERE g.eid = 'part:1:buyer'),
b AS (SELECT DISTINCT r.* FROM resources r JOIN grants g ON g.pt = r.rt AND g.pid = r.rid WHERE g.eid = 'part:2:buyer'),
hit AS (SELECT a.rt, a.rid, b.rt AS crt, b.rid AS crid, row_number() OVER (PARTITION BY a.rt, a.rid ORDER BY b.rt, b.rid) AS k FROM a JOIN b ON (a.rt = b.rt AND a.rid = b.rid) OR a.email = b.email OR a.name = b.name)
"""


@query(COMPARED + "SELECT rt AS resource_type_id, rid AS resource_id, 'missing' AS side FROM a WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.rt = a.rt AND h.rid = a.rid) UNION ALL SELECT rt, rid, 'extra' FROM b WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.crt = b.rt AND h.crid = b.rid AND h.k = 1)")
def principals_compare(spark, d):
    g = new(spark, d)
    holders = lambda e: lookups.principals(scans.where(g.grants, entitlement_id=e), g.resources)
    return lookups.compare_principals(holders("part:1:buyer"), holders("part:2:buyer"))


@query("SELECT 'nation' AS child_type_id, rt AS parent_type_id, rid AS parent_id FROM resources WHERE rt = 'region' UNION ALL SELECT 'region', 'org', '0'")
def child_schedule(spark, d):
    return lookups.child_schedule(new(spark, d).resources)


@query("SELECT rt AS resource_type_id, rid AS resource_id FROM resources WHERE rt = 'customer' AND CAST(rid AS INTEGER) % 50 = 7")
def external_stale(spark, d):
    g = new(spark, d)
    return lookups.reconciled_external(g.resources, some_resources(g))[1].select(*RESOURCE)


# Statistics.


@query("""SELECT 'resources' AS item, t.external_id AS resource_type_id, count(r.rid) AS n FROM resource_types t LEFT JOIN resources r ON r.rt = t.external_id GROUP BY 2
UNION ALL SELECT 'resource_types', NULL, count(*) FROM resource_types UNION ALL SELECT 'entitlements', rt, count(*) FROM entitlements GROUP BY rt UNION ALL SELECT 'grants', rt, count(*) FROM grants GROUP BY rt""")
def sync_stats(spark, d):
    g = new(spark, d)
    return stats.sync_stats(g.resource_types, g.resources, g.entitlements, g.grants)


@query("SELECT rt AS resource_type_id, count(*) AS grants FROM grants GROUP BY 1")
def grant_stats(spark, d):
    return stats.grant_stats(new(spark, d).grants)


@query("SELECT event_type AS bucket, count(*) AS count, sum(event_id % 1000) AS total_ms, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_id % 100 = 0) AS timeouts, max(event_id % 1000) AS max_ms FROM events GROUP BY 1", plain=True)
def merged_timings(spark, d):
    df = star.read(spark, d, "events")
    parts = df.groupBy(F.col("event_type").alias("bucket"), (F.col("event_id") % 7).alias("run")).agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("event_id") % 1000).alias("total_ms"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_id") % 100 == 0).alias("timeouts"), F.max(F.col("event_id") % 1000).alias("max_ms"))
    return stats.merged_timings(parts)


FAN = """, edge AS (SELECT src, eid AS dst FROM grants WHERE src IS NOT NULL), fan AS (SELECT 'in' AS side, dst AS e, count(*) AS n FROM edge GROUP BY 2 UNION ALL SELECT 'out', src, count(*) FROM edge GROUP BY 2)
"""


@query(FAN + "SELECT side, max(n) AS most, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.9) AS p90, quantile_disc(n, 0.99) AS p99, count(*) FILTER (n >= 128) AS at_least_128, count(*) FILTER (n >= 256) AS at_least_256, count(*) FILTER (n >= 512) AS at_least_512, count(*) FILTER (n >= 1024) AS at_least_1024 FROM fan GROUP BY side")
def graph_fan(spark, d):
    g = new(spark, d)
    return stats.fan_distribution(graph.edges(g.grants, g.entitlements))


# Expansion.


@query("SELECT src, eid AS dst, bool_and(shallow) AS shallow, coalesce(max(only_type), '') AS types FROM grants WHERE src IS NOT NULL GROUP BY 1, 2")
def expansion_edges(spark, d):
    g = new(spark, d)
    return graph.edges(g.grants, g.entitlements).withColumn("types", F.array_join("types", ","))


@query("SELECT gid AS external_id, eid AS entitlement_id, pt AS principal_resource_type_id, pid AS principal_resource_id, immutable FROM expanded")
def expanded_grants(spark, d):
    return expanded(spark, d).select("external_id", "entitlement_id", *PRINCIPAL, "immutable")


@query("SELECT DISTINCT gid AS external_id, source, is_direct FROM sources")
def expanded_sources(spark, d):
    return expand.sources_table(expanded(spark, d))


@query(", s AS MATERIALIZED (SELECT e.gid, bool_or(s.source = e.eid) AS own FROM sources s JOIN (SELECT gid, min(eid) AS eid FROM expanded GROUP BY 1) e USING (gid) GROUP BY 1) SELECT e.gid AS external_id, CASE WHEN s.gid IS NULL THEN 'keep' WHEN own THEN 'clear' ELSE 'delete' END AS action FROM expanded e LEFT JOIN s USING (gid)")
def rollback_classification(spark, d):
    return expand.classify_rollback(expanded(spark, d)).select("external_id", "action")


@query("SELECT gid AS external_id, '' AS sources FROM grants")
def rollback_result(spark, d):
    return expand.rollback(expanded(spark, d)).select("external_id", expand.canonical_sources().alias("sources"))


@query("SELECT DISTINCT gid AS external_id FROM sources")
def rollback_verification(spark, d):
    g = new(spark, d)
    return expand.sources_changed(g.grants, expanded(spark, d)).select("external_id")


def narrower(edges):
    """As if nations divisible by five lost their filter, those by seven had one, and odd regions grew deep."""
    n = F.split("src", ":")[1].cast("int")
    nation = F.col("src").startswith("nation")
    return edges.withColumns({"types": F.when(nation & (n % 5 == 0), F.array().cast("array<string>")).when(nation & (n % 7 == 0), F.array(F.lit("customer"))).otherwise(F.col("types")), "shallow": F.lit(False)})


@query("""SELECT src, eid AS dst, CASE WHEN src LIKE 'region%' THEN CASE WHEN shallow THEN 'widened' ELSE 'unchanged' END
  WHEN k % 5 = 0 THEN CASE WHEN only_type IS NOT NULL THEN 'widened' ELSE 'unchanged' END WHEN k % 7 = 0 THEN CASE WHEN only_type IS NULL THEN 'narrowed' ELSE 'unchanged' END ELSE 'unchanged' END AS change
FROM (SELECT *, CAST(split_part(src, ':', 2) AS INTEGER) AS k FROM grants WHERE src IS NOT NULL)""")
def edge_spec_change(spark, d):
    g = new(spark, d)
    edges = graph.edges(g.grants, g.entitlements)
    return expand.edge_change(edges, narrower(edges))


@query("SELECT DISTINCT eid AS entitlement_id FROM grants WHERE NOT was")
def changed_entitlements(spark, d):
    return expand.changed_entitlements(old(spark, d).grants, new(spark, d).grants)


@query("SELECT gid AS external_id, immutable, 'incremental' AS mode FROM expanded")
def incremental_expansion(spark, d):
    g = new(spark, d)
    edges = graph.edges(g.grants, g.entitlements)
    before = g.grants.where("not (entitlement_id = 'nation:1:member' and cast(principal_resource_id as int) % 2 = 0)")
    done = written(expand.expand(before, g.entitlements).grants)
    late = g.grants.where("entitlement_id = 'nation:1:member' and cast(principal_resource_id as int) % 2 = 0")
    out = expand.expand_changes(done.unionByName(late), g.entitlements, edges, edges, ["nation:1:member"])
    return out.grants.select("external_id", "immutable", F.lit(out.mode).alias("mode"))


# Differences and merging.


@query("SELECT gid AS external_id, 'created' AS change FROM grants WHERE NOT was")
def diff_grants(spark, d):
    return diff.changes(old(spark, d).grants, new(spark, d).grants, "grants").select("external_id", "change")


def renamed(g):
    """Resources of a later collection: some gone, some under another name."""
    return some_resources(g).withColumn("display_name", F.when(F.col("resource_type_id") == "nation", F.lower("display_name")).otherwise(F.col("display_name")))


@query("SELECT rt AS resource_type_id, rid AS resource_id, 'modified' AS change, lower(name) AS display_name FROM resources WHERE rt = 'nation' UNION ALL SELECT rt, rid, 'deleted', name FROM resources WHERE rt = 'customer' AND CAST(rid AS INTEGER) % 50 = 7")
def diff_resources(spark, d):
    g = new(spark, d)
    return diff.changes(g.resources, renamed(g), "resources").select(*RESOURCE, "change", "display_name")


@query("SELECT rt AS resource_type_id, rid AS resource_id, lower(name) AS display_name FROM resources WHERE rt = 'nation'")
def diff_upserts(spark, d):
    g = new(spark, d)
    return diff.upserts(g.resources, renamed(g), "resources").select(*RESOURCE, "display_name")


@query("SELECT rt AS resource_type_id, rid AS resource_id FROM resources WHERE rt = 'customer' AND CAST(rid AS INTEGER) % 50 = 7")
def diff_deletions(spark, d):
    g = new(spark, d)
    return diff.deletions(g.resources, renamed(g), "resources").select(*RESOURCE)


@query("SELECT gid AS external_id, 'diff-1' AS sync_id FROM grants WHERE NOT was")
def diff_additive(spark, d):
    return diff.additive(old(spark, d).grants, new(spark, d).grants, "grants", "diff-1").select("external_id", "sync_id")


def versions(spark, d):
    """Three observations of the customers' names at different times, with ties and a null time."""
    c = star.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    at = lambda x: F.to_timestamp(F.lit(x))
    made = lambda df, n, t: star.conform(df.select(F.lit(f"s{n}").alias("sync_id"), F.lit("customer").alias("resource_type_id"), F.col("k").cast("string").alias("resource_id"), F.concat("name", F.lit(f" v{n}")).alias("display_name"), t.alias("discovered_at")), "resources")
    first = made(c, 1, F.when(F.col("k") % 5 != 0, at("2024-01-02")))
    second = made(c.where("k % 2 = 0"), 2, F.when(F.col("k") % 3 == 0, at("2024-01-02")).otherwise(at("2024-01-03")))
    third = made(c.where("k % 7 = 0"), 3, F.when(F.col("k") % 4 == 0, at("2024-01-03")))
    return first, second, third


OBSERVED = """WITH v AS (SELECT c_custkey AS k, c_name AS name, 1 AS s, CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2024-01-02' END AS seen FROM customer
UNION ALL SELECT c_custkey, c_name, 2, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2024-01-03' END FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, c_name, 3, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2024-01-03' END FROM customer WHERE c_custkey % 7 = 0)
"""


@query(OBSERVED + "SELECT CAST(a.k AS VARCHAR) AS resource_id, a.name || CASE WHEN b.seen > a.seen THEN ' v2' ELSE ' v1' END AS display_name FROM v a LEFT JOIN v b ON b.k = a.k AND b.s = 2 WHERE a.s = 1", plain=True)
def compact_pairwise(spark, d):
    first, second, _ = versions(spark, d)
    return compact.merge_pair(first, second, "resources").select("resource_id", "display_name")


def newest_sql(tie: str) -> str:
    return OBSERVED + f"SELECT CAST(k AS VARCHAR) AS resource_id, name || ' v' || s AS display_name FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seen DESC NULLS LAST, s {tie}) AS r FROM v) WHERE r = 1"


@query(newest_sql("DESC"), plain=True)
def compact_nway(spark, d):
    return compact.merge_many(list(versions(spark, d)), "resources").select("resource_id", "display_name")


@query(newest_sql("ASC").replace("FROM v)", "FROM v WHERE s < 3)"), plain=True)
def compact_fold(spark, d):
    first, second, _ = versions(spark, d)
    return compact.fold(first, second, "resources").select("resource_id", "display_name")


@query("SELECT gid AS external_id, 'again' AS sync_id, src AS source FROM grants WHERE rt IN ('region','org')")
def upsert_preserving(spark, d):
    g = new(spark, d)
    own = g.grants.where(F.col("resource_type_id").isin("region", "org"))
    again = own.withColumns({"sync_id": F.lit("again"), "expansion": F.lit(None).cast(own.schema["expansion"].dataType), "needs_expansion": F.lit(False)})
    return compact.upsert(own, again, "grants", preserve_expansion=True).select("external_id", "sync_id", F.get("expansion.entitlement_ids", F.lit(0)).alias("source"))


@query("SELECT gid AS external_id FROM grants WHERE rt = 'part' AND pt <> 'supplier'")
def delete_grants(spark, d):
    own = scans.where(new(spark, d).grants, resource_type_id="part")
    return compact.without(own, own.where("principal_resource_type_id = 'supplier'"), "grants").select("external_id")


# Runs.

RUNS = [
    ("r01", "full", None, 1, 2), ("r02", "full", None, 3, 4), ("r03", "partial", None, 5, 6), ("r04", "full", None, 7, 8), ("r05", "partial_upserts", "r06", 9, 10),
    ("r06", "partial_deletions", "r05", 9, 11), ("r07", "partial_upserts", "r08", 12, 13), ("r08", "partial_deletions", "r07", 12, 14), ("r09", "resources_only", None, 15, 16),
    ("r10", "full", None, 17, None), ("r11", "full", None, 18, 19),
]
RUNS_SQL = "WITH runs(sync_id, sync_type, linked, b, e) AS (VALUES " + ", ".join(str(tuple(r)).replace("None", "NULL") for r in RUNS) + ") "


def runs(spark):
    at = lambda n: None if n is None else f"2024-01-01 {n:02d}:00:00"
    df = spark.createDataFrame([(i, k, x, at(b), at(e)) for i, k, x, b, e in RUNS], "sync_id string, sync_type string, linked_sync_id string, started_at string, ended_at string")
    return star.conform(df.withColumn("supports_diff", F.lit(True)), "sync_runs")


@query(RUNS_SQL + "SELECT sync_id, CAST(row_number() OVER (ORDER BY e DESC, sync_id DESC) AS INTEGER) AS rank FROM runs WHERE e IS NOT NULL AND sync_type = 'full' QUALIFY rank <= 2", plain=True)
def latest_and_previous_sync(spark, d):
    return syncs.latest_and_previous(runs(spark)).select("sync_id", "rank")


@query("SELECT unnest(['r01','r02','r03','r05','r06']) AS sync_id", plain=True)
def retention_deletes(spark, d):
    return syncs.deletable(runs(spark), keep=2)


@query("SELECT 'r11' AS sync_id", plain=True)
def compactable_sync(spark, d):
    return syncs.compactable(runs(spark)).select("sync_id")


@query(RUNS_SQL + "SELECT 'm' AS sync_id, 'full' AS sync_type, CAST(max(e) AS INTEGER) AS hour FROM runs", plain=True)
def merged_run(spark, d):
    return syncs.merged_run(runs(spark), "m").select("sync_id", "sync_type", F.hour("ended_at").alias("hour"))


@query("SELECT 'r10' AS sync_id", plain=True)
def resumable_sync(spark, d):
    return syncs.resumable(runs(spark), F.to_timestamp(F.lit("2024-01-05"))).select("sync_id")


# Digests.

HASHES = """, hashed AS (SELECT eid, gid, was, CAST('0x' || substr(md5(eid || chr(0) || rt || chr(0) || rid || chr(0) || pt || chr(0) || pid || chr(0)), 1, 15) AS BIGINT) AS h, CAST('0x' || substr(md5(pt || chr(0) || pid), 1, 15) AS BIGINT) AS p FROM grants)
"""


@query(HASHES + "SELECT eid AS entitlement_id, count(*) AS n, bit_xor(h) AS digest FROM hashed GROUP BY 1")
def digest_roots(spark, d):
    return digests.roots(new(spark, d).grants)


@query(HASHES + "SELECT count(*) AS n, bit_xor(h) AS digest FROM hashed")
def digest_global(spark, d):
    return digests.global_root(new(spark, d).grants)


WIDTHS = HASHES + """, counted AS (SELECT eid, CAST(CASE WHEN n <= 512 THEN 0 ELSE least(16, ceil(log2(n / 512.0))) END AS INTEGER) AS width FROM (SELECT eid, count(*) AS n FROM hashed GROUP BY 1))
"""


@query(WIDTHS + "SELECT eid AS entitlement_id, width, p >> (60 - width) AS bucket, count(*) AS n, bit_xor(h) AS digest FROM hashed JOIN counted USING (eid) GROUP BY 1, 2, 3")
def digest_buckets(spark, d):
    return digests.buckets(new(spark, d).grants)


DIRTY = HASHES + """, a AS (SELECT eid, count(*) AS n FROM hashed WHERE was GROUP BY 1), b AS (SELECT eid, count(*) AS n FROM hashed GROUP BY 1),
w AS (SELECT b.eid, CAST(CASE WHEN least(a.n, b.n) <= 512 THEN 0 ELSE least(16, ceil(log2(least(a.n, b.n) / 512.0))) END AS INTEGER) AS width FROM a JOIN b USING (eid)),
x AS (SELECT eid, p >> (60 - width) AS bucket, count(*) AS n, bit_xor(h) AS g, count(*) FILTER (was) AS m, bit_xor(h) FILTER (was) AS f FROM hashed JOIN w USING (eid) GROUP BY 1, 2)
"""


@query(DIRTY + "SELECT eid AS entitlement_id, bucket FROM x WHERE n <> m OR g IS DISTINCT FROM f UNION ALL SELECT eid, NULL FROM b WHERE eid NOT IN (SELECT eid FROM a)")
def digest_dirty(spark, d):
    return digests.dirty(old(spark, d).grants, new(spark, d).grants)


@query(HASHES + "SELECT eid AS entitlement_id, count(*) AS n, bit_xor(h) AS digest FROM hashed GROUP BY 1")
def digest_repaired(spark, d):
    g = new(spark, d)
    stored = digests.roots(g.grants.where("resource_type_id <> 'org'")).withColumn("digest", F.when(F.col("entitlement_id").startswith("region"), F.lit(0)).otherwise(F.col("digest")))
    wrong = stored.where(F.col("entitlement_id").startswith("region")).select("entitlement_id")
    return digests.repaired(stored, g.grants, wrong)


# Invariants and ingestion.


@query("SELECT 'customer' AS resource_type_id, pid AS resource_id, count(*) AS grants FROM grants WHERE pt = 'customer' AND CAST(pid AS INTEGER) % 50 = 7 GROUP BY 2")
def dangling_grants_principal(spark, d):
    g = new(spark, d)
    return invariants.dangling_grant_principals(g.grants, some_resources(g))


@query("SELECT eid AS entitlement_id, count(*) AS grants FROM grants WHERE rt = 'part' AND CAST(rid AS INTEGER) % 40 = 3 GROUP BY 1")
def dangling_grants_entitlement(spark, d):
    g = new(spark, d)
    return invariants.dangling_grant_entitlements(g.grants, some_entitlements(g))


@query("SELECT rt AS resource_type_id, rid AS resource_id, count(*) AS entitlements FROM entitlements WHERE rt = 'part' AND CAST(rid AS INTEGER) % 60 = 5 GROUP BY 1, 2")
def dangling_entitlements(spark, d):
    g = new(spark, d)
    return invariants.dangling_entitlements(g.entitlements, some_parts(g))


@query("SELECT rt AS resource_type_id, rid AS resource_id, count(*) AS grants, false AS inserts FROM grants WHERE rt = 'part' AND CAST(rid AS INTEGER) % 60 = 5 GROUP BY 1, 2")
def dangling_grants_resource(spark, d):
    g = new(spark, d)
    return invariants.dangling_grant_resources(g.grants, some_parts(g))


@query(""", m AS (SELECT grp, count(DISTINCT rt) AS types, count(*) FILTER (is_default) AS defaults, count(*) AS members FROM entitlements WHERE grp IS NOT NULL GROUP BY 1)
SELECT grp AS group_id, 'several_types' AS rule FROM m WHERE types > 1 UNION ALL SELECT grp, 'several_defaults' FROM m WHERE defaults > 1 UNION ALL SELECT grp, 'too_many' FROM m WHERE members > 50""")
def exclusion_group_violations(spark, d):
    return invariants.exclusion_violations(new(spark, d).entitlements)


@query("SELECT pt AS resource_type_id, CASE WHEN pt = 'customer' THEN 'row missing' ELSE 'type never collected' END AS cause, count(DISTINCT pid) AS n FROM grants WHERE (pt = 'customer' AND CAST(pid AS INTEGER) % 50 = 7) OR pt = 'supplier' GROUP BY 1, 2")
def dangling_attribution(spark, d):
    g = new(spark, d)
    found = invariants.dangling_grant_principals(g.grants, some_resources(g).where("resource_type_id <> 'supplier'"))
    return invariants.attributed(found, g.resource_types.where("external_id <> 'supplier'")).drop("examples")


@query("SELECT unnest(['I3','I5','I7','I8','I9']) AS invariant, unnest([0, (SELECT sum(k) FROM (SELECT (count(DISTINCT rt) > 1)::INT + (count(*) FILTER (is_default) > 1)::INT + (count(*) > 50)::INT AS k FROM entitlements WHERE grp IS NOT NULL GROUP BY grp)), 0, 0, 0])::BIGINT AS violations")
def invariant_verdicts(spark, d):
    return invariants.verdicts(new(spark, d))


def scheduled(g):
    return g.resource_types.where("external_id <> 'supplier'")


@query("SELECT gid AS external_id, CASE WHEN pt = 'supplier' THEN 'principal_type' ELSE 'ok' END AS verdict FROM grants")
def ingest_filtered_grants(spark, d):
    g = new(spark, d)
    return ingest.judged_grants(g.grants, scheduled(g)).select("external_id", "verdict")


@query("SELECT count(*) AS grants, 0::BIGINT AS dropped_entitlement_type, count(*) FILTER (pt = 'supplier') AS dropped_principal_type, 2 AS flags FROM grants")
def quality_counters(spark, d):
    g = new(spark, d)
    return ingest.quality_counters(g.grants, g.entitlements, scheduled(g))


@query("SELECT eid AS external_id FROM entitlements WHERE rt <> 'part'")
def ingest_entitlements(spark, d):
    g = new(spark, d)
    return ingest.fresh_entitlements(g.entitlements, g.resource_types.where("external_id <> 'part'")).select("external_id")


@query("SELECT gid AS external_id, src IS NOT NULL AND only_type IS NULL AS still FROM grants WHERE rt IN ('region','org') AND pt <> 'customer'")
def ingest_expansions(spark, d):
    g = new(spark, d)
    own = g.grants.where(F.col("resource_type_id").isin("region", "org"))
    return ingest.narrowed_expansions(own, g.resource_types.where("external_id <> 'customer'")).select("external_id", F.col("expansion").isNotNull().alias("still"))


# Matching with another directory.


def placeholders(g, kind):
    """Grants on parts by suppliers, whose principal another directory is to tell."""
    own = g.grants.where("resource_type_id = 'part' and principal_resource_type_id = 'supplier'")
    match = {
        "all": F.struct(F.lit("all").alias("kind"), F.lit("GROUP").alias("trait"), F.lit("").alias("key"), F.lit("").alias("value")),
        "id": F.struct(F.lit("id").alias("kind"), F.lit("USER").alias("trait"), F.lit("").alias("key"), F.col("principal_resource_id").alias("value")),
        "kv": F.struct(F.lit("kv").alias("kind"), F.lit("USER").alias("trait"), F.lit("email").alias("key"), F.concat(F.lit("CUSTOMER."), F.lpad("principal_resource_id", 9, "0"), F.lit("@Example.COM")).alias("value")),
    }[kind]
    return own.withColumn("external_match", match)


@query("SELECT DISTINCT g.eid || ':' || r.rt || ':' || r.rid AS external_id, r.rt AS principal_resource_type_id FROM grants g, resources r WHERE g.rt = 'part' AND g.pt = 'supplier' AND g.rid = '4' AND r.rt IN ('nation','org','region')")
def external_match_all(spark, d):
    g = new(spark, d)
    return external.match_all(placeholders(g, "all").where("resource_id = '4'"), external.candidates(g.resources, g.resource_types)).select("external_id", "principal_resource_type_id")


@query("SELECT DISTINCT g.eid || ':' || r.rt || ':' || r.rid AS external_id FROM grants g JOIN resources r ON r.rid = g.pid WHERE g.rt = 'part' AND g.pt = 'supplier' AND r.rt = 'customer'")
def external_match_id(spark, d):
    g = new(spark, d)
    return external.match_id(placeholders(g, "id"), external.candidates(g.resources.where("resource_type_id = 'customer'"), g.resource_types)).select("external_id")


@query("SELECT DISTINCT g.eid || ':' || r.rt || ':' || r.rid AS external_id FROM grants g JOIN resources r ON lower('CUSTOMER.' || lpad(g.pid, 9, '0') || '@Example.COM') = lower(r.email) WHERE g.rt = 'part' AND g.pt = 'supplier'")
def external_match_kv(spark, d):
    g = new(spark, d)
    return external.match_key_value(placeholders(g, "kv"), external.candidates(g.resources, g.resource_types)).select("external_id")


@query("SELECT gid AS external_id FROM grants WHERE rt = 'nation' UNION ALL SELECT DISTINCT g.eid || ':' || r.rt || ':' || r.rid FROM grants g JOIN resources r ON r.rid = g.pid WHERE g.rt = 'part' AND g.pt = 'supplier' AND r.rt = 'customer'")
def external_finished(spark, d):
    g = new(spark, d)
    own = placeholders(g, "id")
    found = external.match_id(own, external.candidates(g.resources.where("resource_type_id = 'customer'"), g.resource_types))
    return external.finished(scans.where(g.grants, resource_type_id="nation").unionByName(own), found).select("external_id")


# Export, search, paging.


@query("""SELECT 'Identity' AS row_type, coalesce(last_name, '') AS last_name, CASE WHEN rt = 'customer' THEN 'Customer' ELSE '' END AS first_name, user_id, CASE WHEN status IS NULL THEN 'Enabled' ELSE upper(substr(status, 1, 1)) || lower(substr(status, 2)) END AS user_status, email AS email_address, '' AS entitlement_display_name, '' AS entitlement, '' AS resource_type, '' AS resource_name, '' AS entitlement_description, '' AS entitlement_slug FROM resources WHERE rt IN ('customer','supplier')
UNION ALL SELECT 'Entitlement', '', '', '', '', '', e.name, e.eid, e.rt, r.name, '', e.slug FROM entitlements e JOIN resources r ON r.rt = e.rt AND r.rid = e.rid
UNION ALL SELECT 'Grant', coalesce(p.last_name, ''), CASE WHEN p.rt = 'customer' THEN 'Customer' ELSE '' END, p.user_id, '', p.email, e.name, e.eid, e.rt, r.name, '', e.slug FROM grants g JOIN resources p ON p.rt = g.pt AND p.rid = g.pid AND p.email IS NOT NULL JOIN entitlements e ON e.eid = g.eid JOIN resources r ON r.rt = e.rt AND r.rid = e.rid""")
def export_csv_rows(spark, d):
    g = new(spark, d)
    return export.csv_rows(g.resource_types, g.resources, g.entitlements, g.grants)


@query("SELECT rt AS resource_type_id, rid AS resource_id FROM resources WHERE rt = 'customer' AND segment = 'BUILDING' AND name LIKE '%1%'")
def search_resources(spark, d):
    found = search.search_resources(new(spark, d).resources, "resource.type == 'customer' && resource.profile['segment'] == \"BUILDING\" && resource.display_name.contains('1')")
    return found.select(*RESOURCE)


@query("SELECT g.pt AS principal_resource_type_id, g.pid AS principal_resource_id, string_agg(g.eid, ',' ORDER BY g.eid) AS entitlements FROM grants g JOIN resources p ON p.rt = g.pt AND p.rid = g.pid WHERE g.rt = 'part' AND g.rid = '3' AND (p.segment = 'MACHINERY' OR g.slug = 'supplier') GROUP BY 1, 2")
def search_grants(spark, d):
    g = new(spark, d)
    found = search.search_grants(g.grants, g.entitlements, g.resources, "entitlement.slug == 'supplier' || principal.profile['segment'] == 'MACHINERY'", "part", "3")
    return found.select(*PRINCIPAL, F.array_join("entitlements", ",").alias("entitlements"))


@query("SELECT rt AS resource_type_id, rid AS resource_id, string_agg(eid, ',' ORDER BY eid) AS entitlements FROM grants WHERE pt = 'supplier' AND pid = '2' AND slug <> 'member' GROUP BY 1, 2")
def search_principal_grants(spark, d):
    g = new(spark, d)
    found = search.search_principal_grants(g.grants, g.entitlements, g.resources, "!(entitlement.slug in ['member'])", "supplier", "2")
    return found.select(*RESOURCE, F.array_join("entitlements", ",").alias("entitlements"))


@query("SELECT rid AS resource_id, user_id, email FROM resources WHERE rt = 'customer'")
def profile_fields(spark, d):
    own = scans.where(new(spark, d).resources, resource_type_id="customer")
    f = records.profile_fields(F.col("profile"), F.col("user_trait"))
    return own.select("resource_id", f["user_id"].alias("user_id"), f["email"].alias("email"))


# Scalars.


@query("SELECT gid, 'bid:g:' || CASE WHEN r.prt IS NOT NULL THEN r.prt || '/' || r.prid || '/' ELSE '' END || g.rt || '/' || g.rid || ':' || g.slug || ':' || g.pt || '/' || g.pid AS bid FROM grants g JOIN resources r ON r.rt = g.rt AND r.rid = g.rid")
def grant_bids(spark, d):
    g = new(spark, d)
    parents = g.resources.select(*RESOURCE, F.col("parent.resource_type_id").alias("pt"), F.col("parent.resource_id").alias("pr"))
    own = dealt(g.grants, *RESOURCE).join(parents.hint("merge"), RESOURCE)
    resource = ids.part(F.col("resource_type_id"), F.col("resource_id"), F.col("pt"), F.col("pr"))
    return own.select(F.col("external_id").alias("gid"), ids.grant_bid(resource, F.element_at(F.split("entitlement_id", ":"), -1), ids.part(*map(F.col, PRINCIPAL))).alias("bid"))


@query("SELECT eid AS external_id, 1 AS flag, slug AS tail FROM entitlements")
def structural_ids(spark, d):
    own = new(spark, d).entitlements
    s = ids.structural_identity(F.col("external_id"), F.col("resource_type_id"), F.col("resource_id"))
    return own.select("external_id", s["flag"].alias("flag"), s["tail"].alias("tail"))


HEX = "substr(h, {a}, 5)"
_KEY = SECRET.ljust(64, b"\0")
_BLOB = lambda b: "unhex('" + bytes(x ^ b for x in _KEY).hex() + "')"


def hmac_sql(value: str) -> str:
    """HMAC-SHA256 of a text, its first 96 bits in base 32."""
    inner = f"unhex(sha256({_BLOB(0x36)} || encode({value})))"
    whole = f"(substr(sha256({_BLOB(0x5C)} || {inner}), 1, 24) || '0')"
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr({w}, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT, 1)".format(w=whole)
    return f"array_to_string(list_transform(range(20), lambda i: {digit}), '')"


@query("SELECT rid AS resource_id, " + hmac_sql("rid") + " AS masked, " + hmac_sql("replace(email, '@example.com', '')") + " || '@dom-' || lower(" + hmac_sql("'example.com'") + ") || '.example' AS mail FROM resources WHERE rt = 'supplier'")
def sanitized_ids(spark, d):
    own = scans.where(new(spark, d).resources, resource_type_id="supplier")
    return own.select("resource_id", sanitize.sanitize_id(F.col("resource_id"), SECRET).alias("masked"), sanitize.sanitize_email(F.get("user_trait.emails", F.lit(0))["address"], SECRET).alias("mail"))


@query("SELECT gid AS external_id, 'nation:' || " + hmac_sql("rid") + " || ':' || " + hmac_sql("slug") + " || ':' || pt || ':' || " + hmac_sql("pid") + " AS masked FROM grants WHERE rt = 'nation' AND pt = 'supplier'")
def sanitized_composite_ids(spark, d):
    own = scans.list_grants(new(spark, d).grants, resource_type_id="nation", principal_type_id="supplier")
    return own.select("external_id", sanitize.sanitize_composite(F.col("external_id"), SECRET, ["nation", "supplier"]).alias("masked"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, CAST(epoch_ms(l_shipdate) - (SELECT epoch_ms(max(l_shipdate)) FROM lineitem) AS BIGINT) AS before_anchor FROM lineitem", plain=True)
def shifted_times(spark, d):
    df = star.read(spark, d, "lineitem").withColumn("at", F.col("l_shipdate").cast("timestamp"))
    latest = F.lit(df.agg(F.max("at")).collect()[0][0])
    anchor = F.timestamp_micros(F.lit(0))
    return df.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.unix_millis(sanitize.shift(F.col("at"), anchor, latest)).alias("before_anchor"))


@query("SELECT c_custkey AS k, lower(c_name) = lower(upper(c_name)) AS same, c_mktsegment || ', ' || 'x' || ', and ' || c_name AS listed, c_name AS trimmed FROM customer", plain=True)
def string_helpers(spark, d):
    c = star.read(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("k"), (fold_key(F.col("c_name")) == fold_key(F.upper("c_name"))).alias("same"), strings.oxford(F.array("c_mktsegment", F.lit("x"), "c_name")).alias("listed"), strings.trim_quotes(F.concat(F.lit("'"), "c_name", F.lit("'"))).alias("trimmed"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 50 THEN '' ELSE 'k' END AS problems FROM events", plain=True)
def json_arguments(spark, d):
    df = star.read(spark, d, "events").withColumn("k", records.argument(F.col("props"), "k", "bigint"))
    return df.select("event_id", "k", F.array_join(records.problems([records.Rule("k", required=True, least=10, most=50)]), ",").alias("problems"))


@query("SELECT eid AS src, '' AS dst, 'unknown src' AS problem FROM entitlements WHERE false UNION ALL SELECT src, eid, 'unknown src' FROM grants WHERE src LIKE 'nation:%' AND CAST(split_part(src, ':', 2) AS INTEGER) % 4 = 0")
def graph_invalid(spark, d):
    g = new(spark, d)
    known = g.entitlements.where("not (resource_type_id = 'nation' and cast(resource_id as int) % 4 = 0)")
    return graph.invalid(graph.edges(g.grants, g.entitlements), known)


@query("SELECT 'missing_source' AS reason, count(*) AS n FROM grants WHERE src LIKE 'nation:%' AND CAST(split_part(src, ':', 2) AS INTEGER) % 4 = 0")
def graph_dropped_edges(spark, d):
    g = new(spark, d)
    known = g.entitlements.where("not (resource_type_id = 'nation' and cast(resource_id as int) % 4 = 0)")
    bad = graph.judged_rules(g.grants, known).where("verdict <> 'ok'").withColumnRenamed("verdict", "reason")
    return stats.dropped_edges(bad).drop("examples")


@query(", f AS (SELECT src, count(*) AS edges FROM grants WHERE src IS NOT NULL GROUP BY 1) SELECT src, edges FROM f WHERE edges >= 1")
def graph_shared_sources(spark, d):
    g = new(spark, d)
    return graph.shared_sources(graph.edges(g.grants, g.entitlements), 1)


@query("SELECT 'nation' AS child_type_id, rt AS parent_type_id, rid AS parent_id FROM resources WHERE rt = 'region' AND rid <> '2'")
def unscheduled_children(spark, d):
    planned = lookups.child_schedule(new(spark, d).resources)
    return invariants.unscheduled_children(planned, planned.where("parent_id = '2' or child_type_id = 'region'"))


@query("SELECT CAST(event_id AS VARCHAR) AS cursor_id FROM events WHERE event_id % 3 <> 0", plain=True)
def undrained_cursors(spark, d):
    cursors = star.events(spark, d).select(F.col("event_id").alias("cursor_id"))
    return invariants.undrained(cursors, cursors.where("cast(cursor_id as int) % 3 = 0"))


@query("SELECT unnest(['a','b','c','d']) AS sync_id, unnest([1,0,2,0])::INT AS level", plain=True)
def runs_parent_first(spark, d):
    df = spark.createDataFrame([("a", "b"), ("b", None), ("c", "a"), ("d", "gone")], "sync_id string, parent_sync_id string")
    return syncs.parent_first(star.conform(df, "sync_runs"))


@query("SELECT gid AS external_id FROM grants WHERE pt <> 'supplier' AND rt = 'region'")
def ingest_valid_records(spark, d):
    own = scans.where(new(spark, d).grants, resource_type_id="region")
    broken = own.withColumn("principal_resource_id", F.when(F.col("principal_resource_type_id") == "supplier", F.lit("")).otherwise(F.col("principal_resource_id")))
    return ingest.valid_records(broken, PRINCIPAL)[0].select("external_id")


@query("SELECT rt AS resource_type_id, count(*) AS n FROM resources WHERE rt <> 'supplier' GROUP BY 1")
def ingest_discovered_resources(spark, d):
    g = new(spark, d)
    return stats.count_by_type(ingest.discovered_resources(g.resources, scheduled(g)))


@query("SELECT rt AS resource_type_id, rid AS resource_id, CASE WHEN rt = 'nation' THEN lower(name) ELSE name END AS display_name FROM resources WHERE NOT (rt = 'customer' AND CAST(rid AS INTEGER) % 50 = 7)")
def diff_applied(spark, d):
    g = new(spark, d)
    later = renamed(g)
    out = diff.applied(g.resources, diff.deletions(g.resources, later, "resources"), diff.upserts(g.resources, later, "resources"), "resources")
    return out.select(*RESOURCE, "display_name")


@query("SELECT 'up' AS sync_id, 'partial_upserts' AS sync_type, 'r11' AS parent_sync_id, 'del' AS linked_sync_id UNION ALL SELECT 'del', 'partial_deletions', 'r11', 'up'", plain=True)
def diff_linked_runs(spark, d):
    return diff.linked_runs(runs(spark).where("sync_id = 'r11'"), "up", "del").select("sync_id", "sync_type", "parent_sync_id", "linked_sync_id")


@query("SELECT 'page' || page_id AS external_id, CASE WHEN page_id % 2 = 0 THEN 'Image/webp' ELSE 'text/html' END AS content_type, length(hex(CASE WHEN page_id % 2 = 0 THEN repeat('x', 68) ELSE 'x' END)) // 2 AS bytes FROM pages WHERE page_id % 3 = 0", plain=True)
def assets_sanitised(spark, d):
    p = star.read(spark, d, "pages")
    stored = star.conform(p.select(F.lit(NEW).alias("sync_id"), F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("external_id"), F.when(F.col("page_id") % 2 == 0, "Image/webp").otherwise("text/html").alias("content_type"), F.encode("html", "UTF-8").alias("data")), "assets")
    asked = p.where("page_id % 3 = 0").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("external_id"))
    own = scans.get_many(stored, asked).withColumn("data", sanitize.placeholder(F.col("content_type")))
    return own.select("external_id", "content_type", F.octet_length("data").cast("long").alias("bytes"))


@query("SELECT DISTINCT 'conv' AS row_kind, CAST(conv_id AS VARCHAR) AS scope_key FROM conversations WHERE conv_id % 4 = 0", plain=True)
def source_cache_hits(spark, d):
    c = star.read(spark, d, "conversations").select(F.lit("conv").alias("row_kind"), F.col("conv_id").cast("string").alias("scope_key"), F.lit("v1").alias("validator")).distinct()
    manifest = c.withColumn("validator", F.when(F.col("scope_key").cast("int") % 4 == 0, "v1").otherwise("v2"))
    return lookups.source_cache_hits(c, manifest).select("row_kind", "scope_key")


@query("SELECT 'turn/' || turn AS key, conv_id % 2 = 1 AS odd, count(*) AS n FROM conversations WHERE conv_id % 3 <> 0 GROUP BY 1, 2", plain=True)
def session_values(spark, d):
    c = star.read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("sync_id"), F.concat(F.lit("turn/"), F.col("turn").cast("string")).alias("key"), F.encode("text", "UTF-8").alias("value"))
    now = feed.session_put(c, c.where("cast(sync_id as int) % 3 = 0").withColumn("value", F.lit(None).cast("binary")))
    return now.groupBy("key", (F.col("sync_id").cast("int") % 2 == 1).alias("odd")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT external_id, json_extract_string(to_json({'id': external_id, 'trait': trait}), '$.id') AS id FROM resource_types")
def json_rows(spark, d):
    own = new(spark, d).resource_types
    return own.select("external_id", F.get_json_object(F.to_json(F.struct(*own.columns)), "$.external_id").alias("id"))


@query("SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'balance' WHEN c_mktsegment = 'BUILDING' THEN 'exclusive' ELSE '' END AS problems FROM customer WHERE NOT (c_acctbal < 0 AND c_mktsegment = 'BUILDING')", plain=True)
def configuration_rules(spark, d):
    c = star.read(spark, d, "customer").where("not (c_acctbal < 0 and c_mktsegment = 'BUILDING')")
    c = c.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.when(F.col("c_mktsegment") == "BUILDING", 1).alias("a"), F.lit(1).alias("b"))
    checks = records.problems([records.Rule("balance", required=True, least=0)], {"exclusive": records.relation("exclusive", ["a", "b"])})
    return c.select("k", F.array_join(checks, ",").alias("problems"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'none' AS note, CAST(json_extract_string(props, '$.k') AS BIGINT) IN (1, 2, 3) AS valid FROM events", plain=True)
def ticket_fields(spark, d):
    e = star.read(spark, d, "events")
    p = F.col("props")
    return e.select("event_id", records.ticket_field(p, "k", "bigint").alias("k"), records.ticket_field(p, "note", "string", "none").alias("note"), records.ticket_valid(p, "k", "bigint", True, (1, 2, 3)).alias("valid"))


@query("SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS score, CASE WHEN p_size % 2 = 1 THEN p_type ELSE '' END AS severity FROM part", plain=True)
def insights(spark, d):
    p = star.read(spark, d, "part")
    risk = F.when(F.col("p_size") % 2 == 0, F.struct(F.col("p_name").alias("value"), F.col("p_size").alias("normalized_score"), F.col("p_brand").alias("source_score")))
    issue = F.when(F.col("p_size") % 2 == 1, F.struct(F.col("p_name").alias("value"), F.col("p_type").alias("severity")))
    p = p.withColumn("i", F.struct(risk.alias("risk_score"), issue.alias("issue")))
    return p.select(F.col("p_partkey").alias("k"), records.normalized_score(F.col("i")).alias("score"), records.severity(F.col("i")).alias("severity"))


@query("SELECT n_nationkey AS k, 2 + (n_nationkey % 2 = 0)::INT AS n, n_nationkey % 2 = 0 AS has, n_name AS picked FROM nation", plain=True)
def annotation_lists(spark, d):
    n = star.read(spark, d, "nation")
    one = lambda kind, value: F.struct(F.lit(kind).alias("type_url"), value.alias("value"))
    n = n.withColumn("a", F.array(one("name", F.col("n_name")), one("key", F.col("n_nationkey").cast("string"))))
    updated = records.annotation_update(F.col("a"), one("name", F.col("n_name")))
    n = n.withColumn("a", F.when(F.col("n_nationkey") % 2 == 0, records.annotation_update(F.col("a"), one("even", F.lit("yes")))).otherwise(updated))
    return n.select(F.col("n_nationkey").alias("k"), F.size("a").alias("n"), records.annotation_contains(F.col("a"), "even").alias("has"), records.annotation_pick(F.col("a"), "name")["value"].alias("picked"))


# The feed.


@query("""SELECT entitlement_id, principal_resource_type_id, principal_resource_id, granted, event_id FROM (
  SELECT 'part:' || event_id % 20 || ':buyer' AS entitlement_id, 'customer' AS principal_resource_type_id, CAST(user_id AS VARCHAR) AS principal_resource_id, event_type = 'signup' AS granted, CAST(event_id AS VARCHAR) AS event_id,
    row_number() OVER (PARTITION BY event_id % 20, user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS r FROM events WHERE event_type IN ('signup','error')) WHERE r = 1""", plain=True)
def feed_state(spark, d):
    return feed.state(star.events(spark, d)).drop("occurred_at")


@query("SELECT event_type AS kind, count(*) AS n FROM (SELECT CASE WHEN event_type = 'signup' THEN 'create_grant' WHEN event_type = 'error' THEN 'create_revoke' ELSE 'usage' END AS event_type FROM events) GROUP BY 1", plain=True)
def feed_kinds(spark, d):
    return star.events(spark, d).groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def flagship(spark, d):
    """Who is a member of what and why: the expanded grants with their names."""
    g = new(spark, d)
    df = lookups.hydrate_grants(expanded(spark, d), g.entitlements, g.resources, g.resource_types)
    return df.select("external_id", "entitlement_name", "principal_name", "resource_name", expand.canonical_sources().alias("sources"), "immutable")
