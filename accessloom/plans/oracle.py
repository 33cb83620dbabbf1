"""The projected access graph in ANSI SQL, for checking the queries against another engine."""

from __future__ import annotations

from ..sources.star import BEGIN, CUTOFF

GRAPH = f"""
WITH resource_types(external_id, display_name, trait) AS (VALUES
  ('customer','Customer','USER'),('nation','Nation','GROUP'),('org','Organisation','GROUP'),
  ('part','Part','APP'),('region','Region','GROUP'),('supplier','Supplier','USER')),
resources AS (
  SELECT 'org' AS rt, '0' AS rid, 'Organisation' AS name, CAST(NULL AS VARCHAR) AS prt, CAST(NULL AS VARCHAR) AS prid,
    CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS last_name, CAST(NULL AS VARCHAR) AS user_id, CAST(NULL AS VARCHAR) AS segment
  UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name, 'org', '0', NULL, NULL, NULL, NULL, NULL FROM region
  UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name, 'region', CAST(n_regionkey AS VARCHAR), NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name, 'nation', CAST(c_nationkey AS VARCHAR), lower(replace(c_name,'#','.')) || '@example.com',
    CASE WHEN c_custkey % 10 = 0 THEN 'DISABLED' WHEN c_custkey % 10 = 1 THEN 'ENABLED' END, c_name, CAST(c_custkey AS VARCHAR), c_mktsegment FROM customer
  UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name, 'nation', CAST(s_nationkey AS VARCHAR), lower(replace(s_name,'#','.')) || '@example.com', NULL, NULL, CAST(s_suppkey AS VARCHAR), NULL FROM supplier
  UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part),
entitlements AS (
  SELECT rt || ':' || rid || ':member' AS eid, rt, rid, 'member' AS slug, 'Member of ' || rt || ' ' || rid AS name,
    CASE WHEN rt <> 'org' THEN 'geography' END AS grp, false AS is_default FROM resources WHERE rt IN ('org','region','nation')
  UNION ALL SELECT 'part:' || p_partkey || ':buyer', 'part', CAST(p_partkey AS VARCHAR), 'buyer', 'Buyer of part ' || p_partkey, p_brand, p_size % 10 = 0 FROM part
  UNION ALL SELECT 'part:' || p_partkey || ':supplier', 'part', CAST(p_partkey AS VARCHAR), 'supplier', 'Supplier of part ' || p_partkey, NULL, false FROM part),
bought AS MATERIALIZED (SELECT o_custkey, l_partkey, min(o_orderdate) AS seen, min(o_orderdate) < TIMESTAMP '{CUTOFF}' AS was
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
base AS (
  SELECT 'nation' AS rt, CAST(c_nationkey AS VARCHAR) AS rid, 'member' AS slug, 'customer' AS pt, CAST(c_custkey AS VARCHAR) AS pid, TIMESTAMP '{BEGIN}' AS seen, CAST(NULL AS VARCHAR) AS src, false AS shallow, CAST(NULL AS VARCHAR) AS only_type, true AS was FROM customer
  UNION ALL SELECT 'nation', CAST(s_nationkey AS VARCHAR), 'member', 'supplier', CAST(s_suppkey AS VARCHAR), TIMESTAMP '{BEGIN}', NULL, false, NULL, true FROM supplier
  UNION ALL SELECT 'region', CAST(n_regionkey AS VARCHAR), 'member', 'supplier', CAST(s_suppkey AS VARCHAR), TIMESTAMP '{BEGIN}', NULL, false, NULL, true FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0
  UNION ALL SELECT 'part', CAST(l_partkey AS VARCHAR), 'buyer', 'customer', CAST(o_custkey AS VARCHAR), seen, NULL, false, NULL, was FROM bought
  UNION ALL SELECT DISTINCT 'part', CAST(l_partkey AS VARCHAR), 'supplier', 'supplier', CAST(l_suppkey AS VARCHAR), TIMESTAMP '{BEGIN}', NULL, false, CAST(NULL AS VARCHAR), true FROM lineitem
  UNION ALL SELECT 'region', CAST(n_regionkey AS VARCHAR), 'member', 'nation', CAST(n_nationkey AS VARCHAR), TIMESTAMP '{BEGIN}', 'nation:' || n_nationkey || ':member', false, CASE WHEN n_nationkey % 3 = 0 THEN 'customer' END, true FROM nation
  UNION ALL SELECT 'org', '0', 'member', 'region', CAST(r_regionkey AS VARCHAR), TIMESTAMP '{BEGIN}', 'region:' || r_regionkey || ':member', r_regionkey % 2 = 1, NULL, true FROM region),
grants AS MATERIALIZED (SELECT rt || ':' || rid || ':' || slug || ':' || pt || ':' || pid AS gid, rt || ':' || rid || ':' || slug AS eid, * FROM base),
hop1 AS MATERIALIZED (SELECT e.eid AS dst, g.pt, g.pid, g.eid AS src, true AS is_direct FROM grants e JOIN grants g ON g.eid = e.src WHERE e.rt = 'region' AND (e.only_type IS NULL OR e.only_type = g.pt)),
regional AS MATERIALIZED (
  SELECT g.eid, g.pt, g.pid, g.gid, h.src, coalesce(h.is_direct, true) AS is_direct FROM grants g JOIN (SELECT DISTINCT dst, pt, pid FROM hop1) k ON g.eid = k.dst AND g.pt = k.pt AND g.pid = k.pid
    JOIN (SELECT * FROM hop1 UNION ALL SELECT DISTINCT dst, pt, pid, dst, true FROM hop1) h ON h.dst = g.eid AND h.pt = g.pt AND h.pid = g.pid
  UNION ALL SELECT h.dst, h.pt, h.pid, h.dst || ':' || h.pt || ':' || h.pid, h.src, h.is_direct FROM hop1 h WHERE NOT EXISTS (SELECT 1 FROM grants g WHERE g.eid = h.dst AND g.pt = h.pt AND g.pid = h.pid)),
region_rows AS MATERIALIZED (
  SELECT eid, pt, pid, bool_or(src = eid) AS own FROM regional GROUP BY 1, 2, 3
  UNION ALL SELECT eid, pt, pid, true FROM grants g WHERE rt = 'region' AND NOT EXISTS (SELECT 1 FROM hop1 h WHERE h.dst = g.eid AND h.pt = g.pt AND h.pid = g.pid)),
hop2 AS MATERIALIZED (SELECT e.eid AS dst, r.pt, r.pid, r.eid AS src, r.own AS is_direct FROM grants e JOIN region_rows r ON r.eid = e.src WHERE e.rt = 'org' AND (NOT e.shallow OR r.own)),
sources AS MATERIALIZED (
  SELECT gid, src AS source, is_direct FROM regional
  UNION ALL SELECT dst || ':' || pt || ':' || pid, src, is_direct FROM hop2
  UNION ALL SELECT DISTINCT h.dst || ':' || h.pt || ':' || h.pid, h.dst, true FROM hop2 h JOIN grants g ON g.eid = h.dst AND g.pt = h.pt AND g.pid = h.pid),
expanded AS (
  SELECT gid, eid, pt, pid, false AS immutable FROM grants
  UNION ALL SELECT DISTINCT dst || ':' || pt || ':' || pid, dst, pt, pid, true FROM (SELECT dst, pt, pid FROM hop1 UNION SELECT dst, pt, pid FROM hop2) h
    WHERE NOT EXISTS (SELECT 1 FROM grants g WHERE g.eid = h.dst AND g.pt = h.pt AND g.pid = h.pid))
"""
