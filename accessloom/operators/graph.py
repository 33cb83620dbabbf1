"""The entitlement graph: edges as a table, its shape on the driver (R-70..R-73, R-79, R-80, R-84, R-87).

Edges are entitlement pairs, fewer than entitlements by design; EDGES guards what the driver takes.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that the driver takes at most.
EDGES = 2_000_000


class GraphError(ValueError):
    pass


def rules(grants: DataFrame) -> DataFrame:
    """One row for each source entitlement of an expandable grant."""
    own = grants.where(F.col("expansion").isNotNull() & F.col("needs_expansion"))
    return own.select(F.explode("expansion.entitlement_ids").alias("src"), F.col("entitlement_id").alias("dst"), "principal_resource_type_id", "principal_resource_id", F.coalesce("expansion.shallow", F.lit(False)).alias("shallow"), F.coalesce("expansion.resource_type_ids", F.array().cast("array<string>")).alias("types"))


def named(entitlements: DataFrame, pairs: DataFrame) -> DataFrame:
    """The entitlements that are an end (src, dst) of a rule or edge: only so many go into joins, however many others there are."""
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("external_id")).distinct()
    return entitlements.join(ends, "external_id", "left_semi")


def judged_rules(grants: DataFrame, entitlements: DataFrame) -> DataFrame:
    """R-70, R-79: rules with verdict ok, missing_source, missing_destination or mismatch (the source's resource is not the
    grant's principal)."""
    found = rules(grants)
    own = named(entitlements, found)
    src = own.select(F.col("external_id").alias("src"), F.col("resource_type_id").alias("_t"), F.col("resource_id").alias("_r"))
    dst = own.select(F.col("external_id").alias("dst"), F.lit(True).alias("_d"))
    same = (F.col("_t") == F.col("principal_resource_type_id")) & (F.col("_r") == F.col("principal_resource_id"))
    verdict = F.when(F.col("_t").isNull(), "missing_source").when(F.col("_d").isNull(), "missing_destination").when(~same, "mismatch").otherwise("ok")
    return found.join(src, "src", "left").join(dst, "dst", "left").withColumn("verdict", verdict).drop("_t", "_r", "_d")


def merged_edges(found: DataFrame) -> DataFrame:
    """R-71: one edge for each pair: deep if one is, unfiltered if one is, else the union of the filters."""
    types = F.when(F.bool_or(F.size("types") == 0), F.array().cast("array<string>")).otherwise(F.sort_array(F.array_distinct(F.flatten(F.collect_set("types")))))
    return found.groupBy("src", "dst").agg(F.bool_and("shallow").alias("shallow"), types.alias("types"))


def edges(grants: DataFrame, entitlements: DataFrame) -> DataFrame:
    """R-70, R-71: src, dst, shallow, types; a mismatched rule is an error when the edges are planned."""
    return merged_edges(judged_rules(grants, entitlements).where("verdict = 'ok'"))


def assert_matched(grants: DataFrame, entitlements: DataFrame) -> None:
    bad = judged_rules(grants, entitlements).where("verdict = 'mismatch'").limit(1).collect()
    if bad:
        raise GraphError(f"source {bad[0]['src']} does not belong to the principal of the grant on {bad[0]['dst']}")


def components(successors: dict[str, list[str]]) -> dict[str, int]:
    """R-72: the strongly connected component of each node (Tarjan, without recursion)."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    of: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    number = 0
    for root in sorted(successors):
        if root in index:
            continue
        work = [(root, iter(successors.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(successors.get(nxt, ()))))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    while True:
                        member = stack.pop()
                        on.discard(member)
                        of[member] = number
                        if member == node:
                            break
                    number += 1
    return of


@dataclass
class Plan:
    """A graph whose cycles are collapsed: nodes of entitlements, edges of nodes, and the layer of each node."""

    node: dict[str, int]
    edges: dict[tuple[int, int], tuple[bool, tuple[str, ...]]]
    layer: dict[int, int]
    cyclic: list[list[str]] = field(default_factory=list)

    def reachable(self, seeds: set[int]) -> set[int]:
        """Nodes that the seeds lead to, the seeds included."""
        out = defaultdict(list)
        for a, b in self.edges:
            out[a].append(b)
        seen, todo = set(seeds), list(seeds)
        while todo:
            for b in out[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen


def plan(rows: list[tuple[str, str, bool, list[str]]], depth: int | None = None) -> Plan:
    """R-72..R-74, R-78: collapse cycles, merge parallel edges, lay nodes out so that edges only lead to later layers. A graph of more
    than depth layers of edges is an error."""
    successors: dict[str, list[str]] = defaultdict(list)
    for src, dst, *_ in rows:
        successors[src].append(dst)
        successors.setdefault(dst, [])
    node = components(successors)
    merged: dict[tuple[int, int], tuple[bool, tuple[str, ...]]] = {}
    for src, dst, shallow, types in rows:
        key = (node[src], node[dst])
        if key[0] == key[1]:
            continue
        kinds = tuple(sorted(types))
        if key in merged:
            was_shallow, was = merged[key]
            kinds = () if not kinds or not was else tuple(sorted({*kinds, *was}))
            shallow = shallow and was_shallow
        merged[key] = (bool(shallow), kinds)
    waiting: dict[int, int] = {n: 0 for n in node.values()}
    out = defaultdict(list)
    for a, b in merged:
        waiting[b] += 1
        out[a].append(b)
    layer = {n: 0 for n, k in waiting.items() if k == 0}
    todo = list(layer)
    while todo:
        a = todo.pop()
        for b in out[a]:
            layer[b] = max(layer.get(b, 0), layer[a] + 1)
            waiting[b] -= 1
            if waiting[b] == 0:
                todo.append(b)
    if depth is not None and max(layer.values(), default=0) > depth:
        raise GraphError(f"the graph is deeper than {depth}")
    loops = {src for src, dst, *_ in rows if src == dst}
    members = defaultdict(list)
    for entitlement, n in node.items():
        members[n].append(entitlement)
    cyclic = sorted(sorted(m) for m in members.values() if len(m) > 1 or m[0] in loops)
    return Plan(dict(node), merged, layer, cyclic)


def collected(edge_table: DataFrame) -> list[tuple[str, str, bool, list[str]]]:
    """The edges, on the driver; too many are an error, not a crash."""
    rows = edge_table.select("src", "dst", "shallow", "types").limit(EDGES + 1).collect()
    if len(rows) > EDGES:
        raise GraphError(f"more than {EDGES} edges")
    return [(r["src"], r["dst"], r["shallow"], r["types"]) for r in rows]


def invalid(edge_table: DataFrame, entitlements: DataFrame) -> DataFrame:
    """R-87: edges with an end that is no entitlement, or from an entitlement to itself."""
    known = named(entitlements, edge_table).select(F.col("external_id").alias("known"))
    lost = lambda c: edge_table.join(known, F.col(c) == F.col("known"), "left_anti").select("src", "dst", F.lit(f"unknown {c}").alias("problem"))
    return lost("src").union(lost("dst")).union(edge_table.where("src = dst").select("src", "dst", F.lit("self").alias("problem")))


def shared_sources(edge_table: DataFrame, fan_out: int = 16) -> DataFrame:
    """R-80: source entitlements of so many edges: those whose grants are worth writing once, before they are read by each."""
    n = edge_table.groupBy("src").agg(F.count(F.lit(1)).alias("edges"))
    return n.where(F.col("edges") >= fan_out)


def bound(edge_table: DataFrame, n: int, digest: int) -> DataFrame:
    """R-87: edges for keeping beside a snapshot, bound to the digest of the grants that they came from."""
    return edge_table.withColumns({"grants": F.lit(n), "digest": F.lit(digest)})


def rebound(stored: DataFrame, n: int, digest: int) -> DataFrame | None:
    """R-87: kept edges, or None where the grants have changed since."""
    kept = stored.select("grants", "digest").distinct().limit(2).collect()
    return stored.drop("grants", "digest") if [tuple(r) for r in kept] == [(n, digest)] else None
