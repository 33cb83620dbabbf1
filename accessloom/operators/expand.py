"""Transitive grant expansion, its rollback and its incremental form (R-74..R-86).

Nodes are worked through in layers; a layer is one join of the present grants with its edges, combined by destination and
principal, and one merge into the destination's own grants. Each layer is written, so a plan stays as short at the last layer
as at the first, and only rows of destinations are rewritten.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import written
from . import graph as G

PRINCIPAL = ["principal_resource_type_id", "principal_resource_id"]
NONE = "cast(map() as map<string,boolean>)"
#: Layers of edges beyond which expansion stops with an error.
DEPTH = 20
#: Entitlements beyond which their grants are found by a join.
FEW = 1000


def sources_of(column: str = "sources") -> Column:
    return F.coalesce(F.col(column), F.expr(NONE))


def direct(source: Column) -> Column:
    """Whether a grant is a direct one of that entitlement."""
    return (F.size(sources_of()) == 0) | F.map_contains_key(sources_of(), source)


def among(df: DataFrame, ids: list[str], column: str = "entitlement_id") -> DataFrame:
    """Rows of those entitlements. A few are named in the plan: the filter goes down to the scans, and no other row is dealt out."""
    if len(ids) <= FEW:
        return df.where(F.col(column).isin(ids))
    return df.join(df.sparkSession.createDataFrame([(e,) for e in ids], f"{column} string"), column, "left_semi").select(*df.columns)


def besides(df: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of all other entitlements."""
    if len(ids) <= FEW:
        return df.where(F.col("entitlement_id").isNull() | ~F.col("entitlement_id").isin(ids))
    return df.join(df.sparkSession.createDataFrame([(e,) for e in ids], "entitlement_id string"), "entitlement_id", "left_anti").select(*df.columns)


def contributions(current: DataFrame, nodes: DataFrame, layer_edges: DataFrame) -> DataFrame:
    """R-75: node, principal and the sources that reach them, with their directness."""
    own = current.where(F.col("principal_resource_type_id").isNotNull() & F.col("principal_resource_id").isNotNull())
    sent = own.join(nodes, "entitlement_id").join(layer_edges, F.col("node") == F.col("from"))
    sent = sent.withColumn("is_direct", direct(F.col("entitlement_id")))
    fits = (F.size("types") == 0) | F.array_contains("types", F.col("principal_resource_type_id"))
    sent = sent.where(fits & (~F.col("shallow") | F.col("is_direct")))
    each = sent.groupBy("to", *PRINCIPAL, F.col("entitlement_id").alias("source")).agg(F.bool_or("is_direct").alias("is_direct"))
    return each.groupBy("to", *PRINCIPAL).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "is_direct")))).alias("given"))


def merged(existing: DataFrame, given: DataFrame, entitlements: DataFrame) -> DataFrame:
    """R-76, R-77: the destination's grants with their new sources, and grants for principals that had none."""
    own = F.when(F.size(sources_of()) == 0, F.create_map("entitlement_id", F.lit(True))).otherwise(sources_of())
    union = F.map_zip_with(own, "given", lambda _, a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))
    kept = existing.join(given, ["entitlement_id", *PRINCIPAL], "left")
    kept = kept.withColumn("sources", F.when(F.col("given").isNotNull(), union).otherwise(sources_of())).select(*existing.columns)
    fresh = given.join(existing.select("entitlement_id", *PRINCIPAL).distinct(), ["entitlement_id", *PRINCIPAL], "left_anti")
    ents = entitlements.select(F.col("external_id").alias("entitlement_id"), "sync_id", "resource_type_id", "resource_id")
    fresh = fresh.join(ents, "entitlement_id").withColumns({"external_id": F.concat_ws(":", "entitlement_id", *PRINCIPAL), "immutable": F.lit(True), "insert_resource": F.lit(False), "needs_expansion": F.lit(False), "sources": F.col("given")})
    fields = {f.name: f.dataType for f in existing.schema}
    new = fresh.select(*((F.col(c) if c in fresh.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()))
    return kept.unionByName(new)


@dataclass
class Expanded:
    grants: DataFrame
    mode: str
    layers: int


def run(grants: DataFrame, entitlements: DataFrame, shape: G.Plan, only: set[int] | None = None) -> Expanded:
    """Expand the nodes of a plan, or only those given, from grants whose rows at these are unexpanded."""
    spark = grants.sparkSession
    into = {b for _, b in shape.edges if only is None or b in only}
    if not into:
        return Expanded(grants, "full", 0)
    known = "entitlement_id string, node int"
    nodes = spark.createDataFrame(sorted((e, n) for e, n in shape.node.items()), known)
    rows = [(a, b, shallow, list(types), shape.layer[b]) for (a, b), (shallow, types) in shape.edges.items() if b in into]
    every = spark.createDataFrame(rows, T._parse_datatype_string("from int, to int, shallow boolean, types array<string>, layer int"))
    goals = sorted(e for e, n in shape.node.items() if n in into)
    sending = {a for a, b in shape.edges if b in into}
    senders = sorted(e for e, n in shape.node.items() if n in sending)
    placed = spark.createDataFrame([(e, shape.node[e], shape.layer[shape.node[e]]) for e in goals], known + ", layer int")
    # Layers read the rows of destinations and sources alone: these are written once, and all grants are computed but for the result.
    near = written(among(grants, sorted({*goals, *senders})))
    own, entitlements = among(near, goals), among(entitlements, goals, "external_id")
    current, out = among(besides(near, goals), senders), besides(grants, goals)
    layers = sorted({layer for *_, layer in rows})
    for layer in layers:
        given = contributions(current, nodes, every.where(F.col("layer") == layer)).withColumnRenamed("to", "node")
        given = given.join(placed.where(F.col("layer") == layer).select("node", "entitlement_id"), "node").drop("node")
        existing = among(own, [e for e in goals if shape.layer[shape.node[e]] == layer])
        done = written(merged(existing, given, entitlements))
        current, out = current.unionByName(done), out.unionByName(done)
    return Expanded(out, "full", len(layers))


def expand(grants: DataFrame, entitlements: DataFrame, depth: int | None = DEPTH) -> Expanded:
    """R-74: all grants after expansion."""
    G.assert_matched(grants, entitlements)
    return run(grants, entitlements, G.plan(G.collected(G.edges(grants, entitlements)), depth))


def sources_table(grants: DataFrame) -> DataFrame:
    """A row for each grant and source."""
    return grants.select("external_id", F.explode("sources").alias("source", "is_direct"))


def classify_rollback(grants: DataFrame, preserve_suspect: bool = False) -> DataFrame:
    """R-85: action keep, delete or clear; suspect: a row to delete that expansion did not mark as its own."""
    has = F.size(sources_of()) > 0
    self_key = F.map_contains_key(sources_of(), F.col("entitlement_id"))
    suspect = has & ~self_key & ~F.coalesce("immutable", F.lit(False))
    keep = ~has | (suspect & F.lit(preserve_suspect))
    return grants.withColumns({"action": F.when(keep, "keep").when(self_key, "clear").otherwise("delete"), "suspect": suspect})


def rollback(grants: DataFrame, preserve_suspect: bool = False) -> DataFrame:
    """R-85: the grants as they were before expansion."""
    judged = classify_rollback(grants, preserve_suspect).where("action <> 'delete'")
    return judged.withColumn("sources", F.when(F.col("action") == "clear", F.expr(NONE)).otherwise(sources_of())).select(*grants.columns)


def canonical_sources(column: str = "sources") -> Column:
    """R-86: k=bool of each source in order of keys."""
    return F.array_join(F.sort_array(F.transform(F.map_entries(sources_of(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")


def sources_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """R-86: grants whose sources differ, or that only one side has."""
    side = lambda df, name: df.select("external_id", canonical_sources().alias(name))
    both = side(before, "before").join(side(after, "after"), "external_id", "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def edge_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """R-83: unchanged, widened or narrowed for each edge (added and removed where one side lacks it); narrowed wins."""
    a = before.select("src", "dst", F.col("shallow").alias("was_shallow"), F.col("types").alias("was"))
    b = after.select("src", "dst", F.col("shallow").alias("is_shallow"), F.col("types").alias("now"))
    both = a.join(b, ["src", "dst"], "full_outer")
    open_was, open_now = F.size("was") == 0, F.size("now") == 0
    less = (~F.col("was_shallow") & F.col("is_shallow")) | (open_was & ~open_now) | (~open_was & ~open_now & (F.size(F.array_except("was", "now")) > 0))
    more = (F.col("was_shallow") & ~F.col("is_shallow")) | (~open_was & open_now) | (~open_was & ~open_now & (F.size(F.array_except("now", "was")) > 0))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(less, "narrowed").when(more, "widened").otherwise("unchanged")
    return both.select("src", "dst", change.alias("change"))


def changed_entitlements(before: DataFrame, after: DataFrame) -> DataFrame:
    """R-84: entitlements whose grants differ between two snapshots (by key, sources or expansion rule)."""
    rule = lambda df, n: df.select("external_id", "entitlement_id", F.concat_ws("|", canonical_sources(), F.to_json("expansion")).alias(n))
    both = rule(before, "before").join(rule(after, "after"), ["external_id", "entitlement_id"], "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select("entitlement_id").distinct()


def expand_changes(expanded: DataFrame, entitlements: DataFrame, was: DataFrame, now: DataFrame, changed: list[str], least_nodes: int = 1000, share: float = 0.1) -> Expanded:
    """R-81, R-82: grants (expanded before, with the changes applied) after the edges became `now` and `changed` entitlements got
    other grants. Only what the changes lead to is recomputed; cycles, narrowed edges and changes that lead to most of a
    large graph are done in full."""
    shape = G.plan(G.collected(now))
    changes = edge_change(was, now).where("change <> 'unchanged'").collect()
    reason = ""
    if shape.cyclic:
        reason = "cycle"
    elif any(r["change"] in ("narrowed", "removed") for r in changes):
        reason = "narrowed"
    seeds = {shape.node[r["dst"]] for r in changes if r["dst"] in shape.node} | {shape.node[e] for e in changed if e in shape.node}
    affected = shape.reachable(seeds)
    if not reason and len(shape.layer) >= least_nodes and len(affected) > share * len(shape.layer):
        reason = "dense"
    if reason:
        out = run(rollback(expanded), entitlements, shape)
        return Expanded(out.grants, f"full: {reason}", out.layers)
    ids = [e for e, n in shape.node.items() if n in affected]
    fresh = rollback(among(expanded, ids)).unionByName(besides(expanded, ids))
    out = run(fresh, entitlements, shape, affected)
    return Expanded(out.grants, "incremental", out.layers)
