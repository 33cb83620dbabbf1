"""Whole jobs: collecting, compacting and sanitising a snapshot (R-100, R-150, R-162, R-165)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sanitize as S
from ..operators import compact, digests, expand, graph, ingest, invariants, stats, syncs
from ..sources.star import Graph
from ..sources.store import Store
from .lineage import written

#: The stages of a collection, in order (R-162).
STAGES = ("resource_types", "resources", "entitlements", "grants", "expansion")


def collect(store: Store, fresh: Graph, run: DataFrame, sync_type: str = "full") -> Graph:
    """R-162, R-163: filter, expand, check, write; the run's row comes last, so a cut run is done anew from any stage."""
    ents = ingest.fresh_entitlements(fresh.entitlements, fresh.resource_types, sync_type)
    grants = written(ingest.fresh_grants(fresh.grants, fresh.resource_types))
    out = Graph(fresh.resource_types, fresh.resources, ents, expand.expand(grants, ents).grants if sync_type == "full" else grants)
    for table in STAGES[:-1]:
        store.put(table, getattr(out, table))
    store.finish(run)
    return out


def targeted(store: Store, fresh: Graph, parent: str, run: DataFrame) -> None:
    """R-165: a partial run of chosen resources, its parent the run that they were known from."""
    for table in STAGES[:-1]:
        store.put(table, getattr(fresh, table))
    store.finish(run.withColumns({"parent_sync_id": F.lit(parent), "sync_type": F.lit("partial")}))


def compacted(snapshots: list[Graph], sync_id: str) -> dict[str, DataFrame]:
    """R-100: the newest rows of several snapshots (oldest first), expanded anew, with statistics and digests. What a newer
    snapshot lacks stays (R-102): merging adds and replaces."""
    stamp = lambda df: df.withColumn("sync_id", F.lit(sync_id))
    merged = {t: stamp(compact.merge_many([getattr(g, t) for g in snapshots], t)) for t in STAGES[:-1]}
    base = written(expand.rollback(merged["grants"]))
    grants = expand.expand(base, merged["entitlements"]).grants
    return merged | {
        "grants": grants,
        "stats": stats.sync_stats(merged["resource_types"], merged["resources"], merged["entitlements"], grants),
        "digests": digests.roots(grants),
    }


def checked(snapshot: Graph, sync_type: str = "full") -> DataFrame:
    return invariants.verdicts(snapshot, sync_type)


def sanitised(snapshot: Graph, secret: bytes, known_types: list[str], anchor) -> Graph:
    """R-149, R-150: the same graph under pseudonyms; names of resource types, slugs, flags and times' distances stay."""
    own = lambda c: S.sanitize_id(F.col(c), secret)
    whole = lambda c: S.sanitize_composite(F.col(c), secret, known_types)
    kind = lambda c: S.type_token(F.col(c), secret, known_types)
    latest = F.lit(snapshot.grants.agg(F.max("discovered_at")).collect()[0][0])
    moved = S.shift(F.col("discovered_at"), F.lit(anchor).cast("timestamp"), latest)
    emails = F.transform("user_trait.emails", lambda e: e.withField("address", S.sanitize_email(e["address"], secret)))
    resources = snapshot.resources.withColumns({
        "resource_type_id": kind("resource_type_id"), "resource_id": own("resource_id"), "display_name": own("display_name"), "description": own("description"),
        "parent": F.when(F.col("parent").isNotNull(), F.struct(kind("parent.resource_type_id").alias("resource_type_id"), own("parent.resource_id").alias("resource_id"))),
        "profile": S.sanitize_json(F.col("profile"), secret), "discovered_at": moved,
        "user_trait": F.when(F.col("user_trait").isNotNull(), F.struct(emails.alias("emails"), F.col("user_trait.account_type").alias("account_type"), own("user_trait.login").alias("login"))),
    })
    entitlements = snapshot.entitlements.withColumns({"external_id": whole("external_id"), "resource_type_id": kind("resource_type_id"), "resource_id": own("resource_id"), "display_name": own("display_name"), "description": own("description"), "discovered_at": moved})
    sources = F.map_from_entries(F.transform(F.map_entries("sources"), lambda e: F.struct(S.sanitize_composite(e["key"], secret, known_types), e["value"])))
    rule = F.when(F.col("expansion").isNotNull(), F.col("expansion").withField("entitlement_ids", F.transform("expansion.entitlement_ids", lambda e: S.sanitize_composite(e, secret, known_types))))
    grants = snapshot.grants.withColumns({
        "external_id": whole("external_id"), "entitlement_id": whole("entitlement_id"), "resource_type_id": kind("resource_type_id"), "resource_id": own("resource_id"),
        "principal_resource_type_id": kind("principal_resource_type_id"), "principal_resource_id": own("principal_resource_id"), "sources": sources, "expansion": rule, "discovered_at": moved,
    })
    types = snapshot.resource_types.withColumns({"display_name": own("display_name"), "description": own("description")})
    return Graph(types, resources, entitlements, grants)


def newest_pair(runs: DataFrame) -> DataFrame:
    return syncs.latest_and_previous(runs)


def edges_of(snapshot: Graph) -> DataFrame:
    return graph.edges(snapshot.grants, snapshot.entitlements)
