from accessloom.sources.star import conform


def grants(spark, rows):
    """rows: (entitlement, principal type, principal id[, sources[, (source ids, shallow, types)]])."""
    out = []
    for n, row in enumerate(rows):
        ent, kind, pid, sources, rule = (*row, None, None)[:5]
        rt, rid, _ = ent.split(":")
        out.append((f"{ent}:{kind}:{pid}" + (f"#{n}" if any(r[:3] == row[:3] for r in rows[:n]) else ""), ent, rt, rid, kind, pid, sources or {}, rule, rule is not None, False, False))
    ddl = "external_id string, entitlement_id string, resource_type_id string, resource_id string, principal_resource_type_id string, principal_resource_id string, sources map<string,boolean>, expansion struct<entitlement_ids:array<string>,shallow:boolean,resource_type_ids:array<string>>, needs_expansion boolean, immutable boolean, insert_resource boolean"
    return conform(spark.createDataFrame(out, ddl), "grants")


def entitlements(spark, ids):
    rows = [(e, *e.split(":")[:3], "s") for e in ids]
    return conform(spark.createDataFrame(rows, "external_id string, resource_type_id string, resource_id string, slug string, sync_id string"), "entitlements")


def shown(df):
    return {(r.external_id, r.entitlement_id, r.principal_resource_type_id, r.principal_resource_id, tuple(sorted((r.sources or {}).items()))) for r in df.collect()}
