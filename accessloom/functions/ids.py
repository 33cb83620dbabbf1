"""Identity strings (R-140, R-141)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RESOURCE = "struct<parent_type:string,parent_id:string,type:string,id:string>"
BID = f"struct<kind:string,resource:{RESOURCE},slug:string,principal:{RESOURCE}>"


def entitlement_id(kind: Column, rid: Column, slug: Column) -> Column:
    return F.concat_ws(":", kind, rid, slug)


def grant_id(entitlement: Column, principal_type: Column, principal_id: Column) -> Column:
    """Lossy: parts may hold colons themselves. Never parse it for identity."""
    return F.concat_ws(":", entitlement, principal_type, principal_id)


def structural_identity(entitlement: Column, kind: Column, rid: Column) -> Column:
    """(type, resource, flag, tail): the tail after exactly `type:resource:` with flag 1, else the whole id with flag 0."""
    prefix = F.concat(kind, F.lit(":"), rid, F.lit(":"))
    has = F.startswith(entitlement, prefix)
    return F.struct(kind.alias("resource_type_id"), rid.alias("resource_id"), has.cast("int").alias("flag"), F.when(has, F.right(entitlement, F.length(entitlement) - F.length(prefix))).otherwise(entitlement).alias("tail"))


def escape(c: Column) -> Column:
    for x in ("\\", "/", ":"):
        c = F.replace(c, F.lit(x), F.lit("\\" + x))
    return c


def part(kind: Column, rid: Column, parent_type: Column | None = None, parent_id: Column | None = None) -> Column:
    """`[parent type/parent id/]type/id`; null where a part that has to be set is not."""
    filled = (kind != "") & (rid != "")
    own = F.concat_ws("/", escape(kind), escape(rid))
    if parent_type is None or parent_id is None:
        return F.when(filled, own)
    whole = F.concat_ws("/", escape(parent_type), escape(parent_id), escape(kind), escape(rid))
    return F.when(filled & parent_type.isNull() & parent_id.isNull(), own).when(filled & (parent_type != "") & (parent_id != ""), whole)


def resource_bid(resource: Column) -> Column:
    return F.concat(F.lit("bid:r:"), resource)


def entitlement_bid(resource: Column, slug: Column) -> Column:
    return F.when(slug != "", F.concat(F.lit("bid:e:"), resource, F.lit(":"), escape(slug)))


def grant_bid(resource: Column, slug: Column, principal: Column) -> Column:
    return F.when(slug != "", F.concat(F.lit("bid:g:"), resource, F.lit(":"), escape(slug), F.lit(":"), principal))


def tokens(text: str) -> list[list[str]] | None:
    """Colon-separated fields of slash-separated parts, escapes undone; None for a wrong escape or an empty part."""
    fields, i = [[""]], 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            if i + 1 >= len(text) or text[i + 1] not in "\\/:":
                return None
            fields[-1][-1] += text[i + 1]
            i += 1
        elif c == ":":
            fields.append([""])
        elif c == "/":
            fields[-1].append("")
        else:
            fields[-1][-1] += c
        i += 1
    return None if any(not p for f in fields for p in f) else fields


def parse(text: str | None) -> dict | None:
    """The parts of a bid; None unless it is a whole and valid one."""
    fields = tokens(text) if text else None
    if not fields or fields[0] != ["bid"] or len(fields) < 3 or len(fields[1]) != 1:
        return None
    kind, rest = fields[1][0], fields[2:]
    want = {"r": 1, "e": 2, "g": 3}.get(kind)
    if want != len(rest) or len(rest[0]) not in (2, 4) or (kind == "g" and len(rest[2]) not in (2, 4)) or (want > 1 and len(rest[1]) != 1):
        return None

    def resource(p: list[str]) -> dict:
        a, b, c, d = p if len(p) == 4 else [None, None, *p]
        return {"parent_type": a, "parent_id": b, "type": c, "id": d}

    return {"kind": kind, "resource": resource(rest[0]), "slug": rest[1][0] if want > 1 else None, "principal": resource(rest[2]) if want == 3 else None}


def parse_bid(c: Column) -> Column:
    @F.pandas_udf(BID)
    def parsed(text: pd.Series) -> pd.DataFrame:
        none = {"kind": None, "resource": None, "slug": None, "principal": None}
        return pd.DataFrame([parse(x) or none for x in text], columns=list(none))

    return parsed(c)
