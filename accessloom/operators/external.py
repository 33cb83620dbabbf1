"""Placeholder grants matched to principals of another directory (R-52..R-55). Principals are merged with the grants by their key,
not broadcast: Spark guesses their size from compressed files, far too low."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import fold_key
from ..plans.lineage import dealt

#: Traits of principals that are matched unless others are named.
TRAITS = ("USER", "GROUP")
PRINCIPAL = ["principal_resource_type_id", "principal_resource_id"]


def candidates(principals: DataFrame, resource_types: DataFrame, traits: tuple[str, ...] = TRAITS) -> DataFrame:
    """Principals with the trait that makes them candidates."""
    kinds = resource_types.select(F.col("external_id").alias("resource_type_id"), F.explode("traits").alias("trait")).where(F.col("trait").isin(*traits))
    return principals.join(kinds, "resource_type_id")


def reissued(grants: DataFrame, extra: list[Column] = ()) -> DataFrame:
    """Grants of the matched principal (columns p_type and p_id), one for each."""
    out = grants.withColumns({"principal_resource_type_id": F.col("p_type"), "principal_resource_id": F.col("p_id"), "placeholder_id": F.col("external_id")})
    out = out.withColumns({"external_id": F.concat_ws(":", "entitlement_id", *PRINCIPAL), "external_match": F.lit(None).cast(grants.schema["external_match"].dataType)})
    return dealt(out.drop("p_type", "p_id"), "external_id").dropDuplicates(["external_id"])


def keys(found: DataFrame) -> list[Column]:
    return [F.col("resource_type_id").alias("p_type"), F.col("resource_id").alias("p_id")]


def match_all(grants: DataFrame, found: DataFrame) -> DataFrame:
    """R-52: every candidate of the trait, for each grant that asks for all of them. Its result is that large by definition."""
    asked = grants.where("external_match.kind = 'all'").withColumn("_trait", F.col("external_match.trait"))
    return reissued(asked.join(found.select(F.col("trait").alias("_trait"), *keys(found)).distinct(), "_trait").drop("_trait"))


def match_id(grants: DataFrame, found: DataFrame) -> DataFrame:
    """R-53: the candidate with that id; the entitlements of an expansion move to the matched principal's resource."""
    asked = grants.where("external_match.kind = 'id'").withColumn("_id", F.col("external_match.value"))
    out = dealt(asked, "_id").join(found.select(F.col("resource_id").alias("_id"), *keys(found)).distinct().hint("merge"), "_id").drop("_id")
    moved = F.transform("expansion.entitlement_ids", lambda e: F.concat_ws(":", F.col("p_type"), F.col("p_id"), F.element_at(F.split(e, ":"), -1)))
    out = out.withColumn("expansion", F.when(F.col("expansion").isNotNull(), F.col("expansion").withField("entitlement_ids", moved)))
    return reissued(out)


def properties(found: DataFrame) -> DataFrame:
    """key, folded value and principal: the string fields of profiles, and for `email` the addresses of user traits too."""
    fields = F.from_json("profile", "map<string,string>")
    own = found.select("trait", *keys(found), F.explode(F.coalesce(fields, F.expr("cast(map() as map<string,string>)"))).alias("key", "value"))
    mails = found.select("trait", *keys(found), F.lit("email").alias("key"), F.explode("user_trait.emails.address").alias("value"))
    folded = own.union(mails).select("trait", "p_type", "p_id", "key", fold_key(F.col("value")).alias("folded"))
    return dealt(folded, "trait", "key", "folded").distinct()


def match_key_value(grants: DataFrame, found: DataFrame) -> DataFrame:
    """R-54: candidates whose property has that value, letter case folded; one grant for each principal."""
    asked = grants.where("external_match.kind = 'kv'").withColumns({"trait": F.col("external_match.trait"), "key": F.col("external_match.key"), "folded": fold_key(F.col("external_match.value"))})
    return reissued(dealt(asked, "trait", "key", "folded").join(properties(found).hint("merge"), ["trait", "key", "folded"]).drop("trait", "key", "folded"))


def finished(grants: DataFrame, new: DataFrame) -> DataFrame:
    """R-55: grants after matching: the new ones come in, placeholders go unless one was issued again under its own id."""
    fresh = new.select(*grants.columns)
    return grants.where(F.col("external_match").isNull()).join(fresh.select("external_id"), "external_id", "left_anti").unionByName(fresh)
