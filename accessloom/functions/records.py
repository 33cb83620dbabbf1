"""Annotation lists, attributes, arguments, configuration rules, ticket fields, insights (R-36, R-151..R-155, R-157)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def annotation_append(annotations: Column, *new: Column) -> Column:
    """R-151."""
    return F.concat(annotations, F.array(*new))


def annotation_update(annotations: Column, new: Column) -> Column:
    """R-151: in place of the first of its type, or at the end."""
    same = lambda a: a["type_url"] == new["type_url"]
    return F.when(F.exists(annotations, same), F.transform(annotations, lambda a: F.when(same(a), new).otherwise(a))).otherwise(annotation_append(annotations, new))


def annotation_contains(annotations: Column, *types: str) -> Column:
    return F.coalesce(F.exists(annotations, lambda a: a["type_url"].isin(*types)), F.lit(False))


def annotation_pick(annotations: Column, kind: str) -> Column:
    """R-151: the first of a type."""
    return F.get(F.filter(annotations, lambda a: a["type_url"] == kind), F.lit(0))


def attribute(own: Column, trait: Column) -> Column:
    """R-152: a resource's own attribute, else its trait's."""
    return F.coalesce(own, trait)


def profile_fields(profile: Column, user_trait: Column) -> Column:
    """R-36: the profile's fields (what is no string is "") and the primary address as `email`."""
    raw = F.from_json(profile, "map<string,string>")
    kinds = F.from_json(profile, "map<string,variant>")
    text = F.map_from_entries(F.transform(F.map_entries(raw), lambda e: F.struct(e["key"], F.when(F.schema_of_variant(F.element_at(kinds, e["key"])) == "STRING", e["value"]).otherwise(F.lit("")))))
    mail = F.get(F.filter(user_trait["emails"], lambda e: e["is_primary"]), F.lit(0))["address"]
    own = F.coalesce(text, F.expr("cast(map() as map<string,string>)"))
    return F.when(mail.isNull(), own).otherwise(F.map_concat(F.map_filter(own, lambda k, _: k != "email"), F.create_map(F.lit("email"), mail)))


def argument(args: Column, name: str, kind: str = "string") -> Column:
    """R-153: a named argument of a JSON object as a type; null where it is missing or another type."""
    return F.try_variant_get(F.try_parse_json(args), f"$.{name}", kind)


def require(args: Column, name: str, kind: str = "string") -> Column:
    """R-153: the argument, or an error."""
    value = argument(args, name, kind)
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"missing argument {name}")).cast(kind))


@dataclass(frozen=True)
class Rule:
    """R-154: what a configuration field has to satisfy; unset fields are judged by `required` alone."""

    name: str
    required: bool = False
    least: float | None = None
    most: float | None = None
    among: tuple = ()
    pattern: str | None = None
    prefix: str | None = None
    suffix: str | None = None
    unique: bool = False

    def holds(self) -> Column:
        c, good = F.col(self.name), F.lit(True)
        size = F.size(c) if self.unique else None
        value = size if size is not None else c
        if self.least is not None:
            good = good & (value >= self.least)
        if self.most is not None:
            good = good & (value <= self.most)
        if self.among:
            good = good & c.isin(*self.among)
        if self.pattern is not None:
            good = good & c.rlike(self.pattern)
        if self.prefix is not None:
            good = good & c.startswith(self.prefix)
        if self.suffix is not None:
            good = good & c.endswith(self.suffix)
        if self.unique:
            good = good & (F.size(F.array_distinct(c)) == size)
        return F.when(c.isNull(), F.lit(not self.required)).otherwise(good)


def relation(kind: str, names: list[str], needed: list[str] = ()) -> Column:
    """R-154: exclusive, together, at_least_one, or dependent (names need all of needed)."""
    n = sum((F.col(c).isNotNull().cast("int") for c in names[1:]), F.col(names[0]).isNotNull().cast("int"))
    if kind == "exclusive":
        return n <= 1
    if kind == "together":
        return (n == 0) | (n == len(names))
    if kind == "at_least_one":
        return n >= 1
    have = F.lit(True)
    for c in needed:
        have = have & F.col(c).isNotNull()
    return (n == 0) | have


def problems(rules: list[Rule], relations: dict[str, Column] | None = None) -> Column:
    """The names of fields and relations that do not hold."""
    bad = [F.when(~r.holds(), F.lit(r.name)) for r in rules] + [F.when(~c, F.lit(k)) for k, c in (relations or {}).items()]
    return F.array_compact(F.array(*bad))


def ticket_field(fields: Column, name: str, kind: str, default=None) -> Column:
    """R-155: a custom field's typed value, else its default."""
    value = argument(fields, name, kind)
    return value if default is None else F.coalesce(value, F.lit(default).cast(kind))


def ticket_valid(fields: Column, name: str, kind: str, required: bool, allowed: tuple = ()) -> Column:
    """R-155: a required field is set, of its type, and among what is allowed."""
    raw, value = F.try_variant_get(F.try_parse_json(fields), f"$.{name}", "variant"), argument(fields, name, kind)
    good = value.isNotNull() & (value.isin(*allowed) if allowed else F.lit(True))
    return F.when(raw.isNull(), F.lit(not required)).otherwise(good)


def normalized_score(insight: Column) -> Column:
    """R-157: 0 where it is no risk score."""
    return F.coalesce(insight["risk_score"]["normalized_score"], F.lit(0))


def source_score(insight: Column) -> Column:
    return F.coalesce(insight["risk_score"]["source_score"], F.lit(""))


def severity(insight: Column) -> Column:
    return F.coalesce(insight["issue"]["severity"], F.lit(""))


def insight_value(insight: Column) -> Column:
    return F.coalesce(insight["risk_score"]["value"], insight["issue"]["value"], F.lit(""))
