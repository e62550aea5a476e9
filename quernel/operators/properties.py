"""Typed property rows and the property catalog."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.model import CatalogQuery, Scope, ValueType
from quernel.operators.payload import entries
from quernel.schema import CATALOG, CATALOG_KEY, EVENT_COLUMNS, PROPERTIES

_BAGS = {Scope.EVENT: "properties", Scope.USER: "user_properties"}


def _entries(bag: str) -> Column:
    """Entries of a bag of JSON text; null for what is no object."""
    return entries(F.try_parse_json(F.coalesce(F.col(bag), F.lit("{}"))))


def unflattenable(of: Callable[[str], Column] = _entries) -> Column:
    """Why an event's bags, by their entries, can't become rows, or null. What comes first in the order of writes wins."""

    def error(scope: str, bag: str) -> Column:
        bad = F.filter(of(bag), lambda e: e["kind"].isin("OBJECT", "ARRAY"))
        first = F.array_min(F.transform(bad, lambda e: e["key"]))
        return F.when(of(bag).isNull(), F.lit(f"{bag} is not an object")).when(
            first.isNotNull(), F.concat(F.lit(f"property {scope}."), first, F.lit(" has unsupported value type")),
        )

    nameless = reduce(Column.__or__, [F.exists(of(b), lambda e: e["key"] == "") for b in _BAGS.values()])
    timeless = F.col("event_time").isNull() & F.col("received_at").isNull() & (reduce(Column.__add__, [F.size(of(b)) for b in _BAGS.values()]) > 0)
    return F.coalesce(
        *(error(s, b) for s, b in _BAGS.items()),
        F.when(nameless, F.lit("property name is required")), F.when(timeless, F.lit("property observed time is required")),
    )


def flatten(events: DataFrame) -> DataFrame:
    """One row per event, scope and key; only the slot that ``property_type`` names is filled, the others hold defaults.

    Events that ``unflattenable`` refuses must be taken out before.
    """
    none = F.array().cast("array<struct<scope:string,name:string,kind:string,value:variant>>")

    def named(scope: str, bag: str) -> Column:
        return F.coalesce(
            F.transform(_entries(bag), lambda e: F.struct(F.lit(str(scope)).alias("scope"), e["key"].alias("name"), e["kind"].alias("kind"), e["value"].alias("value"))),
            none,
        )

    rows = F.concat(*(named(s, b) for s, b in _BAGS.items()))
    base = [c for c in EVENT_COLUMNS if c not in _BAGS.values()]
    flat = events.select(*base, F.explode(rows).alias("p"))
    of_kind, value = F.col("p.kind"), F.col("p.value")
    type_ = F.when(of_kind == "VOID", ValueType.NULL).when(of_kind == "BOOLEAN", ValueType.BOOL).when(of_kind == "STRING", ValueType.STRING).otherwise(ValueType.NUMBER)
    slot = lambda t, as_, default: F.when(type_ == t, F.try_variant_get(value, "$", as_)).otherwise(default)
    return flat.select(
        *base, F.col("p.scope").alias("property_scope"), F.col("p.name").alias("property_name"), type_.alias("property_type"),
        slot(ValueType.STRING, "string", F.lit("")).alias("string_value"), slot(ValueType.NUMBER, "double", F.lit(0.0)).alias("number_value"), slot(ValueType.BOOL, "boolean", F.lit(False)).alias("bool_value"),
    ).select(*PROPERTIES.fieldNames())


def record_error() -> Column:
    """Why a property row can't be written and catalogued, or null."""
    needed = {
        "event_id": "event_id", "tenant_id": "tenant_id", "project_id": "project_id", "source_id": "source_id", "property_scope": "property scope",
        "property_name": "property name", "property_type": "property value type",
    }
    checks = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{what} is required")) for c, what in needed.items()]
    return F.coalesce(*checks, F.when(F.coalesce("event_time", "received_at").isNull(), F.lit("property observed time is required")))


def entry_error() -> Column:
    """Why a catalog entry is none, or null."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    missing = lambda c, what: F.when(text(c) == "", F.lit(f"{what} is required"))
    return F.coalesce(
        *(missing(c, c) for c in ("tenant_id", "project_id", "source_id")), missing("property_scope", "property scope"),
        F.when(~F.col("property_scope").isin(*map(str, Scope)), F.lit("property scope must be event or user")), missing("property_name", "property name"),
        missing("property_type", "property value type"), F.when(
            ~F.col("property_type").isin(*map(str, ValueType)), F.lit("property value type must be null, string, number, or bool"),
        ),
        *(F.when(F.col(c).isNull(), F.lit(f"{c} is required")) for c in ("first_seen_at", "last_seen_at")),
    )


def build_catalog(rows: DataFrame) -> DataFrame:
    """First and last sight of each key and type. No counts, so a replay changes nothing."""
    seen = F.coalesce("event_time", "received_at")
    return rows.groupBy(*CATALOG_KEY).agg(F.min(seen).alias("first_seen_at"), F.max(seen).alias("last_seen_at"))


def merge_catalog(old: DataFrame, new: DataFrame) -> DataFrame:
    """Idempotent and commutative."""
    return old.unionByName(new).groupBy(*CATALOG_KEY).agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at")).select(*CATALOG.fieldNames())


def check_catalog_query(query: CatalogQuery) -> None:
    for name in ("tenant_id", "project_id", "source_id"):
        if not getattr(query, name):
            raise ValueError(f"{name} is required")
    if query.scope and query.scope not in list(Scope):
        raise ValueError("property scope must be event or user")
    if query.limit < 0:
        raise ValueError("limit must be greater than or equal to 0")


def list_catalog(catalog: DataFrame, query: CatalogQuery) -> DataFrame:
    """The entries of one source, by scope, name and type; limit 0 means all."""
    check_catalog_query(query)
    out = catalog.where((F.col("tenant_id") == query.tenant_id) & (F.col("project_id") == query.project_id) & (F.col("source_id") == query.source_id))
    if query.scope:
        out = out.where(F.col("property_scope") == query.scope)
    out = out.orderBy("property_scope", "property_name", "property_type")
    return out.limit(query.limit) if query.limit else out
