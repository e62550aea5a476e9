"""Schemas of all tables; DDL is generated from them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _T = T.StringType(), T.TimestampNTZType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_IDS = dict.fromkeys(("event_id", "tenant_id", "project_id", "source_id", "source_type", "event_name", "distinct_id", "session_id", "visit_id"), _S)
EVENTS = _struct(**_IDS, event_time=_T, received_at=_T, properties=_S, user_properties=_S, source=_S)
PROPERTIES = _struct(
    **_IDS, event_time=_T, received_at=_T, source=_S, property_scope=_S, property_name=_S, property_type=_S, string_value=_S, number_value=T.DoubleType(),
    bool_value=T.BooleanType(),
)
CATALOG = _struct(tenant_id=_S, project_id=_S, source_id=_S, property_scope=_S, property_name=_S, property_type=_S, first_seen_at=_T, last_seen_at=_T)
STATUS = _struct(tenant_id=_S, project_id=_S, source_id=_S, event_id=_S, status=_S, attempt=T.IntegerType(), last_error=_S, received_at=_T, created_at=_T, updated_at=_T)
DEAD_LETTERS = _struct(
    envelope=_S, raw=_S, original_topic=_S, original_partition=T.IntegerType(), original_offset=T.LongType(), original_key=_S, consumer_group=_S,
    consumer_id=_S, attempt=T.IntegerType(), error=_S, failed_at=_T,
)

EVENT_COLUMNS = EVENTS.fieldNames()
#: The key that makes an event one event.
EVENT_KEY = ("tenant_id", "project_id", "source_id", "event_id")
CATALOG_KEY = CATALOG.fieldNames()[:6]
EVENT_ORDER = ("tenant_id", "project_id", "source_id", "event_time", "visit_id", "event_id")
PROPERTY_ORDER = ("tenant_id", "project_id", "source_id", "property_scope", "property_name", "event_time", "visit_id", "event_id")

_SAFE = re.compile(r"[a-z][a-z0-9_]*")
PROPERTY_SUFFIX = "_properties"


def safe_name(name: str, what: str = "table prefix") -> str:
    """``name`` if it can stand in a table identifier as it is."""
    if not _SAFE.fullmatch(name):
        raise ValueError(f'{what} "{name}" is not a safe identifier')
    return name


def property_table(physical: str) -> str:
    if not physical.strip():
        raise ValueError("physical table name is required")
    return safe_name(physical, "physical table name") + PROPERTY_SUFFIX


def create_table(physical: str, schema: T.StructType, partitions: T.StructType | None = None, order: tuple[str, ...] = (), buckets: int = 16) -> str:
    """DDL of a Parquet table, its columns in the schema's order: partition columns last, rows sorted by ``order`` in buckets of its last column."""
    if not physical.strip():
        raise ValueError("physical table name is required")
    given = [*schema, *(partitions or ())]
    columns = ",\n".join(f"  `{f.name}` {f.dataType.simpleString()}" for f in given)
    out = f"CREATE TABLE IF NOT EXISTS `{safe_name(physical, 'physical table name')}` (\n{columns}\n) USING parquet"
    if partitions:
        out += f"\nPARTITIONED BY ({', '.join(partitions.fieldNames())})"
    if order:
        out += f"\nCLUSTERED BY ({order[-1]}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS"
    return out


#: Partition columns of the event and property tables.
FOLDERS = _struct(route=_S, day=T.DateType())


def short_hash(id: Column) -> Column:
    return F.substring(F.sha2(id, 256), 1, 12)


def route(prefix: str = "events") -> Column:
    """The physical table of a row: ids appear as hashes only."""
    parts = [short_hash(F.col(c)) for c in ("tenant_id", "project_id", "source_id")]
    return F.concat_ws("_", F.lit(safe_name(prefix.strip() or "events")), *parts)


def route_of(tenant_id: str, project_id: str, source_id: str, prefix: str = "events") -> str:
    """The same for given ids, on the driver."""
    import hashlib

    for name, value in (("tenant_id", tenant_id), ("project_id", project_id), ("source_id", source_id)):
        if not value:
            raise ValueError(f"{name} is required")
    parts = [hashlib.sha256(x.encode()).hexdigest()[:12] for x in (tenant_id, project_id, source_id)]
    return "_".join([safe_name(prefix.strip() or "events"), *parts])
