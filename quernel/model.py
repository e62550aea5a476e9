"""Query specifications, evidence and errors. Plain values: nothing here needs a Spark session."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from enum import StrEnum


class InvalidEventQuery(ValueError):
    """A query outside the allowed surface."""

    def __init__(self, reason: str):
        super().__init__(f"invalid event query: {reason}")


class Scope(StrEnum):
    EVENT = "event"
    USER = "user"


class ValueType(StrEnum):
    NULL = "null"
    STRING = "string"
    NUMBER = "number"
    BOOL = "bool"


class Op(StrEnum):
    EQ = "eq"
    NEQ = "neq"


class SortField(StrEnum):
    EVENT_TIME = "event_time"
    RECEIVED_AT = "received_at"
    EVENT_NAME = "event_name"


class Direction(StrEnum):
    ASC = "asc"
    DESC = "desc"


class Family(StrEnum):
    EVENTS = "events"
    GOAL = "goal"
    REALTIME = "realtime"


#: Columns a scalar filter may name.
FILTER_FIELDS = ("event_name", "distinct_id", "session_id", "visit_id", "source_type")


class _Bounded:
    """Bounds with a zone become UTC without one; the first instant of year one stands for none."""

    def __post_init__(self):
        for name in ("since", "until"):
            at = getattr(self, name, None)
            if at is not None and at.tzinfo is not None:
                at = at.astimezone(UTC).replace(tzinfo=None)
            if at is not None:
                object.__setattr__(self, name, None if at == datetime.min else at)


@dataclass(frozen=True)
class EventFilter:
    field: str
    op: str
    value: str


@dataclass(frozen=True)
class PropertyFilter:
    scope: str
    name: str
    value_type: str
    op: str
    value: str | float | bool | None = None


@dataclass(frozen=True)
class EventListQuery(_Bounded):
    """A page of events. Times are UTC, or of the zone they name; None means unbounded."""

    tenant_id: str = ""
    project_id: str = ""
    source_id: str = ""
    since: datetime | None = None
    until: datetime | None = None
    event_name: str = ""
    distinct_id: str = ""
    filters: tuple[EventFilter, ...] = ()
    property_filters: tuple[PropertyFilter, ...] = ()
    allowed_properties: tuple[tuple[str, str], ...] = ()
    sort_field: str = ""
    sort_direction: str = ""
    limit: int = 0
    offset: int = 0


@dataclass(frozen=True)
class EventCountQuery(_Bounded):
    """A number of events: the list query's predicates without order and page."""

    tenant_id: str = ""
    project_id: str = ""
    source_id: str = ""
    since: datetime | None = None
    until: datetime | None = None
    event_name: str = ""
    distinct_id: str = ""
    filters: tuple[EventFilter, ...] = ()
    property_filters: tuple[PropertyFilter, ...] = ()
    allowed_properties: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class RealtimeQuery(_Bounded):
    tenant_id: str = ""
    project_id: str = ""
    source_id: str = ""
    since: datetime | None = None
    limit: int = 0


@dataclass(frozen=True)
class CatalogQuery:
    tenant_id: str = ""
    project_id: str = ""
    source_id: str = ""
    scope: str = ""
    limit: int = 0


@dataclass(frozen=True)
class PropertyFilterEvidence:
    scope: str
    name: str
    value_type: str
    op: str


@dataclass(frozen=True)
class Evidence:
    """What a plan does, without any of the values it was given."""

    family: Family
    effective_limit: int
    offset: int
    has_lower_bound: bool
    has_upper_bound: bool
    window_seconds: int
    scalar_filters: int
    property_filters: tuple[PropertyFilterEvidence, ...]
    sort_field: str
    sort_direction: str
    read_path: str = "fact_events"
    optimization: str = "direct_fact_table"

    @property
    def uses_property_table(self) -> bool:
        return bool(self.property_filters)

    @property
    def property_filter_count(self) -> int:
        return len(self.property_filters)


@dataclass(frozen=True)
class Policy:
    """Limits that every query meets."""

    max_limit: int = 1000
    max_filters: int = 20
    max_property_window: timedelta = timedelta(days=7)
    allowed_properties: frozenset[tuple[str, str]] = field(default_factory=frozenset)
    default_limit: int = 100
    realtime_limit: int = 50

    def __post_init__(self):
        if self.max_limit <= 0:
            raise ValueError("max query limit must be positive")
        if self.max_filters <= 0:
            raise ValueError("max event filters must be positive")
        if self.max_property_window <= timedelta(0):
            raise ValueError("max property-filter time window must be positive")
        if self.allowed_properties is None:
            raise ValueError("allowed property filter map is required")
