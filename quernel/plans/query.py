"""Query specifications to lazy DataFrames with evidence.

All guards run before Spark is touched. The fact table may carry a ``route``
partition column, which then prunes; the ids themselves are compared as well,
as hashes may collide.

Property filters become one semi-join. The route is fixed by then, so the event
id is key enough; a property row carries its event's time, so the time bounds
hold on the property side too. Several filters share one scan of the property
table, whose rows are combined per event before the join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.model import FILTER_FIELDS, Direction, EventCountQuery, EventFilter, EventListQuery, Evidence, Family, InvalidEventQuery, Op, Policy, PropertyFilter, PropertyFilterEvidence, RealtimeQuery, Scope, SortField, ValueType
from quernel.schema import EVENT_COLUMNS, route_of

_SLOTS = {ValueType.STRING: "string_value", ValueType.NUMBER: "number_value", ValueType.BOOL: "bool_value"}


def duration_text(d: timedelta) -> str:
    """Hours, minutes and seconds, as in 168h0m0s."""
    s = int(d.total_seconds())
    h, m, s = s // 3600, s // 60 % 60, s % 60
    return f"{h}h{m}m{s}s" if h else f"{m}m{s}s" if m else f"{s}s"


@dataclass(frozen=True)
class Plan:
    frame: DataFrame
    evidence: Evidence

    def explain(self, mode: str = "formatted") -> None:
        self.frame.explain(mode)


@dataclass(frozen=True)
class QueryBuilder:
    """Compiles specifications against an event and a property table."""

    policy: Policy = Policy()
    prefix: str = "events"

    def events(self, query: EventListQuery, events: DataFrame, properties: DataFrame) -> Plan:
        return self._list(Family.EVENTS, query, events, properties)

    def realtime(self, query: RealtimeQuery, events: DataFrame, properties: DataFrame) -> Plan:
        limit = self._limit(query.limit, self.policy.realtime_limit)
        return self._list(Family.REALTIME, EventListQuery(query.tenant_id, query.project_id, query.source_id, since=query.since, limit=limit), events, properties)

    def count(self, query: EventCountQuery, events: DataFrame, properties: DataFrame) -> Plan:
        spec = EventListQuery(**{k: getattr(query, k) for k in query.__dataclass_fields__})
        self._guard(spec)
        scope = self._scope(spec, events, properties)
        return Plan(scope.agg(F.count(F.lit(1)).alias("count")), self._evidence(Family.GOAL, spec, 0))

    def _list(self, family: Family, query: EventListQuery, events: DataFrame, properties: DataFrame) -> Plan:
        self._guard(query)
        order = self._order(query)
        limit = self._limit(query.limit, self.policy.default_limit)
        out = self._scope(query, events, properties).select(*EVENT_COLUMNS).orderBy(*(F.col(c).asc() if way == Direction.ASC else F.col(c).desc() for c, way in order))
        out = out.offset(query.offset).limit(limit) if query.offset else out.limit(limit)
        return Plan(out, self._evidence(family, query, limit))

    # Guards, in the order in which they win.

    def _guard(self, query: EventListQuery) -> None:
        if query.offset < 0:
            raise InvalidEventQuery("offset must be non-negative")
        if query.since and query.until and not query.since < query.until:
            raise InvalidEventQuery("from must be before to")
        n = len(query.filters) + len(query.property_filters)
        if n > self.policy.max_filters:
            raise InvalidEventQuery(f"too many event filters: {n} > {self.policy.max_filters}")
        if query.property_filters:
            if not query.since or not query.until:
                raise InvalidEventQuery("property filters require bounded from and to")
            if query.until - query.since > self.policy.max_property_window:
                raise InvalidEventQuery(f"property-filter time window {duration_text(query.until - query.since)} exceeds max {duration_text(self.policy.max_property_window)}")
        try:
            route_of(query.tenant_id, query.project_id, query.source_id, self.prefix)
        except ValueError as e:
            raise InvalidEventQuery(str(e)) from None
        for i, f in enumerate(query.filters):
            self._check_scalar(i, f)
        allowed = self.policy.allowed_properties | {(s, n.strip()) for s, n in query.allowed_properties if s in list(Scope) and n.strip()}
        for i, f in enumerate(query.property_filters):
            self._check_property(i, f, allowed)
        self._order(query)

    @staticmethod
    def _check_op(op: str) -> None:
        if op not in list(Op):
            raise InvalidEventQuery(f'unsupported events filter operator "{op}"')

    def _check_scalar(self, i: int, f: EventFilter) -> None:
        if f.field not in FILTER_FIELDS:
            raise InvalidEventQuery(f'unsupported events filter field "{f.field}"')
        self._check_op(f.op)
        if not f.value:
            raise InvalidEventQuery(f"event filter {i} value is required")

    def _check_property(self, i: int, f: PropertyFilter, allowed) -> None:
        name = f.name.strip()
        if not name:
            raise InvalidEventQuery(f"property filter {i} property name is required")
        if f.scope not in list(Scope):
            raise InvalidEventQuery(f'property filter {i} unsupported property scope "{f.scope}"')
        if (f.scope, name) not in allowed:
            raise InvalidEventQuery(f"property filter {i} {f.scope}.{name} is not allowlisted")
        self._check_op(f.op)
        if f.value_type == ValueType.NULL:
            if f.op != Op.EQ:
                raise InvalidEventQuery(f"property filter {i} null only supports eq")
        elif f.value_type not in list(ValueType):
            raise InvalidEventQuery(f'property filter {i} unsupported property value type "{f.value_type}"')
        elif not self._fits(f):
            raise InvalidEventQuery(f'property filter {i} value is no "{f.value_type}"')

    @staticmethod
    def _fits(f: PropertyFilter) -> bool:
        """Whether the value can stand in the slot of its type."""
        if f.value_type == ValueType.NUMBER:
            return isinstance(f.value, (int, float)) and not isinstance(f.value, bool) and math.isfinite(f.value)
        return isinstance(f.value, bool if f.value_type == ValueType.BOOL else str)

    def _order(self, query: EventListQuery) -> list[tuple[str, str]]:
        """Ties go to the later event time, the later receipt, then (our own) the smaller id.

        Names and ways, not columns: guards run without a session.
        """
        field, direction = query.sort_field or SortField.EVENT_TIME, query.sort_direction or Direction.DESC
        if field not in list(SortField):
            raise InvalidEventQuery(f'unsupported events sort field "{field}"')
        if direction not in list(Direction):
            raise InvalidEventQuery(f'unsupported events sort direction "{direction}"')
        names = [str(field), *(x for x in ("event_time", "received_at") if x != field), "event_id"]
        ways = [str(direction), *["desc"] * (len(names) - 2), "asc"]
        return list(zip(names, ways, strict=True))

    def _limit(self, limit: int, default: int) -> int:
        return min(limit if limit > 0 else default, self.policy.max_limit)

    # Predicates.

    def _within(self, query: EventListQuery, df: DataFrame) -> DataFrame:
        """Route and time bounds, which hold for both tables."""
        tests = [F.col("tenant_id") == query.tenant_id, F.col("project_id") == query.project_id, F.col("source_id") == query.source_id]
        if "route" in df.columns:
            tests.insert(0, F.col("route") == route_of(query.tenant_id, query.project_id, query.source_id, self.prefix))
        bound = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
        days = "day" in df.columns  # a folder each
        if query.since:
            tests += [F.col("event_time") >= bound(query.since)] + ([F.col("day") >= F.lit(query.since.date())] if days else [])
        if query.until:
            tests += [F.col("event_time") < bound(query.until)] + ([F.col("day") <= F.lit(query.until.date())] if days else [])
        return df.where(reduce(Column.__and__, tests))

    def _scope(self, query: EventListQuery, events: DataFrame, properties: DataFrame) -> DataFrame:
        out = self._within(query, events)
        for column, value in (("event_name", query.event_name), ("distinct_id", query.distinct_id)):
            if value:
                out = out.where(F.col(column) == value)
        for f in query.filters:
            out = out.where((F.col(f.field) == f.value) if f.op == Op.EQ else (F.col(f.field) != f.value))
        if not query.property_filters:
            return out
        tests = [self._matches(f) for f in query.property_filters]
        rows = self._within(query, properties).where(reduce(Column.__or__, tests))
        if len(tests) > 1:
            each = [F.bool_or(t).alias(f"m{i}") for i, t in enumerate(tests)]
            rows = rows.groupBy("event_id").agg(*each).where(reduce(Column.__and__, [F.col(f"m{i}") for i in range(len(tests))]))
        return out.join(rows.select("event_id"), "event_id", "left_semi")

    @staticmethod
    def _matches(f: PropertyFilter) -> Column:
        """A row of the named key and type, and its value where it has one; neq needs the key as well."""
        test = (F.col("property_scope") == str(f.scope)) & (F.col("property_name") == f.name.strip()) & (F.col("property_type") == str(f.value_type))
        if f.value_type == ValueType.NULL:
            return test
        slot, value = F.col(_SLOTS[ValueType(f.value_type)]), F.lit(float(f.value) if f.value_type == ValueType.NUMBER else f.value)
        return test & ((slot == value) if f.op == Op.EQ else (slot != value))

    def _evidence(self, family: Family, query: EventListQuery, limit: int) -> Evidence:
        window = int((query.until - query.since).total_seconds()) if query.since and query.until else 0
        scalars = len(query.filters) + sum(bool(x) for x in (query.event_name, query.distinct_id, query.since, query.until))
        return Evidence(
            family, limit, query.offset, query.since is not None, query.until is not None, max(0, window), scalars,
            tuple(PropertyFilterEvidence(str(f.scope), f.name.strip(), str(f.value_type), str(f.op)) for f in query.property_filters),
            str(query.sort_field or SortField.EVENT_TIME), str(query.sort_direction or Direction.DESC),
        )

