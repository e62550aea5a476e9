"""Registered queries of the event engine with their DuckDB forms."""

from __future__ import annotations

import dataclasses
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel import fixtures
from quernel.functions.text import BROWSERS, DEVICES, SYSTEMS, client_ip, family, trimmed
from quernel.model import CatalogQuery, EventCountQuery, EventFilter, EventListQuery, InvalidEventQuery, Policy, PropertyFilter, RealtimeQuery
from quernel.operators.normalize import normalize
from quernel.operators.properties import build_catalog, flatten, list_catalog, merge_catalog
from quernel.operators.stages import enrich, filter_traffic, with_status
from quernel.plans.query import QueryBuilder
from quernel.plans.reader import EventReader
from quernel.schema import EVENT_COLUMNS, EVENT_KEY, STATUS, route
from quernel.sources.bus import messages
from quernel.sources.store import EventStore
from quernel.streaming.ingest import Ingest, decode, first_of_each
from quernel.streaming.status import EVENT_WRITES, PROPERTY_WRITES, claims

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_BUILDER = QueryBuilder(Policy(allowed_properties=frozenset({("event", "k"), ("event", "tag"), ("event", "even"), ("event", "opt"), ("user", "score"), ("event", "button"), ("event", "is_paid")})))
_SOURCE = {"tenant_id": "tenant_1", "project_id": "project_1", "source_id": "source_1"}
_COLUMNS = ", ".join(EVENT_COLUMNS)


def _sql_scope(spec, fixture: str, columns: str) -> str:
    """A specification without order and limit, as the plain nested form."""
    text = lambda v: "'" + str(v).replace("'", "''") + "'"
    base = [f"{c} = {text(getattr(spec, c))}" for c in ("tenant_id", "project_id", "source_id")]
    tests = list(base)
    tests += [f"event_time >= TIMESTAMP '{spec.since}'"] if spec.since else []
    tests += [f"event_time < TIMESTAMP '{spec.until}'"] if getattr(spec, "until", None) else []
    tests += [f"{c} = {text(getattr(spec, c))}" for c in ("event_name", "distinct_id") if getattr(spec, c, "")]
    tests += [f"{f.field} {'=' if f.op == 'eq' else '<>'} {text(f.value)}" for f in getattr(spec, "filters", ())]
    for f in getattr(spec, "property_filters", ()):
        inner = [*base, f"property_scope = '{f.scope}'", f"property_name = '{f.name}'", f"property_type = '{f.value_type}'"]
        if f.value_type != "null":
            value = text(f.value) if f.value_type == "string" else str(f.value).lower()
            inner.append(f"{f.value_type}_value {'=' if f.op == 'eq' else '<>'} {value}")
        tests.append(f"(tenant_id, project_id, source_id, event_id) IN (SELECT (tenant_id, project_id, source_id, event_id) FROM prop WHERE {' AND '.join(inner)})")
    return f"WITH {fixture} SELECT {columns} FROM env WHERE {' AND '.join(tests)}"


def _new_store(spark: SparkSession, name: str = "store") -> EventStore:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quernel-store-")
    return EventStore(spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")


_STORES: dict[tuple, EventStore] = {}


def _once(spark: SparkSession, key: tuple, make: Callable[[EventStore], None]) -> EventStore:
    """A store that is filled once a session."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _STORES:
        store = _new_store(spark)
        make(store)
        _STORES[key] = store
    return _STORES[key]


def _stored(spark: SparkSession, sf_dir: str) -> EventStore:
    """The fixture in three batches, of which the first two are compacted into a run."""

    def make(store: EventStore) -> None:
        events = fixtures.envelopes(spark, sf_dir)
        for batch in range(3):
            part = events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == batch)
            store.append_events(part, batch)
            store.append_properties(flatten(part), batch)
        store.write_catalog(build_catalog(flatten(events)), 2)
        for table in ("events", "properties"):
            store.compact(table, 1)
            store.vacuum(table)

    return _once(spark, (sf_dir,), make)


def _bench_store(spark: SparkSession, rows: int) -> EventStore:
    def make(store: EventStore) -> None:
        store.append_events(fixtures.bench_events(spark, rows), 0)
        store.append_properties(fixtures.bench_properties(spark, rows), 0)

    return _once(spark, ("bench", rows), make)


def _listed(name: str, spec, rows: int | None = None, stored: bool = False) -> None:
    """Registers a list, realtime or count query over the fixture, over a store of it, or over a store of ``rows`` generated events."""
    fixture = fixtures.bench_sql(rows) if rows else fixtures.ENVELOPES_SQL

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        if rows or stored:
            reader = EventReader(_bench_store(spark, rows) if rows else _stored(spark, sf_dir), _BUILDER)
            plan = reader.count(spec) if isinstance(spec, EventCountQuery) else reader.realtime(spec) if isinstance(spec, RealtimeQuery) else reader.events(spec)
            return plan.frame
        events = fixtures.envelopes(spark, sf_dir)
        props = flatten(events)
        if isinstance(spec, EventCountQuery):
            return _BUILDER.count(spec, events, props).frame
        return (_BUILDER.realtime if isinstance(spec, RealtimeQuery) else _BUILDER.events)(spec, events, props).frame

    QUERIES[name] = query
    if isinstance(spec, EventCountQuery):
        SQL[name] = _sql_scope(spec, fixture, "count(*)::BIGINT AS count")
        return
    field, way = getattr(spec, "sort_field", "") or "event_time", getattr(spec, "sort_direction", "") or "desc"
    order = [f"{field} {way}", *(f"{x} DESC" for x in ("event_time", "received_at") if x != field), "event_id ASC"]
    limit = min(spec.limit if spec.limit > 0 else (50 if isinstance(spec, RealtimeQuery) else 100), 1000)
    SQL[name] = _sql_scope(spec, fixture, _COLUMNS) + f" ORDER BY {', '.join(order)} LIMIT {limit} OFFSET {getattr(spec, 'offset', 0)}"


_DAY = datetime(2024, 1, 1)
_WEEK = {"since": datetime(2024, 1, 2), "until": datetime(2024, 1, 9)}


def _prop(scope, name, kind, op, value=None):
    return PropertyFilter(scope, name, kind, op, value)


_listed("events_list_default", EventListQuery(**_SOURCE))
_listed("events_list_paged", EventListQuery(**_SOURCE, limit=25, offset=50))
_listed("events_window", EventListQuery(**_SOURCE, **_WEEK, event_name="purchase", limit=1000))
_listed("events_sort_received_asc", EventListQuery(**_SOURCE, sort_field="received_at", sort_direction="asc"))
_listed("events_sort_name_asc", EventListQuery(**_SOURCE, sort_field="event_name", sort_direction="asc", limit=200))
_listed("events_scalar_eq", EventListQuery(**_SOURCE, filters=(EventFilter("source_type", "eq", "web"),)))
_listed("events_scalar_neq", EventListQuery(**_SOURCE, filters=(EventFilter("event_name", "neq", "click"),)))
_listed(
    "events_scalar_combo",
    EventListQuery(**_SOURCE, event_name="view", filters=(EventFilter("source_type", "eq", "web"), EventFilter("distinct_id", "neq", "visitor_4")), limit=5000),
)
_listed("events_prop_string_eq", EventListQuery(**_SOURCE, **_WEEK, property_filters=(_prop("event", "tag", "string", "eq", "g3"),), limit=1000))
_listed("events_prop_number_neq", EventListQuery(**_SOURCE, **_WEEK, property_filters=(_prop("event", "k", "number", "neq", 10.0),), limit=1000))
_listed("events_prop_bool_eq", EventListQuery(**_SOURCE, **_WEEK, property_filters=(_prop("event", "even", "bool", "eq", True),), limit=1000))
_listed("events_prop_null", EventListQuery(**_SOURCE, **_WEEK, property_filters=(_prop("event", "opt", "null", "eq"),), limit=1000))
_MULTI = (_prop("event", "tag", "string", "neq", "g1"), _prop("event", "even", "bool", "eq", False), _prop("user", "score", "number", "neq", 1.0))
_listed("events_prop_multi", EventListQuery(**_SOURCE, **_WEEK, property_filters=_MULTI, limit=1000))
_listed("goal_count", EventCountQuery(**_SOURCE, event_name="purchase"))
_listed("goal_count_props", EventCountQuery(**_SOURCE, **_WEEK, property_filters=_MULTI))
_listed("goal_count_empty_route", EventCountQuery(**(_SOURCE | {"source_id": "source_none"})))
_listed("realtime_recent", RealtimeQuery(**_SOURCE, since=_DAY + timedelta(days=3), limit=20))
_listed("realtime_default_limit", RealtimeQuery(**_SOURCE, since=_DAY))
_listed("realtime_capped", RealtimeQuery(**_SOURCE, limit=5000))

# The same through a store, and bounds that name a zone.
_listed("store_events_prop_multi", EventListQuery(**_SOURCE, **_WEEK, property_filters=_MULTI, limit=1000), stored=True)
_listed("store_events_scalar", EventListQuery(**_SOURCE, **_WEEK, filters=(EventFilter("source_type", "eq", "web"),), limit=500, offset=20), stored=True)
_listed("store_goal_count_props", EventCountQuery(**_SOURCE, **_WEEK, property_filters=_MULTI), stored=True)
_listed("store_goal_count_empty", EventCountQuery(**(_SOURCE | {"source_id": "source_none"})), stored=True)
_listed("store_realtime", RealtimeQuery(**_SOURCE, since=_DAY + timedelta(days=3), limit=20), stored=True)
_EAST = timezone(timedelta(hours=9, minutes=30))
_listed(
    "store_events_zoned_bounds",
    EventListQuery(**_SOURCE, since=datetime(2024, 1, 2, 9, 30, tzinfo=_EAST), until=datetime(2024, 1, 4, 9, 30, tzinfo=_EAST), event_name="purchase", limit=1000),
    stored=True,
)

# The reader benchmark's scenarios, over stored tables.
_START, _N = datetime.fromisoformat(fixtures.BENCH_START), 10_000
_AT = lambda s: _START + timedelta(seconds=s)
_SCALAR = EventListQuery(**_SOURCE, event_name="signup_clicked", distinct_id="visitor_1", limit=50)
_PROPS = dataclasses.replace(
    _SCALAR, filters=(EventFilter("session_id", "eq", "session_1"),),
    property_filters=(_prop("event", "button", "string", "eq", "hero"), _prop("user", "score", "number", "eq", 43.5), _prop("event", "is_paid", "bool", "eq", True)),
    sort_field="received_at", sort_direction="desc",
)
_listed("bench_realtime_recent", RealtimeQuery(**_SOURCE, since=_AT(_N - 300), limit=50), _N)
_listed("bench_realtime_wide", RealtimeQuery(**_SOURCE, since=_AT(-60), limit=50), _N)
_listed("bench_scalar_recent", dataclasses.replace(_SCALAR, since=_AT(_N - 5000), until=_AT(_N)), _N)
_listed("bench_scalar_wide", dataclasses.replace(_SCALAR, since=_AT(-60), until=_AT(_N)), _N)
_LONG = 700_000
for _name, _seconds in (("24h", 86_400), ("72h", 259_200), ("7d", 604_800)):
    _listed(f"bench_scalar_{_name}", dataclasses.replace(_SCALAR, since=_AT(_LONG - _seconds), until=_AT(_LONG)), _LONG)
_listed("bench_property_recent", dataclasses.replace(_PROPS, since=_AT(_N - 5000), until=_AT(_N)), _N)
_listed("bench_property_wide", dataclasses.replace(_PROPS, since=_AT(-60), until=_AT(_N)), _N)


def _register(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


_ENV = fixtures.ENVELOPES_SQL


@_register(f"WITH {_ENV} SELECT * FROM prop")
def property_rows(spark, sf_dir):
    return flatten(fixtures.envelopes(spark, sf_dir))


_CATALOG_SQL = f"WITH {_ENV} SELECT tenant_id, project_id, source_id, property_scope, property_name, property_type, min(event_time) AS first_seen_at, max(event_time) AS last_seen_at FROM prop"


@_register(f"{_CATALOG_SQL} GROUP BY ALL")
def property_catalog(spark, sf_dir):
    return build_catalog(flatten(fixtures.envelopes(spark, sf_dir)))


@_register(f"{_CATALOG_SQL} WHERE source_id = 'source_1' AND property_scope = 'event' GROUP BY ALL ORDER BY property_scope, property_name, property_type LIMIT 3")
def property_catalog_list(spark, sf_dir):
    return list_catalog(property_catalog(spark, sf_dir), CatalogQuery(**_SOURCE, scope="event", limit=3))


@_register(f"WITH {_ENV} SELECT event_id, session_id FROM env")
def session_id_values(spark, sf_dir):
    return fixtures.envelopes(spark, sf_dir).select("event_id", "session_id")


@_register(f"WITH {_ENV} SELECT event_id, visit_id FROM env")
def visit_id_values(spark, sf_dir):
    return fixtures.envelopes(spark, sf_dir).select("event_id", "visit_id")


@_register(f"WITH {_ENV} SELECT DISTINCT source_id, 'events_' || substr(sha256(tenant_id), 1, 12) || '_' || substr(sha256(project_id), 1, 12) || '_' || substr(sha256(source_id), 1, 12) AS route FROM env")
def route_names(spark, sf_dir):
    return fixtures.envelopes(spark, sf_dir).select("source_id", route().alias("route")).distinct()


def _family_sql(families) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(agent), '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in families.items()) + " ELSE '' END"


def _clients(spark, sf_dir):
    """The requests with their client columns, as a trusted proxy passes them on."""
    df = fixtures.requests(spark, sf_dir)
    return df.withColumns({"user_agent": trimmed(F.col("user_agent")), "ip": client_ip(F.col("forwarded_for"), F.col("real_ip"), F.col("peer"), True), "method_status": F.when(F.col("method") != "POST", 405)})


_REQ = fixtures.REQUESTS_SQL
_BOT_SQL = "contains(lower(agent), 'bot') OR contains(lower(agent), 'crawler') OR contains(lower(agent), 'headlesschrome') OR contains(lower(agent), 'spider')"
#: Networks and addresses that count as internal.
_INSIDE = {"cidrs": ("10.1.0.0/17", "2001:db8::/64"), "ips": ("203.0.113.6",)}
_REASON_SQL = f"CASE WHEN {_BOT_SQL} THEN 'bot user agent' WHEN ip LIKE '10.1.2.%' OR ip = '2001:db8::2' OR ip = '203.0.113.6' THEN 'internal ip' END"


@_register(f"WITH {_REQ} SELECT n, ip, agent AS user_agent FROM req")
def client_fields(spark, sf_dir):
    return _clients(spark, sf_dir).select("n", "ip", "user_agent")


@_register(f"WITH {_REQ} SELECT n, {_family_sql(BROWSERS)} AS browser, {_family_sql(SYSTEMS)} AS os, {_family_sql(DEVICES)} AS device FROM req")
def ua_families(spark, sf_dir):
    u = F.col("user_agent")
    return fixtures.requests(spark, sf_dir).select("n", family(u, BROWSERS).alias("browser"), family(u, SYSTEMS).alias("os"), family(u, DEVICES).alias("device"))


@_register(f"WITH {_REQ} SELECT n, CASE WHEN {_BOT_SQL} THEN 'bot user agent' END AS filter_reason FROM req")
def bot_filtered(spark, sf_dir):
    return _clients(spark, sf_dir).transform(filter_traffic()).select("n", "filter_reason")


@_register(f"WITH {_REQ} SELECT n, {_REASON_SQL} AS filter_reason FROM req")
def internal_ip_filtered(spark, sf_dir):
    return _clients(spark, sf_dir).transform(filter_traffic(**_INSIDE)).select("n", "filter_reason")


@_register(f"""WITH {_REQ}, f AS (SELECT *, {_family_sql(BROWSERS)} AS b, {_family_sql(SYSTEMS)} AS o, {_family_sql(DEVICES)} AS d FROM req)
SELECT n, '{{"plan":"free","client.ip_hash":"ip_' || substr(sha256(concat_ws(chr(0), 'client-ip', 's', ip)), 1, 32) || '"' || CASE WHEN b <> '' THEN ',"client.browser":"' || b || '"' ELSE '' END
  || CASE WHEN o <> '' THEN ',"client.os":"' || o || '"' ELSE '' END || CASE WHEN d <> '' THEN ',"client.device":"' || d || '"' ELSE '' END || '}}' AS properties FROM f""")
def enriched_props(spark, sf_dir):
    df = _clients(spark, sf_dir).withColumn("properties", F.lit('{"plan":"free"}'))
    return df.transform(enrich(ip_salt="s", families=True)).select("n", "properties")


@_register(f"""WITH {_REQ} SELECT n, CASE WHEN error = 'method not allowed' THEN 405 WHEN error IS NOT NULL THEN 400 ELSE 202 END AS http_status,
  CASE WHEN error IS NOT NULL THEN 'rejected' WHEN {_REASON_SQL} IS NOT NULL THEN 'filtered' ELSE 'accepted' END AS status, error,
  CASE WHEN error IS NULL THEN 'e' || n END AS event_id, CASE WHEN error IS NULL THEN received_at END AS event_time FROM req""")
def normalize_status(spark, sf_dir):
    """All requests through the collect path: decode, normalize, filter, status."""
    df = _clients(spark, sf_dir).transform(normalize).transform(filter_traffic(**_INSIDE)).transform(with_status)
    ok = F.col("error").isNull()
    return df.select("n", "http_status", "status", "error", F.when(ok, F.col("event_id")).alias("event_id"), F.when(ok, F.col("event_time")).alias("event_time"))


def _refused(make) -> str | None:
    try:
        make()
    except (InvalidEventQuery, ValueError) as e:
        return str(e)
    return None


def _guarded(spec) -> str | None:
    return _refused(lambda: _BUILDER._guard(spec))


_E = EventListQuery
_K = lambda **more: PropertyFilter(**({"scope": "event", "name": "k", "value_type": "number", "op": "eq", "value": 1} | more))
_GUARDS = (
    (_E(**_SOURCE), None), (_E(**_SOURCE, offset=-1), "invalid event query: offset must be non-negative"), (
        _E(**_SOURCE, since=_DAY, until=_DAY), "invalid event query: from must be before to",
    ),
    (_E(**_SOURCE, since=datetime(2024, 1, 1, 2, tzinfo=_EAST), until=_DAY - timedelta(hours=7)), None), (
        _E(**_SOURCE, since=datetime(2024, 1, 1, 2, tzinfo=_EAST), until=_DAY - timedelta(hours=7, minutes=30)), "invalid event query: from must be before to",
    ),
    (
        _E(**_SOURCE, filters=(EventFilter("source_type", "eq", "web"),) * 21), "invalid event query: too many event filters: 21 > 20",
    ), (_E(**_SOURCE, filters=(EventFilter("source_type", "eq", "web"),) * 20), None),
    (
        _E(**_SOURCE, property_filters=(_K(),)), "invalid event query: property filters require bounded from and to",
    ), (_E(**_SOURCE, since=_DAY, until=_DAY + timedelta(days=7), property_filters=(_K(),)), None),
    (
        _E(**_SOURCE, since=_DAY, until=_DAY + timedelta(days=7, seconds=1), property_filters=(_K(),)),
        "invalid event query: property-filter time window 168h0m1s exceeds max 168h0m0s",
    ),
    (_E(tenant_id="t"), "invalid event query: project_id is required"), (
        _E(**_SOURCE, filters=(EventFilter("path", "eq", "x"),)), 'invalid event query: unsupported events filter field "path"',
    ),
    (
        _E(**_SOURCE, filters=(EventFilter("source_type", "gt", "x"),)), 'invalid event query: unsupported events filter operator "gt"',
    ), (_E(**_SOURCE, filters=(EventFilter("source_type", "eq", ""),)), "invalid event query: event filter 0 value is required"),
    (_E(**_SOURCE, **_WEEK, property_filters=(_K(name=" "),)), "invalid event query: property filter 0 property name is required"), (
        _E(**_SOURCE, **_WEEK, property_filters=(_K(scope="page"),)), 'invalid event query: property filter 0 unsupported property scope "page"',
    ),
    (
        _E(**_SOURCE, **_WEEK, property_filters=(_K(name="secret"),)), "invalid event query: property filter 0 event.secret is not allowlisted",
    ), (_E(**_SOURCE, **_WEEK, property_filters=(_K(name=" k "),)), None),
    (_E(**_SOURCE, **_WEEK, property_filters=(_K(name="secret"),), allowed_properties=(("event", " secret "), ("page", "x"))), None), (
        _E(**_SOURCE, **_WEEK, property_filters=(_K(value_type="null", op="neq"),)), "invalid event query: property filter 0 null only supports eq",
    ),
    (
        _E(**_SOURCE, **_WEEK, property_filters=(_K(value_type="date"),)), 'invalid event query: property filter 0 unsupported property value type "date"',
    ), (_E(**_SOURCE, **_WEEK, property_filters=(_K(value="1"),)), 'invalid event query: property filter 0 value is no "number"'),
    (
        _E(**_SOURCE, **_WEEK, property_filters=(_K(value=None),)), 'invalid event query: property filter 0 value is no "number"',
    ), (_E(**_SOURCE, **_WEEK, property_filters=(_K(value=True),)), 'invalid event query: property filter 0 value is no "number"'),
    (
        _E(**_SOURCE, sort_field="visit_id"), 'invalid event query: unsupported events sort field "visit_id"',
    ), (_E(**_SOURCE, sort_direction="up"), 'invalid event query: unsupported events sort direction "up"'),
)


@_register("SELECT * FROM (VALUES " + ", ".join(f"({i}, " + ("NULL::VARCHAR" if e is None else "'" + e.replace("'", "''") + "'") + ")" for i, (_, e) in enumerate(_GUARDS)) + ") v(n, error)")
def query_guards(spark, sf_dir):
    """What the guards say to a list of queries; no table is read, as the reference's guards read none."""
    return spark.createDataFrame([(i, _guarded(spec)) for i, (spec, _) in enumerate(_GUARDS)], "n int, error string")


@_register(f"WITH {_ENV} SELECT tenant_id, project_id, source_id, event_id, event_time FROM env")
def dedup_ingest(spark, sf_dir):
    """Each message comes twice; one event of each stays."""
    sent = _sent(spark, sf_dir)
    return first_of_each(decode(sent.unionByName(sent)).where("decode_error IS NULL")).select(*EVENT_KEY, "event_time")


_MSG = fixtures.MESSAGES_SQL


@_register(f"WITH {_ENV}, {_MSG} SELECT n, error FROM msg WHERE error IS NOT NULL")
def dlq_rows(spark, sf_dir):
    """All messages, of which more than half have a defect: those that can't be ingested, and why."""
    sent = fixtures.twisted_messages(messages(fixtures.envelopes(spark, sf_dir)))
    return decode(sent).where("decode_error IS NOT NULL").select("n", F.col("decode_error").alias("error"))


def _half():
    return F.pmod(F.xxhash64("value"), F.lit(2)) == 0


def _sent(spark, sf_dir):
    """The fixture's messages as they lie in a landing folder, written once a session."""

    def make(store: EventStore) -> None:
        envelopes = fixtures.envelopes(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
        messages(envelopes).write.parquet(store.path("landing"))

    return spark.read.parquet(_once(spark, (sf_dir, "landing"), make).path("landing"))


_REPLAYED_SQL = f"WITH {_ENV} SELECT e.event_id, e.source_id, e.event_time, p.n AS n_properties FROM env e JOIN (SELECT source_id, event_id, count(*)::BIGINT AS n FROM prop GROUP BY ALL) p USING (source_id, event_id)"


@_register(_REPLAYED_SQL)
def replay_ingest(spark, sf_dir):
    """Two batches, the first replayed and sent again as a third: the store holds each event once."""
    store, sent = _new_store(spark), _sent(spark, sf_dir)
    ingest = Ingest(store)
    for batch, df in ((0, sent.where(_half())), (0, sent.where(_half())), (1, sent.where(~_half())), (2, sent.where(_half()))):
        ingest(df, batch)
    n = store.properties().groupBy("source_id", "event_id").agg(F.count(F.lit(1)).alias("n_properties"))
    return store.events().join(n, ["source_id", "event_id"]).select("event_id", "source_id", "event_time", "n_properties")


def _number(c="event_id"):
    return F.col(c).cast("long")


def _ingested(spark, sf_dir):
    """Odd events, then all, then all again, with a store that is down in the first batch for ids divisible by three; compacted in between."""

    def make(store: EventStore) -> None:
        sent = _sent(spark, sf_dir).withColumn("n", F.get_json_object("value", "$.id").cast("long"))
        at = datetime(2024, 6, 1)
        down = _Down(store.spark, store.root)
        Ingest(down, max_attempts=2, backoff_s=0, now=lambda: at)(sent.where("n % 6 = 3"), 0)
        results = []
        for batch, df in ((1, sent.where("n % 2 = 1")), (2, sent), (3, sent)):
            ingest = Ingest(store, now=lambda batch=batch: at + timedelta(hours=batch))
            ingest(df, batch)
            results.append(ingest.last)
            for table in ("events", "properties", "event_status", "property_status", "dead_letters"):
                store.compact(table, batch - 1)
                store.vacuum(table)
        columns = [f.name for f in dataclasses.fields(results[0])]
        spark.createDataFrame([dataclasses.astuple(r) for r in results], ", ".join(f"{c} long" for c in columns)).write.parquet(store.path("results"))

    return _once(spark, (sf_dir, "ingested"), make)


@dataclasses.dataclass(frozen=True)
class _Down(EventStore):
    """A store that takes no events."""

    def append_events(self, events: DataFrame, batch_id: int) -> None:
        raise OSError("store is down")


@_register(f"""WITH {_ENV} SELECT event_id, 'inserted' AS status, CASE WHEN event_id::BIGINT % 6 = 3 THEN 2 ELSE 1 END AS attempt, '' AS last_error,
  TIMESTAMP '2024-06-01' + to_hours(CASE WHEN event_id::BIGINT % 6 = 3 THEN 0 WHEN event_id::BIGINT % 2 = 1 THEN 1 ELSE 2 END) AS created_at,
  TIMESTAMP '2024-06-01' + to_hours(CASE WHEN event_id::BIGINT % 2 = 1 THEN 1 ELSE 2 END) AS updated_at FROM env""")
def status_after_failure(spark, sf_dir):
    """Statuses after a batch that failed, its events sent again, and duplicates."""
    return _ingested(spark, sf_dir).status("event_status").select("event_id", "status", "attempt", "last_error", "created_at", "updated_at")


@_register(_REPLAYED_SQL)
def events_after_failure(spark, sf_dir):
    """The compacted store holds each event once, whatever failed on the way."""
    store = _ingested(spark, sf_dir)
    n = store.properties().groupBy("source_id", "event_id").agg(F.count(F.lit(1)).alias("n_properties"))
    return store.events().join(n, ["source_id", "event_id"]).select("event_id", "source_id", "event_time", "n_properties")


@_register(f"WITH {_ENV} SELECT event_id, 2 AS attempt, 'store is down' AS error, TIMESTAMP '2024-06-01' AS failed_at, 'tenant_1:project_1:' || source_id AS original_key FROM env WHERE event_id::BIGINT % 6 = 3")
def dead_letters_of_failed_write(spark, sf_dir):
    id = F.get_json_object("envelope", "$.id").alias("event_id")
    return _ingested(spark, sf_dir).dead_letters().select(id, "attempt", "error", "failed_at", "original_key")


@_register(f"""WITH {_ENV}, n AS (SELECT count(*)::BIGINT AS n, (count(*) FILTER (event_id::BIGINT % 2 = 1))::BIGINT AS odd FROM env), p AS (SELECT count(*)::BIGINT AS n, (count(*) FILTER (event_id::BIGINT % 2 = 1))::BIGINT AS odd FROM prop)
SELECT b::BIGINT AS batch_id, CASE b WHEN 1 THEN n.odd ELSE n.n END AS consumed, CASE b WHEN 1 THEN n.odd WHEN 2 THEN n.n - n.odd ELSE 0 END AS inserted,
  CASE b WHEN 1 THEN 0 WHEN 2 THEN n.odd ELSE n.n END AS duplicates, CASE b WHEN 1 THEN p.odd WHEN 2 THEN p.n - p.odd ELSE 0 END AS property_rows, 0::BIGINT AS dead_letters FROM n, p, range(1, 4) r(b)""")
def write_counts(spark, sf_dir):
    """What each batch reported."""
    return spark.read.parquet(_ingested(spark, sf_dir).path("results")).select("batch_id", "consumed", "inserted", "duplicates", "property_rows", "dead_letters")


@_register(f"{_CATALOG_SQL} GROUP BY ALL")
def catalog_after_replays(spark, sf_dir):
    """The catalog that four batches merged, two of them of duplicates."""
    return _ingested(spark, sf_dir).catalog()


@_register(f"{_CATALOG_SQL} GROUP BY ALL")
def catalog_merged(spark, sf_dir):
    """Catalogs of parts, merged in any order and more than once, are that of the whole."""
    rows = flatten(fixtures.envelopes(spark, sf_dir))
    parts = [build_catalog(rows.where(_number() % 3 == i)) for i in range(3)]
    return merge_catalog(merge_catalog(parts[2], parts[0]), merge_catalog(parts[1], parts[2]))


@_register(f"""WITH {_ENV} SELECT event_id, CASE event_id::BIGINT % 4 WHEN 0 THEN 'skip' WHEN 3 THEN 'new' ELSE 'again' END AS event_claim,
  CASE event_id::BIGINT % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'again' WHEN 2 THEN 'refused' ELSE 'new' END AS property_claim, CASE event_id::BIGINT % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS attempt FROM env""")
def status_claims(spark, sf_dir):
    """Claims of all events, sent twice, on a table where some are inserted, failed or in progress."""
    events = fixtures.envelopes(spark, sf_dir)
    case = lambda *x: F.element_at(F.array(*map(F.lit, x)), (_number() % 4 + 1).cast("int"))
    table = events.where(_number() % 4 < 3).withColumns({"status": case("inserted", "failed", "processing", ""), "attempt": case(1, 2, 3, 0), "last_error": F.lit(""), "created_at": F.col("received_at"), "updated_at": F.col("received_at")})
    table, sent = table.select(*STATUS.fieldNames()), events.unionByName(events)
    first, second = (claims(table, sent, x).select(*EVENT_KEY, F.col("claim").alias(n), "attempt") for x, n in ((EVENT_WRITES, "event_claim"), (PROPERTY_WRITES, "property_claim")))
    return first.join(second.drop("attempt"), list(EVENT_KEY)).select("event_id", "event_claim", "property_claim", "attempt")


def _poison(message: dict) -> None:
    if int(message["event_id"]) % 50 == 7:
        raise RuntimeError(f"no place for {message['event_name']}")


@_register(f"WITH {_ENV} SELECT event_id, event_id::BIGINT % 50 <> 7 AS is_stored, CASE WHEN event_id::BIGINT % 50 = 7 THEN 3 END AS attempt, CASE WHEN event_id::BIGINT % 50 = 7 THEN 'no place for ' || event_name END AS error FROM env")
def dead_letters_after_retries(spark, sf_dir):
    """A handler that fails for some messages, each time: these alone become dead letters."""
    store = _new_store(spark)
    Ingest(store, message_handler=_poison, max_attempts=3, backoff_s=0)(_sent(spark, sf_dir), 0)
    dead = store.dead_letters().select(F.get_json_object("envelope", "$.id").alias("event_id"), F.lit(False).alias("is_stored"), "attempt", "error")
    return store.events().select("event_id", F.lit(True).alias("is_stored"), F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("string").alias("error")).unionByName(dead)
