"""The store's layout, compaction and statuses; attempts, dead letters and counts of ingestion."""

import json
from datetime import UTC, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel import schema as S
from quernel.fixtures import envelopes
from quernel.model import EventListQuery, InvalidEventQuery, PropertyFilter
from quernel.operators.normalize import normalize
from quernel.operators.properties import build_catalog, entry_error, flatten, record_error
from quernel.operators.stages import with_status
from quernel.plans.query import QueryBuilder
from quernel.plans.reader import EventReader
from quernel.sources.bus import dead_letter_messages, publish_dead_files
from quernel.sources.store import SCHEMAS, EventStore
from quernel.streaming.ingest import Ingest, decode, first_of_each
from quernel.streaming.stats import Stats, lag
from tests.test_ingest import batch, message

def ids(df):
    return sorted(r.event_id for r in df.collect())


def test_compaction_changes_no_row(spark, sf, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    events = envelopes(spark, sf)
    for n in range(4):
        part = events.where(F.col("event_id").cast("long") % 4 == n)
        store.append_events(part, n)
        store.append_properties(flatten(part), n)
        if n in (1, 2):  # the next batch may follow a compaction at once
            store.compact("events", n - 1)
            store.compact("events", n - 1)  # once more does nothing
    before = events.select(*S.EVENT_COLUMNS)
    assert store.events().select(*S.EVENT_COLUMNS).exceptAll(before).isEmpty() and store.events().count() == before.count()
    store.vacuum("events")
    store.compact("properties", 3)
    store.vacuum("properties")
    assert store.events().count() == before.count() and store.properties().count() == flatten(events).count()
    assert not list((tmp_path / "s/events/live").glob("*/*/batch_id=0")) and list((tmp_path / "s/events/live").glob("*/*/batch_id=3"))
    store.append_events(events.where("false"), 9)  # an empty batch
    assert store.events().count() == before.count()


def test_a_query_opens_its_days_only(spark, sf, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    store.append_events(envelopes(spark, sf), 0)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    query = EventListQuery("tenant_1", "project_1", "source_1", since=datetime(2024, 1, 2), until=datetime(2024, 1, 4))
    frame = EventReader(store).events(query).frame
    plan = frame._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.split("\n") if "PartitionFilters" in line)
    assert "day" in filters.split("PartitionFilters")[1].split("PushedFilters")[0] and "route" in filters
    assert 0 < frame.count() <= 100


def test_statuses_of_the_keys_asked_for(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    Ingest(store)(batch(spark, message("a"), message("b")), 0)
    Ingest(store)(batch(spark, message("b"), message("c")), 1)
    asked = spark.createDataFrame([("t", "p", "s", "b"), ("t", "p", "s", "z")], "tenant_id string, project_id string, source_id string, event_id string")
    assert [(r.event_id, r.status, r.attempt) for r in store.status("event_status", asked).collect()] == [("b", "inserted", 1)]
    assert ids(store.status("event_status")) == ["a", "b", "c"] and ids(store.status("event_status", before=1)) == ["a", "b"]
    store.create()
    store.create()
    assert all((tmp_path / "s" / t).is_dir() for t in SCHEMAS)


def test_failed_writes_roll_back_and_come_again(spark, tmp_path, monkeypatch):
    store, down = EventStore(spark, str(tmp_path / "s")), []

    def append_events(self, events, batch_id):
        down.append(batch_id)
        raise OSError("down " + "x" * 5000)

    with monkeypatch.context() as m:
        m.setattr(EventStore, "append_events", append_events)
        ingest = Ingest(store, max_attempts=3, backoff_s=0)
        ingest(batch(spark, message("a", properties={"k": 1}), message("b")), 0)
    assert down == [0, 0, 0] and (ingest.last.failures, ingest.last.retries, ingest.last.dead_letters, ingest.last.inserted) == (3, 2, 2, 0)
    rows = store.status("event_status").collect()
    assert {(r.status, r.attempt, len(r.last_error)) for r in rows} == {("failed", 1, 2048)}
    # Nothing of a failed event is indexed.
    assert store.properties().count() == store.status("property_status").count() == 0
    Ingest(store)(batch(spark, message("a", properties={"k": 1})), 1)
    now = {r.event_id: (r.status, r.attempt) for r in store.status("event_status").collect()}
    assert now == {"a": ("inserted", 2), "b": ("failed", 1)} and ids(store.events()) == ["a"] and store.properties().count() == 1


def test_properties_in_progress_are_not_claimed_again(spark, tmp_path, monkeypatch):
    store = EventStore(spark, str(tmp_path / "s"))

    def broken(self, rows, batch_id):
        raise KeyboardInterrupt  # the process ends here

    with monkeypatch.context() as m:
        m.setattr(EventStore, "append_properties", broken)
        with pytest.raises(KeyboardInterrupt):
            Ingest(store)(batch(spark, message("a", properties={"k": 1})), 0)
    ingest = Ingest(store, max_attempts=2)
    ingest(batch(spark, message("a", properties={"k": 1})), 1)  # not a replay: another batch
    dead = store.dead_letters().collect()
    assert [(r.attempt, r.error) for r in dead] == [(2, 'property indexing status "processing" is not reclaimable')]
    assert ids(store.events()) == ["a"] and store.properties().count() == 0
    ingest(batch(spark, message("a", properties={"k": 1})), 0)  # the replay repairs it
    assert store.properties().count() == 1


def test_events_in_progress_are_not_written_twice(spark, tmp_path, monkeypatch):
    store, real = EventStore(spark, str(tmp_path / "s")), EventStore.append_events

    def broken(self, events, batch_id):
        real(self, events, batch_id)
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(EventStore, "append_events", broken)
        with pytest.raises(KeyboardInterrupt):
            Ingest(store)(batch(spark, message("a")), 0)
    Ingest(store)(batch(spark, message("a")), 1)
    assert ids(store.events()) == ["a"]
    assert [(r.status, r.attempt) for r in store.status("event_status").collect()] == [("inserted", 2)]


def flaky(m):
    import pathlib

    seen = pathlib.Path(m["source"]) / m["event_id"]
    tries = int(seen.read_text()) if seen.exists() else 0
    seen.write_text(str(tries + 1))
    if tries < {"a": 0, "b": 2}.get(m["event_id"], 99):
        raise ValueError(f"try {tries}")


def test_each_message_has_its_own_attempts(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    ingest = Ingest(store, message_handler=flaky, max_attempts=3, backoff_s=0, dead_letter_sink=lambda df: publish_dead_files(df, str(tmp_path / "dead")))
    ingest(batch(spark, *(message(i, source=str(tmp_path)) for i in "abc"), "broken"), 0)
    assert ids(store.events()) == ["a", "b"]
    assert sorted((r.attempt, r.error, r.raw) for r in store.dead_letters().collect()) == [(1, "malformed payload", "broken"), (3, "try 2", None)]
    assert (ingest.last.consumed, ingest.last.malformed, ingest.last.inserted, ingest.last.dead_letters, ingest.last.retries, ingest.last.failures) == (4, 1, 2, 2, 4, 5)
    sent = [json.loads(json.loads(r.value)["value"]) for r in spark.read.text(str(tmp_path / "dead")).collect()]
    by = {x["error"]: x for x in sent}
    assert by["try 2"]["envelope"]["id"] == "c" and by["malformed payload"]["raw"] == "YnJva2Vu" and by["try 2"]["consumer_group"] == "ingestion"
    assert Ingest(store).stats == Stats() and ingest.stats.dead_letters == 2


def test_without_a_last_attempt_the_stream_stops(spark, tmp_path):
    def handler(df, n):
        raise RuntimeError("down")

    store = EventStore(spark, str(tmp_path / "s"))
    with pytest.raises(RuntimeError, match="down"):
        Ingest(store, handler=handler, max_attempts=0)(batch(spark, message("a")), 0)
    assert store.dead_letters().count() == store.events().count() == 0
    for options in ({"consumer_group": ""}, {"consumer_id": ""}):
        with pytest.raises(ValueError, match="is required"):
            Ingest(store, **options)


def test_dead_letters_go_under_their_own_key(spark):
    rows = spark.createDataFrame([('{"id":"a"}', None, "t", 1, 5, "k", "g", "c", 3, "e", datetime(2024, 1, 1))], S.DEAD_LETTERS)
    r = dead_letter_messages(rows).first()
    assert r.key == "k" and json.loads(r.value) == {
        "envelope": {"id": "a"}, "original_topic": "t", "original_partition": 1, "original_offset": 5, "original_key": "k", "consumer_group": "g",
        "consumer_id": "c", "attempt": 3, "error": "e", "failed_at": "2024-01-01T00:00:00Z",
    }


def test_copies_without_offsets_are_settled_by_receipt(spark):
    first = message("a", source="early", received_at="2026-05-01T00:00:00Z")
    sent = batch(spark, message("a", source="z"), first, message("a", source="b"))
    for df in (sent, sent.repartition(3)):
        assert [r.source for r in first_of_each(decode(df)).collect()] == ["early"]


def test_lag():
    progress = {"sources": [{"latestOffset": '{"t":{"0":10,"1":4}}', "endOffset": '{"t":{"0":7,"1":9}}'}, {"latestOffset": None, "endOffset": None}, {"latestOffset": '{"logOffset":3}', "endOffset": '{"logOffset":1}'}]}
    assert lag(progress) == {"t:0": 3, "t:1": 0} and lag(None) == {}


def test_statuses_of_methods_and_publishing(spark):
    ok = '{"id":"e","tenant_id":"t","project_id":"p","source_id":"s","source_type":"web","event_name":"n","distinct_id":"v"}'
    rows = [(ok, 405, None, None), (ok, None, "broker down", None), (ok, None, "broker down", "internal ip"), ("x", None, "broker down", None), (ok, None, None, None)]
    df = spark.createDataFrame(
        rows, "raw string, method_status int, publish_error string, filter_reason string",
    ).withColumn("received_at", F.lit("2026-05-01").cast("timestamp_ntz"))
    got = {(r.http_status, r.status, r.error) for r in df.transform(normalize).transform(with_status).collect()}
    assert got == {
        (405, "rejected", "method not allowed"), (500, "failed", "broker down"), (202, "filtered", None), (400, "rejected", "invalid collect payload"),
        (202, "accepted", None),
    }


def test_bounds_are_utc(spark):
    east = timezone(timedelta(hours=2))
    q = EventListQuery("t", "p", "s", since=datetime(2024, 1, 1, 2, tzinfo=east), until=datetime.min)
    assert q.since == datetime(2024, 1, 1) and q.until is None
    assert EventListQuery(since=datetime(2024, 1, 1, tzinfo=UTC)).since == datetime(2024, 1, 1)


@pytest.mark.parametrize("kind, value", [("number", "1"), ("number", None), ("number", True), ("number", float("nan")), ("string", 1), ("bool", 0), ("bool", "true")])
def test_values_fit_their_types(kind, value):
    q = EventListQuery(
        "t", "p", "s", since=datetime(2024, 1, 1), until=datetime(2024, 1, 2), property_filters=(PropertyFilter("event", "k", kind, "eq", value),),
        allowed_properties=(("event", "k"),),
    )
    with pytest.raises(InvalidEventQuery, match="property filter 0 value is no"):
        QueryBuilder()._guard(q)


def test_catalog_rows_are_checked(spark, sf):
    rows = flatten(envelopes(spark, sf))
    assert rows.where(record_error().isNotNull()).isEmpty() and build_catalog(rows).where(entry_error().isNotNull()).isEmpty()
    bad = {"tenant_id": "tenant_id is required", "property_name": "property name is required", "property_type": "property value type is required"}
    for c, why in bad.items():
        assert {r.e for r in rows.limit(3).withColumn(c, F.lit("")).select(record_error().alias("e")).collect()} == {why}
    timeless = rows.limit(1).withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("event_time", "received_at")})
    assert timeless.select(record_error().alias("e")).first().e == "property observed time is required"
    entry = build_catalog(rows).limit(1)
    wrong = {
        "property_scope": ("page", "property scope must be event or user"),
        "property_type": ("date", "property value type must be null, string, number, or bool"), "source_id": ("", "source_id is required"),
    }
    for c, (value, why) in wrong.items():
        assert entry.withColumn(c, F.lit(value)).select(entry_error().alias("e")).first().e == why
    assert entry.withColumn("last_seen_at", F.lit(None).cast("timestamp_ntz")).select(entry_error().alias("e")).first().e == "last_seen_at is required"


def test_ddl_makes_the_table(spark):
    text = S.create_table("events_x", S.EVENTS, S.FOLDERS, S.EVENT_ORDER)
    assert "PARTITIONED BY (route, day)" in text and "SORTED BY (tenant_id, project_id, source_id, event_time, visit_id, event_id)" in text
    spark.sql(text)
    try:
        table = spark.table("events_x")
        assert table.columns == [*S.EVENT_COLUMNS, "route", "day"] and table.schema["day"].dataType == T.DateType()
    finally:
        spark.sql("DROP TABLE events_x")


def test_every_defect_of_a_payload(spark):
    cases = {
        '{"tenant_id":5}': "malformed payload", '{"id":{"a":1}}': "malformed payload", '{"properties":{"a":1,"a":2}}': "malformed payload", '{"properties":{"a":-1e999}}': "malformed payload", '{"event_time":"2024-01-01T00:00:00"}': "malformed payload",
        '{"event_time":"2024-13-01T00:00:00Z"}': "malformed payload", '{"received_at":false}': "malformed payload", "null": "tenant_id is required", "{}": "tenant_id is required", '{"tenant_id":null}': "tenant_id is required", "[{}]": "malformed payload", "{} ,{}": "malformed payload",
    }
    got = {r.value: r.decode_error for r in decode(batch(spark, *cases)).collect()}
    assert got == cases
