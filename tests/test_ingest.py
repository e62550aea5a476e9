import json

import pytest
from pyspark.sql import functions as F

from quernel import schema as S
from quernel.fixtures import envelopes
from quernel.sources.bus import messages, publish_files, read_files
from quernel.sources.store import EventStore
from quernel.streaming import status as G
from quernel.streaming.ingest import Ingest, first_of_each, run


def message(i, **more):
    return json.dumps({"id": i, "tenant_id": "t", "project_id": "p", "source_id": "s", "event_time": "2026-05-01T00:00:00Z", "received_at": "2026-05-01T00:00:01Z"} | more)


def batch(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_missing_tables_are_empty(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "none"))
    assert store.events().count() == store.properties().count() == store.dead_letters().count() == store.catalog().count() == 0


def test_replay_duplicates_and_dead_letters(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    ingest = Ingest(store)
    first = batch(spark, message("a", properties={"k": 1}), message("a", properties={"k": 1}), message("b"), "broken")
    for _ in range(2):
        ingest(first, 0)
    ingest(batch(spark, message("a"), message("c", user_properties={"plan": "free"})), 1)
    assert sorted(r.event_id for r in store.events().collect()) == ["a", "b", "c"]
    assert sorted((r.event_id, r.property_name) for r in store.properties().collect()) == [("a", "k"), ("c", "plan")]
    assert [(r.raw, r.error) for r in store.dead_letters().collect()] == [("broken", "malformed payload")]
    assert store.catalog().count() == 2


def test_missing_properties_are_repaired(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    Ingest(store, index_properties=False, catalog=False)(batch(spark, message("a", properties={"k": 1})), 0)
    Ingest(store)(batch(spark, message("a", properties={"k": 1})), 1)
    assert (store.events().count(), store.properties().count()) == (1, 1)


def test_handler_is_retried_then_dead(spark, tmp_path):
    calls = []

    def handler(df, n):
        calls.append(n)
        if n == 0 and len(calls) < 3 or n == 1:
            raise RuntimeError("down")

    store = EventStore(spark, str(tmp_path / "s"))
    ingest = Ingest(store, handler=handler, max_attempts=3, backoff_s=0)
    ingest(batch(spark, message("a")), 0)
    ingest(batch(spark, message("b")), 1)
    assert calls == [0, 0, 0, 1, 1, 1]
    assert [r.event_id for r in store.events().collect()] == ["a"]
    dead = store.dead_letters().first()
    assert (dead.attempt, dead.error, json.loads(dead.envelope)["id"]) == (3, "down", "b")


def test_earliest_offset_wins(spark):
    df = spark.createDataFrame(
        [("t", "p", "s", "e", 1, 5, "late"), ("t", "p", "s", "e", 1, 2, "early")],
        "tenant_id string, project_id string, source_id string, event_id string, partition int, offset long, source string",
    )
    assert [r.source for r in first_of_each(df).collect()] == ["early"]


def test_stream_restarts_where_it_stopped(spark, sf, tmp_path):
    land, store = str(tmp_path / "land"), EventStore(spark, str(tmp_path / "s"))
    events = envelopes(spark, sf).limit(60)
    events.write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    publish_files(events, land)
    for _ in range(2):
        q = run(read_files(spark, land, files_per_trigger=1), Ingest(store), str(tmp_path / "cp"))
        q.awaitTermination()
        publish_files(events, land)  # everything once more
    assert store.events().count() == 60
    assert store.events().select("event_id", "event_time", "session_id").exceptAll(events.select("event_id", "event_time", "session_id")).isEmpty()
    assert messages(events).where("key like 'tenant_1:project_1:source_%'").count() == 60


def _status(spark, rows):
    now = F.lit("2026-05-01 00:00:00").cast("timestamp_ntz")
    df = spark.createDataFrame(
        [("t", "p", "s", i, st, a) for i, st, a in rows], "tenant_id string, project_id string, source_id string, event_id string, status string, attempt int",
    )
    return df.withColumns({"last_error": F.lit("old"), "received_at": now, "created_at": now, "updated_at": now}).select(*S.STATUS.fieldNames()), now


def test_status_transitions(spark):
    table, now = _status(spark, [("done", "inserted", 1), ("bad", "failed", 2), ("open", "processing", 1)])
    incoming = spark.createDataFrame(
        [("t", "p", "s", i) for i in ("done", "bad", "open", "new")], "tenant_id string, project_id string, source_id string, event_id string",
    ).withColumn("received_at", now)
    claimed = G.claims(table, incoming)
    assert {r.event_id: r.claim for r in claimed.collect()} == {"done": "skip", "bad": "again", "open": "again", "new": "new"}
    assert {r.event_id: r.claim for r in G.claims(table, incoming, G.PROPERTY_WRITES).collect()} == {"done": "skip", "bad": "again", "open": "refused", "new": "new"}
    begun = G.started(claimed, now)
    assert {r.event_id: (r.status, r.attempt, r.last_error) for r in begun.collect()} == {
        "bad": ("processing", 3, ""), "open": ("processing", 2, ""), "new": ("processing", 1, ""),
    }
    table = G.applied(table, begun)
    assert {r.event_id: (r.status, r.attempt) for r in table.collect()} == {"done": ("inserted", 1), "bad": ("processing", 3), "open": ("processing", 2), "new": ("processing", 1)}
    table = G.applied(table, G.committed(table.where("event_id = 'bad'"), now))
    back = {r.event_id: r for r in G.applied(table, G.rolled_back(table.where("event_id IN ('bad', 'new')"), "x" * 3000, now)).collect()}
    assert back["bad"].status == "inserted" and back["bad"].last_error == "" and back["new"].status == "failed" and len(back["new"].last_error) == 2048
    refused = G.claims(table, incoming, G.PROPERTY_WRITES).where("claim = 'refused'").select("event_id", G.refusal().alias("why"))
    assert {r.why for r in refused.collect()} == {'property indexing status "processing" is not reclaimable'}


def test_tables_and_names():
    assert S.create_table("events_a", S.EVENTS).count("`") == 2 * (1 + len(S.EVENT_COLUMNS)) and S.property_table("events_a") == "events_a_properties"
    for bad in ("", "Events", "a-b", "a;drop", "1a"):
        with pytest.raises(ValueError):
            S.create_table(bad, S.EVENTS)
    assert S.route_of("t", "p", "s").startswith("events_e3b98a4da31a_")
    with pytest.raises(ValueError, match="project_id is required"):
        S.route_of("t", "", "s")
