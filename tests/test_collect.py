from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from quernel.functions import text as X
from quernel.operators.normalize import normalize, valid_event_name
from quernel.operators.properties import flatten, list_catalog, unflattenable
from quernel.operators.stages import chain, enrich, filter_traffic, session_ids, visit_ids, with_status, without_client
from quernel.model import CatalogQuery
from quernel.sources.bus import KafkaOptions, collect_landing, event_key

OK = '{"id":" evt_1\\n","tenant_id":"t","project_id":"p","source_id":"s","source_type":"web","event_name":"pageview","distinct_id":"v"%s}'


def one(spark, raw, **columns):
    df = spark.createDataFrame([(raw,)], "raw string").withColumn("received_at", F.lit("2026-05-01 10:00:00").cast("timestamp_ntz"))
    return df.withColumns({k: F.lit(v) for k, v in columns.items()}).transform(normalize)


def test_normalize_trims_and_defaults(spark):
    r = one(spark, OK % "").first()
    assert (r.event_id, r.error_field, r.properties, r.session_id, r.event_time) == ("evt_1", None, "{}", "", r.received_at)


def test_event_time_is_utc_in_any_session_zone(spark):
    r = one(spark, OK % ',"event_time":"2026-05-01T18:04:00+08:00"').first()
    assert str(r.event_time) == "2026-05-01 10:04:00" and r.error_field is None


def test_wrong_types_are_malformed(spark):
    for raw in ("{", "5", '{"id":1}', OK % ',"properties":[1]', OK % ',"event_time":"yesterday"', None):
        assert one(spark, raw).first().malformed, raw


@pytest.mark.parametrize("name", ["1st_step", "button:click", "a.b-c", "A"])
def test_event_names_accepted(spark, name):
    assert spark.range(1).select(valid_event_name(F.lit(name)).alias("x")).first().x is None


@pytest.mark.parametrize("name", ["", "_pageview", "check out", "/x", "a\n", "é", "x" * 129])
def test_event_names_refused(spark, name):
    assert spark.range(1).select(valid_event_name(F.lit(name)).alias("x")).first().x.startswith("event_name: ")


def test_stages(spark):
    ua = "Mozilla/5.0 (Windows NT 10.0) Chrome/1.0 Safari/1"
    df = one(spark, OK % ',"properties":{"client.os":"mine"}', user_agent=ua, ip="203.0.113.1", referrer="")
    out = df.transform(chain(session_ids("salt", fingerprint=True), None, visit_ids("salt"), enrich(user_agent=True, referrer=True, ip_salt="s", families=True, geo=lambda d: {"country": F.lit("NZ"), "region": F.lit("")}), filter_traffic(), with_status, without_client))
    r = out.first()
    assert r.session_id.startswith("ses_") and len(r.session_id) == 36 and r.visit_id.startswith("vis_")
    import json

    bag = json.loads(r.properties)
    assert bag["client.os"] == "mine" and bag["client.browser"] == "Chrome" and bag["client.device"] == "desktop" and bag["geo.country"] == "NZ"
    assert "geo.region" not in bag and "client.referrer" not in bag and bag["client.ip_hash"].startswith("ip_") and "ip" not in out.columns
    assert r.status == "accepted" and r.http_status == 202


def test_full_bag_takes_no_more(spark):
    bag = ",".join(f'"k{i}":{i}' for i in range(63))
    r = one(spark, OK % f',"properties":{{{bag}}}', user_agent="x", ip="1.2.3.4").transform(enrich(user_agent=True, ip_salt="s")).first()
    assert '"client.user_agent":"x"' in r.properties and "ip_hash" not in r.properties


def test_quotes_in_values_survive(spark):
    r = one(spark, OK % "", user_agent='a"b\\c').transform(enrich(user_agent=True)).first()
    import json

    assert json.loads(r.properties) == {"client.user_agent": 'a"b\\c'}


def test_configuration_errors():
    for bad in (
        lambda: session_ids(""), lambda: visit_ids("s", timedelta(seconds=59)), lambda: enrich(ip_salt=""), lambda: X.internal_ip(F.lit(""), cidrs=("x",)),
        lambda: X.internal_ip(F.lit(""), ips=("x",)),
    ):
        with pytest.raises(ValueError):
            bad()


def test_buckets_count_from_year_one(spark):
    t = F.lit("2026-05-01 10:17:00").cast("timestamp_ntz")
    got = spark.range(1).select(*(X.bucket_start(t, s).alias(f"b{s}") for s in (420, 604800, 1800))).first()
    e = 1777630620
    assert list(got) == [(e + 62135596800) // s * s - 62135596800 for s in (420, 604800, 1800)]


def test_addresses(spark):
    rows = [("203.0.113.1",), ("10.0.0.1:80",), ("[2001:DB8::1]:443",), ("x",), (None,)]
    assert [r.c for r in spark.createDataFrame(rows, "x string").select(X.canonical_ip("x").alias("c")).collect()] == ["203.0.113.1", "10.0.0.1", "2001:db8::1", "", ""]


def test_landing_trusts_headers_only_when_told(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"raw":"{}","method":"GET","forwarded_for":"203.0.113.10, 10.0.0.1","peer":"192.0.2.1:99","received_at":"2026-05-01T00:00:00"}\n')
    assert collect_landing(spark, str(tmp_path)).first().ip == "192.0.2.1"
    r = collect_landing(spark, str(tmp_path), trust_proxy=True).first()
    assert (r.ip, r.method_status) == ("203.0.113.10", 405)


def test_cut_bytes_keeps_characters_whole(spark):
    assert spark.range(1).select(X.cut_bytes(F.lit("é" * 5), 5).alias("x")).first().x == "éé"


def test_flatten_order_and_types(spark):
    cols = "event_id tenant_id project_id source_id source_type event_name distinct_id session_id visit_id".split()
    df = spark.createDataFrame(
        [("e", '{"score":42.5,"button":"hero","beta":true,"n":null}', '{"plan":"free"}'), ("f", "{}", "{}"), ("g", '{"a":{"b":1}}', "{}")],
        "event_id string, properties string, user_properties string",
    )
    df = df.withColumns({c: F.lit("x") for c in cols[1:]} | {c: F.lit("2026-05-01 00:00:00").cast("timestamp_ntz") for c in ("event_time", "received_at")} | {"source": F.lit("")})
    assert [r[0] for r in df.select(unflattenable()).collect()] == [None, None, "property event.a has unsupported value type"]
    rows = flatten(df.where("event_id <> 'g'")).orderBy("property_scope", "property_name").collect()
    assert [(r.property_scope, r.property_name, r.property_type, r.string_value, r.number_value, r.bool_value) for r in rows] == [
        ("event", "beta", "bool", "", 0.0, True), ("event", "button", "string", "hero", 0.0, False), ("event", "n", "null", "", 0.0, False),
        ("event", "score", "number", "", 42.5, False), ("user", "plan", "string", "free", 0.0, False),
    ]


def test_catalog_queries_are_checked():
    for bad in (CatalogQuery("", "p", "s"), CatalogQuery("t", "p", "s", scope="x"), CatalogQuery("t", "p", "s", limit=-1)):
        with pytest.raises(ValueError):
            list_catalog(None, bad)


def test_event_key(spark):
    df = spark.createDataFrame(
        [("t", "p", "s", "e", "n"), ("", "", "", "e", "n"), ("", "", "", "", "n")],
        "tenant_id string, project_id string, source_id string, event_id string, event_name string",
    )
    assert [r[0] for r in df.select(event_key()).collect()] == ["t:p:s", "e", "n"]


def test_kafka_options():
    o = KafkaOptions((" a:1 ", ""), idempotent=True, sasl=True, sasl_username="u", sasl_password='p"x')
    assert o.writing()["kafka.max.in.flight.requests.per.connection"] == "1" and o.reading()["startingOffsets"] == "earliest"
    assert r"password=\"p\\\"x" not in repr(o) and 'p"x' not in repr(o) and "PLAIN" in o.writing(dead=True)["kafka.sasl.mechanism"]
    for bad in (
        {"brokers": ()}, {"acks": "some"}, {"retries": -1}, {"idempotent": True, "acks": "leader"}, {"idempotent": True, "retries": 0}, {"sasl": True},
        {"sasl": True, "sasl_username": "u"}, {"sasl": True, "sasl_mechanism": "scram"}, {"linger_ms": -1},
    ):
        with pytest.raises(ValueError):
            KafkaOptions(**({"brokers": ("a",)} | bad))
