"""Envelopes made from the driver's ``events`` table, and the reader benchmark's generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators.payload import cut
from quernel.operators.stages import chain, session_ids, visit_ids
from quernel.schema import EVENT_COLUMNS, PROPERTIES

SALT = "fixture-salt"


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table of the store, made from raw rows."""
    k = F.get_json_object("props", "$.k").cast("long")
    even = F.when(k % 2 == 0, "true").otherwise("false")
    bag = F.concat(F.lit('{"k":'), k, F.lit(',"tag":"g'), k % 5, F.lit('","even":'), even, F.when(k % 7 == 0, ',"opt":null').otherwise(""), F.lit("}"))
    user = F.concat(F.lit('{"score":'), F.floor(F.col("value") * 100).cast("long"), F.lit("}"))
    ms = cut(F.col("ts").cast("timestamp_ntz"))
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").cast("string").alias("event_id"), F.lit("tenant_1").alias("tenant_id"), F.lit("project_1").alias("project_id"), F.concat(F.lit("source_"), F.col("user_id") % 3).alias("source_id"),
        F.when(F.col("user_id") % 2 == 0, "web").otherwise("server").alias("source_type"), F.col("event_type").alias("event_name"), F.concat(F.lit("visitor_"), "user_id").alias("distinct_id"),
        F.lit("").alias("session_id"), F.lit("").alias("visit_id"), ms.alias("event_time"), (ms + F.expr("INTERVAL 250 MILLISECONDS")).alias("received_at"), bag.alias("properties"), user.alias("user_properties"), F.lit("fixture").alias("source"),
    )
    return raw.transform(chain(session_ids(SALT), visit_ids(SALT))).select(*EVENT_COLUMNS)


def _digest(prefix: str, *parts: str) -> str:
    return f"substr(sha256(concat_ws(chr(0), '{prefix}', '{SALT}', {', '.join(parts)})), 1, 32)"


_BUCKET = "((floor((epoch(event_time) + 62135596800) / 1800) * 1800 - 62135596800)::BIGINT)::VARCHAR"
_K = "json_extract_string(props, '$.k')::BIGINT"
#: The same view as DuckDB CTEs: ``env``, and ``prop`` with its property rows.
ENVELOPES_SQL = f"""e0 AS (
  SELECT event_id::VARCHAR AS event_id, 'tenant_1' AS tenant_id, 'project_1' AS project_id, 'source_' || (user_id % 3) AS source_id,
         CASE WHEN user_id % 2 = 0 THEN 'web' ELSE 'server' END AS source_type, event_type AS event_name, 'visitor_' || user_id AS distinct_id,
         date_trunc('millisecond', ts)::TIMESTAMP AS event_time, {_K} AS k, floor(value * 100)::BIGINT AS score FROM events
), e1 AS (SELECT *, 'ses_' || {_digest("session", "tenant_id", "project_id", "source_id", "distinct_id", _BUCKET)} AS session_id FROM e0
), env AS (
  SELECT event_id, tenant_id, project_id, source_id, source_type, event_name, distinct_id, session_id,
         'vis_' || {_digest("visit", "tenant_id", "project_id", "source_id", "distinct_id", "session_id", _BUCKET)} AS visit_id,
         event_time, event_time + INTERVAL 250 MILLISECOND AS received_at,
         '{{"k":' || k || ',"tag":"g' || (k % 5) || '","even":' || (k % 2 = 0) || CASE WHEN k % 7 = 0 THEN ',"opt":null' ELSE '' END || '}}' AS properties,
         '{{"score":' || score || '}}' AS user_properties, 'fixture' AS source FROM e1
), p0 AS (
  SELECT env.*, 'event' AS property_scope, j.key AS property_name, j.type AS jt, j.value AS jv FROM env, json_each(properties) j
  UNION ALL SELECT env.*, 'user', j.key, j.type, j.value FROM env, json_each(user_properties) j
), prop AS (
  SELECT event_id, tenant_id, project_id, source_id, source_type, event_name, distinct_id, session_id, visit_id, event_time, received_at, source, property_scope, property_name,
         CASE WHEN jt IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN jt = 'VARCHAR' THEN 'string' WHEN jt = 'BOOLEAN' THEN 'bool' ELSE 'null' END AS property_type,
         CASE WHEN jt = 'VARCHAR' THEN json_extract_string(jv, '$') ELSE '' END AS string_value,
         CASE WHEN jt IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN jv::VARCHAR::DOUBLE ELSE 0.0::DOUBLE END AS number_value,
         CASE WHEN jt = 'BOOLEAN' THEN jv::VARCHAR = 'true' ELSE false END AS bool_value FROM p0
)"""

#: User agents of the requests, by id modulo 8.
AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36", "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) CriOS/120.0 Mobile Safari/604.1",
    "Mozilla/5.0 (X11; CrOS x86_64) Firefox/121.0", "Mozilla/5.0 (iPad; OS) EdgiOS/120 Safari/604", "Googlebot/2.1", "", "curl/8 Linux", "HeadlessChrome/120",
)
#: Requests with a twist, by id modulo 64: members after the usual ones, text after the object, and the refusal (None: accepted).
_BAD = "invalid collect payload"
TWISTS = {
    0: ("", " trailing", _BAD), 1: (',"properties":{"a":1e999}', "", _BAD), 2: (',"event_time":"2024-01-01"', "", _BAD), 3: (',"event_time":5', "", _BAD), 4: (',"session_id":7', "", _BAD),
    5: (',"properties":[1]', "", _BAD), 6: (',"properties":{"":1}', "", "properties: contains empty property key"), 7: (
        ',"properties":{"a b":1}', "", "properties.a b: key contains unsupported characters",
    ),
    8: (
        ',"user_properties":{"x":{"y":1}}', "", "user_properties.x: has unsupported value type",
    ), 9: (',"event_time":"<late>"', "", "event_time: too far in the future"), 10: (',"event_time":"<zoned>"', "", None),
    11: ("", "", "method not allowed"), 14: ("", "{}", _BAD), 15: (',"session_id":"-"', "", "session_id: contains unsupported characters"), 16: (',"visit_id":null', "", None),
    17: (
        ',"properties":{' + ",".join(f'"k{i}":{i}' for i in range(65)) + "}", "", "properties: has too many entries",
    ), 18: (',"properties":{"s":"' + "x" * 2049 + '"}', "", "properties.s: string value is too long"),
    19: (',"properties":{"s":"' + "x" * 2048 + '"}', "", None), 20: (',"event_time":"0001-01-01T00:00:00Z"', "", None), 21: ("", ',{"a":1}', _BAD), 22: ("", " \\n", None), 23: (',"event_time":"2024-02-30T00:00:00Z"', "", _BAD),
    24: (',"event_time":"2024-01-01T00:00:00"', "", _BAD), 25: ("", "]", _BAD), 26: ("", "}", _BAD), 27: (',"user_properties":"x"', "", _BAD), 28: (',"source":null', "", None),
}


def _by_id(cases: dict[int, Column], modulo: int, otherwise: Column) -> Column:
    out = otherwise
    for n, value in cases.items():
        out = F.when(F.col("event_id") % modulo == n, value).otherwise(out)
    return out


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landed request for each row of ``events``: its number ``n``, client headers, and JSON of which some is defective."""
    received = cut(F.col("ts").cast("timestamp_ntz"), 1_000_000)
    json_time = lambda t, zone: F.concat(F.replace(t.cast("string"), F.lit(" "), F.lit("T")), F.lit(zone))
    times = {"<late>": json_time(received + F.expr("INTERVAL 1 HOUR"), "Z"), "<zoned>": json_time(received + F.expr("INTERVAL 2 HOURS"), "+02:00")}

    def more(text: str) -> Column:
        for mark, time in times.items():
            if mark in text:
                before, after = text.split(mark)
                return F.concat(F.lit(before), time, F.lit(after))
        return F.lit(text)

    extra, tail = (_by_id({n: more(x[i].replace("\\n", "\n")) for n, x in TWISTS.items()}, 64, F.lit("")) for i in (0, 1))
    usual = F.concat(
        F.lit('{"id":" e'), "event_id", F.lit('\\t","tenant_id":"t","project_id":"p","source_id":"s","source_type":"web","event_name":"'), "event_type", F.lit('","distinct_id":"v'), "user_id", F.lit('"'), extra, F.lit("}"), tail,
    )
    user = F.col("user_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("n"), _by_id({12: F.lit("null"), 13: F.lit("")}, 64, usual).alias("raw"), F.when(F.col("event_id") % 64 == 11, "GET").otherwise("POST").alias("method"),
        _by_id({i: F.lit(f"\t{a} ") for i, a in enumerate(AGENTS)}, 8, F.lit("")).alias("user_agent"), F.lit(None).cast("string").alias("referer"),
        F.when(
            user % 4 == 0, F.concat(F.lit(" 10.1.2."), user % 200, F.lit(":443, 198.51.100.7")),
        ).when(user % 4 == 1, "[2001:DB8:0::2]:80").when(user % 4 == 2, "nonsense").alias("forwarded_for"),
        F.when(user % 8 < 6, F.concat(F.lit("203.0.113."), user % 200)).otherwise(F.lit("300.1.1.1")).alias("real_ip"), F.lit("192.0.2.1:5000").alias("peer"), received.alias("received_at"),
    )


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: The same requests' outcome as DuckDB CTE ``req``: n, agent, ip, error (of the method or the payload), event_time, received_at.
REQUESTS_SQL = f"""req AS (
  SELECT event_id AS n, CASE event_id % 8 {" ".join(f"WHEN {i} THEN {_quoted(a)}" for i, a in enumerate(AGENTS))} END AS agent,
         CASE WHEN user_id % 4 = 0 THEN '10.1.2.' || (user_id % 200) WHEN user_id % 4 = 1 THEN '2001:db8::2' WHEN user_id % 8 < 6 THEN '203.0.113.' || (user_id % 200) ELSE '192.0.2.1' END AS ip,
         CASE event_id % 64 WHEN 12 THEN 'id: is required' WHEN 13 THEN '{_BAD}' {" ".join(f"WHEN {n} THEN {_quoted(x[2])}" for n, x in TWISTS.items() if x[2])} END AS error,
         date_trunc('second', ts)::TIMESTAMP AS received_at FROM events
)"""

#: Messages with a twist, by id modulo 32: a regular expression, what stands in its place, and the error (None: none).
MESSAGE_TWISTS = {
    0: (r"\z", " {}", "malformed payload"), 1: (r"\z", "x", "malformed payload"), 2: ('"tenant_id":"tenant_1"', '"tenant_id":5', "malformed payload"), 3: (
        '"tenant_id":"tenant_1"', '"tenant_id":null', "tenant_id is required",
    ),
    4: ('"event_time":"[^"]*"', '"event_time":"nonsense"', "malformed payload"), 5: ('"event_time":"[^"]*"', '"event_time":5', "malformed payload"), 6: (
        '"event_time":"[^"]*"', '"event_time":"2024-01-01"', "malformed payload",
    ),
    7: ('"k":', '"x":1e999,"k":', "malformed payload"), 8: ('"k":', '"":1,"k":', "property name is required"), 9: (
        '"k":', '"x":[1],"k":', "property event.x has unsupported value type",
    ),
    10: ('"score":', '"":0,"score":', "property name is required"), 11: (
        '"event_time":"[^"]*","received_at":"[^"]*"', '"event_time":null', "property observed time is required",
    ), 12: ('"id":"[^"]*"', '"id":""', "event_id is required"),
    13: (
        '"user_properties":', '"user_properties":7,"was":', "malformed payload",
    ), 14: (r"\A", "[", "malformed payload"), 15: (r"\z", "\n\t", None), 16: ('"event_time":"[^"]*"', '"event_time":null', None),
    17: ('"id":"[^"]*"', '"event":"gone"', "event_id is required"), 18: ('"score":', '"y":{"a":1},"score":', "property user.y has unsupported value type"),
}


def twisted_messages(sent: DataFrame) -> DataFrame:
    """Messages of ``envelopes`` with their number ``n``, some defective."""
    n, value = F.get_json_object("value", "$.id").cast("long"), F.col("value")
    df = sent.withColumn("n", n)
    for i, (pattern, put, _) in MESSAGE_TWISTS.items():
        value = F.when(F.col("n") % 32 == i, F.regexp_replace("value", pattern, put)).otherwise(value)
    return df.withColumn("value", value)


MESSAGES_SQL = f"""msg AS (SELECT event_id::BIGINT AS n, CASE event_id::BIGINT % 32 {" ".join(f"WHEN {i} THEN {_quoted(x[2])}" for i, x in MESSAGE_TWISTS.items() if x[2])} END AS error FROM env)"""

BENCH_START = "2026-05-01 08:00:00"


def bench_events(spark: SparkSession, rows: int) -> DataFrame:
    """Events of the reader benchmark: one a second."""
    i = F.col("id")
    time = F.timestamp_add("SECOND", i, F.lit(BENCH_START).cast("timestamp_ntz"))
    return spark.range(rows).select(
        F.concat(F.lit("evt_"), F.lpad(i.cast("string"), 6, "0")).alias("event_id"), F.lit("tenant_1").alias("tenant_id"), F.lit("project_1").alias("project_id"), F.lit("source_1").alias("source_id"), F.lit("web").alias("source_type"),
        F.when(i % 2 == 0, "page_view").otherwise("signup_clicked").alias("event_name"), F.concat(F.lit("visitor_"), i % 100).alias("distinct_id"), F.concat(F.lit("session_"), i % 50).alias("session_id"), F.concat(F.lit("visit_"), i % 25).alias("visit_id"),
        time.alias("event_time"), (time + F.expr("INTERVAL 250 MILLISECONDS")).alias("received_at"), F.lit('{"path":"/bench","button":"hero","is_paid":true}').alias("properties"), F.lit('{"score":43.5}').alias("user_properties"), F.lit("benchmark").alias("source"),
    )


def bench_properties(spark: SparkSession, rows: int) -> DataFrame:
    """Its property rows: three for every hundredth event."""
    some = bench_events(spark, rows).where(F.substring("event_id", -2, 2) == "01")
    row = lambda scope, name, kind, s, n, b: F.struct(F.lit(scope).alias("property_scope"), F.lit(name).alias("property_name"), F.lit(kind).alias("property_type"), F.lit(s).alias("string_value"), F.lit(n).alias("number_value"), F.lit(b).alias("bool_value"))
    three = F.array(row("event", "button", "string", "hero", 0.0, False), row("user", "score", "number", "", 43.5, False), row("event", "is_paid", "bool", "", 0.0, True))
    return some.withColumn("p", F.explode(three)).select("*", "p.*").select(*PROPERTIES.fieldNames())


def bench_sql(rows: int) -> str:
    return f"""env AS (
  SELECT 'evt_' || lpad(i::VARCHAR, 6, '0') AS event_id, 'tenant_1' AS tenant_id, 'project_1' AS project_id, 'source_1' AS source_id, 'web' AS source_type,
         CASE WHEN i % 2 = 0 THEN 'page_view' ELSE 'signup_clicked' END AS event_name, 'visitor_' || (i % 100) AS distinct_id, 'session_' || (i % 50) AS session_id, 'visit_' || (i % 25) AS visit_id,
         TIMESTAMP '{BENCH_START}' + to_seconds(i) AS event_time, TIMESTAMP '{BENCH_START}' + to_seconds(i) + INTERVAL 250 MILLISECOND AS received_at,
         '{{"path":"/bench","button":"hero","is_paid":true}}' AS properties, '{{"score":43.5}}' AS user_properties, 'benchmark' AS source FROM range({rows}) r(i)
), prop AS (
  SELECT env.event_id, tenant_id, project_id, source_id, event_time, p.* FROM env,
    (VALUES ('event', 'button', 'string', 'hero', 0.0, false), ('user', 'score', 'number', '', 43.5, false), ('event', 'is_paid', 'bool', '', 0.0, true)) p(property_scope, property_name, property_type, string_value, number_value, bool_value)
  WHERE right(env.event_id, 2) = '01'
)"""
