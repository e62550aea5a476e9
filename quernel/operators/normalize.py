"""Raw collect requests to validated envelopes, as one projection.

A request is a JSON text. All checks are built-in expressions; the first that
fails, in protocol order, gives ``error_field`` and ``error_reason``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.text import IDENTIFIER, MAX_ID, MAX_SOURCE_TYPE, MAX_STRING, SOURCE_TYPE, pattern_error, trimmed
from quernel.operators.payload import computed, kind, read, text_of, time_of

MAX_ENTRIES = 64
#: JSON name of each text field, in protocol order, and its column.
FIELDS = {
    "id": "event_id", "tenant_id": "tenant_id", "project_id": "project_id", "source_id": "source_id", "source_type": "source_type", "event_name": "event_name",
    "distinct_id": "distinct_id", "session_id": "session_id", "visit_id": "visit_id", "source": "source",
}
BAGS = ("properties", "user_properties")
_OPTIONAL = ("session_id", "visit_id")


def bag_text(bag: Column) -> Column:
    """A bag variant as JSON; ``{}`` for null."""
    return F.when(kind(bag) == "OBJECT", F.to_json(bag)).otherwise(F.lit("{}"))


def bag_error(name: str, each: Column) -> Column:
    """struct(field, reason) of the first bad key, in byte order, of a bag's entries, or null."""
    error = lambda field, reason: F.struct(field.alias("field"), F.lit(reason).alias("reason"))

    def of(e: Column) -> Column:
        key, value = e["key"], e["value"]
        field, of_kind = F.concat(F.lit(f"{name}."), key), e["kind"]
        return (
            F.when(key == "", error(F.lit(name), "contains empty property key"))
            .when(F.octet_length(key) > MAX_ID, error(field, "key is too long"))
            .when(~key.rlike(IDENTIFIER), error(field, "key contains unsupported characters"))
            .when((of_kind == "STRING") & (F.octet_length(text_of(value)) > MAX_STRING), error(field, "string value is too long"))
            .when(of_kind.isin("OBJECT", "ARRAY"), error(field, "has unsupported value type"))
        )

    bad = F.array_sort(F.filter(F.transform(each, of), lambda x: x.isNotNull()))
    return F.when(F.size(each) > MAX_ENTRIES, error(F.lit(name), "has too many entries")).otherwise(F.get(bad, F.lit(0)))


def normalize(requests: DataFrame, raw: str = "raw", received_at: str = "received_at") -> DataFrame:
    """Adds the envelope's columns, ``error_field``, ``error_reason`` and ``malformed`` to each request.

    ``malformed`` marks texts that are no JSON object (or null), go on after
    it, or hold a field of a wrong type, a time that is no RFC 3339 one or a
    number beyond the doubles. Other columns stay. JSON names are matched
    exactly.
    """
    df = read(requests, raw, FIELDS, ["event_time"], BAGS)
    part = lambda name: F.col("_p")[name]
    made = {"malformed": ~F.col("_p.well")}
    made |= {c: trimmed(text_of(part(name))) for name, c in FIELDS.items()}
    made |= {b: bag_text(part(b)) for b in BAGS}
    df = computed(df, made | {"event_time": F.coalesce(time_of(part("event_time_at")), F.col(received_at))})
    error = lambda field, reason: F.when(reason.isNotNull(), F.struct(F.lit(field).alias("field"), reason.alias("reason")))
    checks = []
    for name, c in FIELDS.items():
        if name == "source":
            continue
        limits = (SOURCE_TYPE, MAX_SOURCE_TYPE) if name == "source_type" else (IDENTIFIER, MAX_ID)
        reason = pattern_error(F.col(c), *limits)
        checks.append(error(name, F.when(F.col(c) != "", reason) if name in _OPTIONAL else reason))
    checks += [bag_error(b, part(f"{b}_entries")) for b in BAGS]
    late = F.col("event_time") > F.col(received_at) + F.expr("INTERVAL 5 MINUTES")
    checks.append(error("event_time", F.when(late, F.lit("too far in the future"))))
    df = computed(df, {"_e": F.when(~F.col("malformed"), F.coalesce(*checks))})
    return df.withColumns({"error_field": F.col("_e.field"), "error_reason": F.col("_e.reason")}).drop("_p", "_e")


def valid_event_name(name: Column) -> Column:
    """The refusal of an event name as ``event_name: reason``, or null."""
    reason = pattern_error(name)
    return F.when(reason.isNotNull(), F.concat(F.lit("event_name: "), reason))
