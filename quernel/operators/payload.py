"""JSON payloads, read strictly.

A payload is one JSON value and nothing after it; its fields have the types of
the protocol, times are RFC 3339 and numbers lie in the range of a double. The
text is parsed once, each field into a variant of its own.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TIME = r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)\z"
#: A time that stands for none (fixed value).
_NO_TIME = "0001-01-01T00:00:00Z"


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with further columns, which filters above read and don't compute again.

    A filter on a projected column is pushed below the projection with the
    column's whole expression in it, every use of a parsed payload included;
    it stays above a generator.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(v.alias(n) for n, v in columns.items())))))


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number's type; null where absent."""
    return F.regexp_extract(F.schema_of_variant(v), r"\A\w+", 0)


def utc(ts: Column) -> Column:
    """A zoned timestamp as a zone-free one in UTC, whatever the session's zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit("1970-01-01").cast("timestamp_ntz"))


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def zoned(text: Column) -> Column:
    """A strict time as a timestamp, or null."""
    return F.when(text.rlike(_TIME), F.try_to_timestamp(text))


def time_of(ts: Column, millis: bool = False) -> Column:
    """A strict time in UTC, cut to milliseconds or not; null where it stands for none."""
    plain = F.timestamp_add("MILLISECOND", F.unix_millis(ts), F.lit("1970-01-01").cast("timestamp_ntz")) if millis else utc(ts)
    return F.when(ts != F.to_timestamp(F.lit(_NO_TIME)), plain)


def cut(time: Column, micros: int = 1000) -> Column:
    """A zone-free time cut to whole milliseconds, or other parts of a minute. No zone comes into it: a session's may lack the hour."""
    return F.timestamp_add("MICROSECOND", -F.pmod(F.date_part(F.lit("SECOND"), time) * 1_000_000, F.lit(micros)).cast("long"), time)


#: Type of ``entries``.
ENTRIES = "array<struct<key:string,kind:string,value:variant>>"


def entries(bag: Column) -> Column:
    """Entries (key, kind, value) of a bag variant; null for anything else."""
    each = F.map_entries(F.try_variant_get(bag, "$", "map<string,variant>"))
    return F.transform(each, lambda e: F.struct(e["key"].alias("key"), kind(e["value"]).alias("kind"), e["value"].alias("value")))


def _out_of_range(each: Column) -> Column:
    """Whether entries hold a number beyond the doubles."""
    return F.exists(each, lambda e: (e["kind"] == "DOUBLE") & (F.abs(F.try_variant_get(e["value"], "$", "double")) == float("inf")))


def read(df: DataFrame, value: str, texts: Iterable[str], times: Iterable[str], bags: Iterable[str], out: str = "_p") -> DataFrame:
    """Adds the struct ``out``: a variant for each field, for times ``<name>_at``, for bags ``<name>_entries`` (none for null), and ``well``.

    ``well`` is false for a text that is no JSON object or null, goes on after
    it, or holds a field of a wrong type. Fields may be null or absent.
    """
    texts, times, bags = map(list, (texts, times, bags))
    fields = [*texts, *times, *bags]
    # What follows the value breaks the list, whose second entry no text can foresee: its own hash.
    end = F.xxhash64(F.col(value)).cast("string")
    listed = F.concat(F.lit("["), F.col(value), F.lit(',{"quernel_end":"'), end, F.lit('"}]'))
    schema = "array<struct<" + ",".join(f"`{c}`: variant" for c in fields) + ",quernel_end: string>>"
    df = computed(df, {"_l": F.from_json(listed, schema)})
    first, last = F.get("_l", F.lit(0)), F.get("_l", F.lit(1))
    once = {f"_{b}": F.coalesce(entries(first[b]), F.array().cast(ENTRIES)) for b in bags} | {f"_{t}": zoned(text_of(first[t])) for t in times}
    df = computed(df, once)
    whole = (F.size("_l") == 2) & (last["quernel_end"] == end) & (first.isNotNull() | F.col(value).rlike(r"\A\s*null\s*\z"))
    fits = F.lit(True)
    for c in (*texts, *times):
        fits = fits & F.coalesce(kind(first[c]).isin("STRING", "VOID"), F.lit(True))
    for c in times:
        fits = fits & (text_of(first[c]).isNull() | F.col(f"_{c}").isNotNull())
    for c in bags:
        fits = fits & F.coalesce(kind(first[c]).isin("OBJECT", "VOID"), F.lit(True)) & ~_out_of_range(F.col(f"_{c}"))
        # A bag that names a key twice is no variant, and would pass for a missing one.
        fits = fits & (first[c].isNotNull() | F.get_json_object(F.col(value), f"$.{c}").isNull())
    parts = [first[c].alias(c) for c in fields] + [F.col(f"_{b}").alias(f"{b}_entries") for b in bags] + [F.col(f"_{t}").alias(f"{t}_at") for t in times]
    return computed(df, {out: F.struct(F.coalesce(whole & fits, F.lit(False)).alias("well"), *parts)}).drop("_l", *once)
