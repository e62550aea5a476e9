"""Collect stages: DataFrame to DataFrame, composed with ``df.transform``.

Stages act on normalized requests. Columns ``user_agent``, ``ip`` and
``referrer`` hold transient client data; ``without_client`` drops them before a
write. A filtered event keeps its row with ``filter_reason`` set.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.text import BOT_TOKENS, BROWSERS, DEVICES, SYSTEMS, bucket_start, contains_any, cut_bytes, family, internal_ip, salted_digest, trimmed
from quernel.operators.normalize import MAX_ENTRIES

Stage = Callable[[DataFrame], DataFrame]
CLIENT = ("user_agent", "ip", "referrer")


def chain(*stages: Stage | None) -> Stage:
    """Stages in order; None is skipped."""
    return lambda df: reduce(lambda d, s: d.transform(s), [s for s in stages if s is not None], df)


def _client(df: DataFrame, name: str) -> Column:
    return trimmed(F.col(name)) if name in df.columns else F.lit("")


def _identity(what: str, salt: str, window: timedelta) -> int:
    if not salt:
        raise ValueError(f"{what} resolver salt is required")
    if window < timedelta(minutes=1):
        raise ValueError(f"{what} resolver window must be at least one minute")
    return int(window.total_seconds())


def session_ids(salt: str, window: timedelta = timedelta(minutes=30), fingerprint: bool = False) -> Stage:
    """Fills missing session ids from the ids and the window of the event time."""
    seconds = _identity("session", salt, window)

    def stage(df: DataFrame) -> DataFrame:
        parts = [F.col(c) for c in ("tenant_id", "project_id", "source_id", "distinct_id")] + [bucket_start(F.col("event_time"), seconds).cast("string")]
        parts += [_client(df, "user_agent"), _client(df, "ip")] if fingerprint else []
        made = F.concat(F.lit("ses_"), F.substring(salted_digest("session", salt, *parts), 1, 32))
        return df.withColumn("session_id", F.when(F.coalesce(F.col("session_id"), F.lit("")) == "", made).otherwise(F.col("session_id")))

    return stage


def visit_ids(salt: str, window: timedelta = timedelta(minutes=30)) -> Stage:
    """Fills missing visit ids; the session id is part of them, so sessions come first."""
    seconds = _identity("visit", salt, window)

    def stage(df: DataFrame) -> DataFrame:
        parts = [F.col(c) for c in ("tenant_id", "project_id", "source_id", "distinct_id", "session_id")] + [bucket_start(F.col("event_time"), seconds).cast("string")]
        made = F.concat(F.lit("vis_"), F.substring(salted_digest("visit", salt, *parts), 1, 32))
        return df.withColumn("visit_id", F.when(F.coalesce(F.col("visit_id"), F.lit("")) == "", made).otherwise(F.col("visit_id")))

    return stage


def enrich(
    user_agent: bool = False, referrer: bool = False, ip_salt: str | None = None, families: bool = False,
    geo: Callable[[DataFrame], dict[str, Column]] | None = None, parse_agent: Callable[[Column], dict[str, Column]] | None = None,
) -> Stage:
    """Adds derived client properties to the bag: a key that is there wins, a full bag takes no more."""
    if ip_salt == "":
        raise ValueError("client enrichment hash salt is required when IP hashing is enabled")
    parse = parse_agent or (lambda a: {"browser": family(a, BROWSERS), "os": family(a, SYSTEMS), "device": family(a, DEVICES)})

    def stage(df: DataFrame) -> DataFrame:
        agent, ip = _client(df, "user_agent"), _client(df, "ip")
        made: dict[str, Column] = {}
        if user_agent:
            made["client.user_agent"] = cut_bytes(agent)
        if referrer:
            made["client.referrer"] = cut_bytes(_client(df, "referrer"))
        if ip_salt is not None:
            made["client.ip_hash"] = F.when(ip != "", F.concat(F.lit("ip_"), F.substring(salted_digest("client-ip", ip_salt, ip), 1, 32)))
        if families:
            made |= {f"client.{k}": F.when(agent != "", cut_bytes(trimmed(v))) for k, v in parse(agent).items()}
        if geo is not None:
            made |= {f"geo.{k}": cut_bytes(trimmed(v)) for k, v in geo(df).items()}
        if not made:
            return df
        text = F.array(*(F.struct(F.lit(k).alias("key"), F.coalesce(v, F.lit("")).alias("value")) for k, v in made.items()))
        bag = F.coalesce(F.try_parse_json(F.col("properties")).cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
        keys = F.map_keys(bag)
        fresh = F.filter(text, lambda e: (e["value"] != "") & ~F.array_contains(keys, e["key"]))
        taken = F.slice(fresh, F.lit(1), F.greatest(F.lit(0), F.lit(MAX_ENTRIES) - F.size(keys)))
        # The bag's own text stays as it is; new members are appended to it.
        own = F.trim(F.coalesce(F.col("properties"), F.lit("{}")))
        more = F.array_join(
            F.transform(taken, lambda e: F.concat(F.regexp_extract(F.to_json(F.struct(e["key"].alias("k"))), r"\A\{\"k\":(.*)\}\z", 1), F.lit(":"), F.regexp_extract(F.to_json(F.struct(e["value"].alias("v"))), r"\A\{\"v\":(.*)\}\z", 1))),
            ",",
        )
        grown = F.when(F.size(keys) == 0, F.concat(F.lit("{"), more, F.lit("}"))).otherwise(F.concat(F.expr("substr(trim(properties), 1, length(trim(properties)) - 1)"), F.lit(","), more, F.lit("}")))
        return df.withColumn("properties", F.when(F.size(taken) == 0, own).otherwise(grown))

    return stage


def filter_traffic(bot_tokens: tuple[str, ...] = (), cidrs: tuple[str, ...] = (), ips: tuple[str, ...] = ()) -> Stage:
    """Marks bots, then internal addresses, in ``filter_reason``."""
    tokens = [t.strip().lower() for t in bot_tokens if t.strip()] or list(BOT_TOKENS)

    def stage(df: DataFrame) -> DataFrame:
        bot = contains_any(F.lower(_client(df, "user_agent")), tokens)
        inside = internal_ip(_client(df, "ip"), cidrs, ips)
        old = F.col("filter_reason") if "filter_reason" in df.columns else F.lit(None).cast("string")
        return df.withColumn("_inside", inside).withColumn(
            "filter_reason", F.coalesce(old, F.when(bot, "bot user agent"), F.when(F.col("_inside"), "internal ip")),
        ).drop("_inside")

    return stage


def without_client(df: DataFrame) -> DataFrame:
    return df.drop(*CLIENT)


def with_status(df: DataFrame) -> DataFrame:
    """``status``, ``http_status`` and ``error`` of each request.

    A method other than POST (``method_status``) comes first: 405. Then what is
    malformed or invalid: 400. What is filtered or accepted: 202, but 500 where
    ``publish_error`` says why an accepted event could not be published.
    """
    given = lambda c, kind: F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    method, failed = given("method_status", "int"), given("publish_error", "string")
    invalid = F.when(F.col("malformed"), F.lit("invalid collect payload")).otherwise(F.concat_ws(": ", F.col("error_field"), F.col("error_reason")))
    bad = F.col("malformed") | F.col("error_field").isNotNull()
    filtered = given("filter_reason", "string").isNotNull()
    lost = ~filtered & failed.isNotNull()
    status = F.when(method.isNotNull() | bad, "rejected").when(lost, "failed").when(filtered, "filtered").otherwise("accepted")
    code = F.when(method.isNotNull(), method).when(bad, 400).when(lost, 500).otherwise(202)
    error = F.when(method.isNotNull(), F.lit("method not allowed")).when(bad, invalid).when(lost, failed)
    return df.withColumns({"status": status, "http_status": code, "error": error})
