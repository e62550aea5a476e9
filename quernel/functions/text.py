"""Scalar column functions: trimming, identifiers, digests, user agents, addresses."""

from __future__ import annotations

import ipaddress
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns and limits of the collect protocol (fixed values).
IDENTIFIER = r"\A[A-Za-z0-9][A-Za-z0-9_.:-]*\z"
SOURCE_TYPE = r"\A[a-z][a-z0-9_-]*\z"
MAX_ID = 128
MAX_SOURCE_TYPE = 32
MAX_STRING = 2048

#: Families and the lower-case substrings that tell them, first match first (fixed values).
BROWSERS = {"Edge": ("edgios", "edga/", "edg/", "edge/"), "Opera": ("opios", "opr/", "opera"), "Firefox": ("fxios", "firefox/"), "Chrome": ("crios", "chrome/", "chromium/"), "Safari": ("safari/",)}
SYSTEMS = {"iOS": ("iphone", "ipad"), "Android": ("android",), "Windows": ("windows nt",), "macOS": ("mac os x", "macintosh"), "ChromeOS": ("cros",), "Linux": ("linux",)}
DEVICES = {"tablet": ("ipad", "tablet"), "mobile": ("mobi", "iphone", "android"), "desktop": ("mozilla/",)}
BOT_TOKENS = ("bot", "crawler", "headlesschrome", "spider")


def trimmed(c: Column) -> Column:
    """Without white space (Unicode) at the ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\A\s+|\s+\z", "")


def pattern_error(c: Column, pattern: str = IDENTIFIER, longest: int = MAX_ID) -> Column:
    """Why ``c`` is refused, or null. Lengths are bytes."""
    return F.when(c == "", "is required").when(F.octet_length(c) > longest, "is too long").when(~c.rlike(pattern), "contains unsupported characters")


def contains_any(c: Column, parts) -> Column:
    return reduce(Column.__or__, [c.contains(p) for p in parts], F.lit(False))


def family(agent: Column, families: dict[str, tuple[str, ...]]) -> Column:
    """The first family with a part in the lower-cased agent, or empty."""
    low = F.lower(trimmed(agent))
    return F.coalesce(*(F.when(contains_any(low, parts), F.lit(name)) for name, parts in families.items()), F.lit(""))


def salted_digest(prefix: str, salt: str, *parts: Column) -> Column:
    """Hex SHA-256 of prefix, salt and parts, NUL between them."""
    joined = [F.lit(prefix), F.lit(salt), *(F.coalesce(p, F.lit("")) for p in parts)]
    nul = F.char(F.lit(0))
    return F.sha2(F.concat(*[x for p in joined for x in (nul, p)][1:]), 256)


def cut_bytes(c: Column, longest: int = MAX_STRING) -> Column:
    """At most ``longest`` bytes; a character that would be split goes whole."""
    kept = F.make_valid_utf8(F.substring(F.encode(c, "UTF-8"), 1, longest).cast("string"))
    # A cut character becomes replacement characters at the end.
    return F.when(F.octet_length(c) <= longest, c).otherwise(F.regexp_replace(kept, "\ufffd+\\z", ""))


def bucket_start(time: Column, seconds: int) -> Column:
    """Unix seconds of the window that holds ``time``, windows counted from year one."""
    offset = 62135596800
    unix = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), time)
    return F.floor((unix + offset) / seconds).cast("long") * seconds - offset


def _address(text: str | None):
    """An address, alone or with a port; None where there is none."""
    text = (text or "").strip()
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        pass
    host, _, port = text.rpartition(":")
    if not port.isdigit() or int(port) > 65535:
        return None
    host = host[1:-1] if host.startswith("[") and host.endswith("]") else (host if ":" not in host else "")
    try:
        return ipaddress.ip_address(host)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def canonical_ip(values: pd.Series) -> pd.Series:
    """The address in canonical form, or empty."""
    return values.map(lambda x: "" if (a := _address(x)) is None else str(a))


def client_ip(forwarded: Column, real: Column, peer: Column, trust_proxy: bool = False) -> Column:
    """The client's address: behind a trusted proxy its first hop, then the real-IP header, then the peer."""
    own = canonical_ip(peer)
    if not trust_proxy:
        return own
    first = F.element_at(F.split(F.coalesce(forwarded, F.lit("")), ","), 1)
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(canonical_ip(first)), some(canonical_ip(real)), own)


def internal_ip(c: Column, cidrs: tuple[str, ...] = (), ips: tuple[str, ...] = ()) -> Column:
    """Whether the text before a comma is an address in one of the networks or among the addresses."""
    try:
        networks = [ipaddress.ip_network(x.strip(), strict=False) for x in cidrs]
    except ValueError as e:
        raise ValueError(f"internal cidr is invalid: {e}") from None
    single = {_address(x) for x in ips}
    if None in single:
        raise ValueError("internal ip is invalid")
    if not networks and not single:
        return F.lit(False)

    @F.pandas_udf(T.BooleanType())
    def inside(values: pd.Series) -> pd.Series:
        def test(x):
            a = _address((x or "").split(",")[0])
            return a is not None and (a in single or any(a in n for n in networks if n.version == a.version))

        return values.map(test)

    return inside(c)
