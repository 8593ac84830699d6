"""Validation, screening and normalising of untrusted fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import trimmed

#: Patterns of identifiers. Fixed values.
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
WEEK_MS = 7 * 24 * 3600 * 1000


def reasons(**checks: Column) -> Column:
    """PF6: names of the checks that fail (null counts as failing), in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def is_uuid(c: Column) -> Column:
    return c.rlike(UUID)


def is_email(c: Column) -> Column:
    return (F.length(c) <= 254) & c.rlike(EMAIL)


def bounded(c: Column, most: int) -> Column:
    """A text of at most ``most`` characters that isn't blank."""
    return (F.length(c) <= most) & (trimmed(c) != "")


def is_position(ms: Column) -> Column:
    """Finite and between zero and seven days."""
    return ~F.isnan(ms.cast("double")) & ms.between(0, WEEK_MS)


def is_index(c: Column) -> Column:
    return (c >= 1) & (c == F.floor(c))


def is_safe_key(key: Column) -> Column:
    """PF7. The pattern and the length are fixed values."""
    return F.coalesce((F.length(key).between(1, 512)) & ~F.contains(key, F.lit("..")) & ~key.startswith("/") & key.rlike(r"^[a-zA-Z0-9/_.-]+$"), F.lit(False))


# The ranges are fixed values.
def _private_v4(a: Column, b: Column) -> Column:
    return (
        a.isin(10, 127, 0) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & b.isin(0, 168))
        | ((a == 198) & b.isin(18, 19)) | ((a == 100) & b.between(64, 127))
    )


def is_private_ip(ip: Column) -> Column:
    """PF9: loopback, private, link-local, shared, test, multicast or reserved; version 4, 6 and mapped."""
    ip = F.lower(ip)
    part = lambda p, g: F.nullif(F.regexp_extract(ip, p, g), F.lit(""))
    dotted, mapped, hexed = r"^(\d{1,3})\.(\d{1,3})\.\d{1,3}\.\d{1,3}$", r"^::ffff:(\d{1,3})\.(\d{1,3})\.\d{1,3}\.\d{1,3}$", "^::ffff:([0-9a-f]{1,4}):[0-9a-f]{1,4}$"
    a, b = F.coalesce(part(dotted, 1), part(mapped, 1)).cast("int"), F.coalesce(part(dotted, 2), part(mapped, 2)).cast("int")
    high = F.conv(part(hexed, 1), 16, 10).cast("int")
    six = ip.isin("::1", "::") | ip.startswith("fe80:") | ip.startswith("fc") | ip.startswith("fd") | ip.startswith("2001:db8")
    return F.coalesce(six | F.coalesce(_private_v4(F.coalesce(a, F.shiftright(high, 8)), F.coalesce(b, high.bitwiseAND(255))), F.lit(False)), F.lit(False))


def url_problem(url: Column, allowed: list[str]) -> Column:
    """PF8: why a URL is refused, or null: https only, host in an allowed domain, not a private address."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    inside = F.lit(False)
    for domain in allowed:
        inside = inside | (host == domain) | host.endswith("." + domain)
    return F.when(host.isNull() | (host == ""), "invalid").when(F.try_parse_url(url, F.lit("PROTOCOL")) != "https", "not https").when(~inside, "unexpected host").when(is_private_ip(F.regexp_replace(host, r"[\[\]]", "")) | (host == "localhost"), "private")


def client_ip(forwarded: Column, connection: Column, trusted_hops: int = 1) -> Column:
    """PF10: the n-th hop from the right; a shorter chain isn't trusted."""
    hops = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), trimmed), lambda h: h != "")
    return F.when(F.size(hops) >= trusted_hops, F.try_element_at(hops, F.lit(-trusted_hops))).otherwise(connection)


def is_older(ts: Column, as_of: Column, seconds: int) -> Column:
    """PF11: more than so many seconds before ``as_of``."""
    return ts < as_of - F.make_interval(secs=F.lit(seconds))


def first_text(*keys: Column) -> Column:
    """PF12: the first that isn't blank, trimmed; else empty."""
    return F.coalesce(*[F.nullif(trimmed(k), F.lit("")) for k in keys], F.lit(""))


def first_number(*keys: Column) -> Column:
    """PF12: the first that is a number of zero or more; else zero."""
    number = lambda k: k.cast("string").try_cast("double")
    return F.coalesce(*[F.when(number(k) >= 0, number(k)) for k in keys], F.lit(0.0))


def listed(json: Column, item: str) -> Column:
    """PF12: an array of ``item`` from a bare JSON list or one under ``torrents`` or ``results``."""
    wrapped = F.from_json(json, f"torrents array<{item}>, results array<{item}>")
    bare = F.when(trimmed(json).startswith("["), F.from_json(json, f"array<{item}>"))
    return F.coalesce(bare, wrapped["torrents"], wrapped["results"])
