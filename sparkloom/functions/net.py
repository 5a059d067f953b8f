"""Addresses, URLs and cache policy as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address ranges that are not public, as network and prefix length.
PRIVATE_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def v4_number(ip: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    part = F.split(ip, r"\.")
    number = F.lit(0).cast("long")
    for k in range(4):
        number = number * 256 + F.get(part, F.lit(k)).try_cast("long")
    fits = ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    return F.when(fits, number)


def private_ranges() -> list[tuple[int, int]]:
    out = []
    for network, bits in PRIVATE_V4:
        low = 0
        for octet in network.split("."):
            low = low * 256 + int(octet)
        out.append((low, low + (1 << (32 - bits)) - 1))
    return out


def is_private_v4(ip: Column) -> Column:
    """Whether an IPv4 address is not public; what is no address counts as private."""
    n = v4_number(ip)
    ranges = F.array(*[F.struct(F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high")) for low, high in private_ranges()])
    return F.coalesce(F.exists(ranges, lambda r: n.between(r["low"], r["high"])), F.lit(True))


def is_private(ip: Column) -> Column:
    """Of IPv4, IPv6 and IPv4 mapped into IPv6; IPv6 is public in 2000::/3 only, less documentation and translation ranges."""
    mapped = F.regexp_extract(F.lower(ip), r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    six = F.lower(ip).rlike(r"^[23][0-9a-f]{3}:") & ~F.lower(ip).rlike(r"^2001:(?:0?db8|0{0,4}|2[0-9a-f]):|^2002:")
    return F.when(mapped != "", is_private_v4(mapped)).when(ip.contains(":"), ~six).otherwise(is_private_v4(ip))


def client_key(ip: Column) -> Column:
    """The quota's key: a mapped IPv4 address as itself, what is no address as `unknown`."""
    bare = F.regexp_replace(F.trim(ip), r"(?i)^::ffff:(?=\d+\.)", "")
    return F.when(v4_number(bare).isNotNull() | bare.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), bare).otherwise(F.lit("unknown"))


def is_public_url(url: Column) -> Column:
    """http or https, no credentials, a host that is not local by name or address. Names are not resolved."""
    host = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    local = host.isin("", "localhost") | host.rlike(r"(?:^|\.)(?:localhost|local|internal|home\.arpa)\.?$")
    numeric = host.rlike(r"^\d+(?:\.\d+){3}$")
    return url.rlike(r"^(?i:https?)://") & ~url.rlike(r"^(?i:https?)://[^/?#]*@") & ~local & ~(numeric & is_private_v4(host)) & ~host.startswith("[")


def fetch_mode(mode: Column) -> Column:
    return F.when(mode.isin("rules", "ai"), mode).otherwise(F.lit("rules"))


def content_branch(content_type: Column) -> Column:
    return F.when(content_type.rlike("(?i)text/plain"), F.lit("text")).otherwise(F.lit("html"))


def cache_policy(status: Column, curated: Column) -> Column:
    """Seconds that a response is fresh for: a day for curated pages, five minutes for others, none for errors."""
    return F.when((status == 200) & curated, F.lit(86_400)).when(status == 200, F.lit(300)).otherwise(F.lit(0))


def freshness(age: Column, fresh: Column, stale: int = 86_400) -> Column:
    return F.when(age < fresh, F.lit("fresh")).when((fresh > 0) & (age < fresh + stale), F.lit("stale")).otherwise(F.lit("expired"))
