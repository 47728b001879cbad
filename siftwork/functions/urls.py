"""URLs: host, scope, redaction, resolution, and the guard against unsafe targets."""

from __future__ import annotations

import ipaddress
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: scheme, user part, host (IPv6 in brackets), port, path, rest
PIECES = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#]*)@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:\[\]]*)(?::([0-9]*))?([^?#]*)(.*)$"
METADATA_HOSTS = ["metadata.google.internal", "metadata.azure.internal", "metadata", "instance-data"]


def piece(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PIECES, group)


def scheme(url: Column) -> Column:
    return F.lower(piece(url, 1))


def host(url: Column) -> Column:
    """Host in lower case without outer dots; empty where there is none."""
    return F.btrim(F.lower(piece(url, 3)), F.lit("."))


def defrag(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def is_http(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (host(url) != "")


def is_public_source(url: Column) -> Column:
    """http or https, a host, no user part."""
    return is_http(url) & ~F.regexp_like(F.coalesce(url, F.lit("")), F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@"))


def redact_url(url: Column) -> Column:
    """Scheme, host, valid port and path only; anything but http(s) with a host becomes the hidden mark."""
    port = F.when(piece(url, 4).rlike(r"^[0-9]{1,5}$") & (piece(url, 4).try_cast("int") <= 65535), F.concat(F.lit(":"), piece(url, 4).try_cast("int").cast("string"))).otherwise(F.lit(""))
    return F.when(url.isNull(), None).when(is_http(url), F.concat(scheme(url), F.lit("://"), F.lower(piece(url, 3)), port, piece(url, 5))).otherwise("[REDACTED_URL]")


def _suffix_of_any(h: Column, domains: list[str]) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | (h == d) | h.endswith(f".{d}")
    return out


def in_crawl_scope(url: Column, seed_host: Column, allowed: list[str], denied: list[str]) -> Column:
    """Denied suffixes win; then allowed suffixes; without any allowed the seed host itself."""
    h = host(url)
    return (h != "") & ~_suffix_of_any(h, denied) & (_suffix_of_any(h, allowed) if allowed else h == seed_host)


def in_discovery_scope(url: Column, allowed: list[str], denied: list[str]) -> Column:
    h = host(url)
    return (h != "") & ~_suffix_of_any(h, denied) & (_suffix_of_any(h, allowed) if allowed else F.lit(True))


def suffixes(h: Column) -> Column:
    """A host and its parent domains, the longest first: a.b.c, b.c, c."""
    parts = F.split(h, r"\.")
    return F.when(h != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).otherwise(F.array().cast("array<string>"))


def is_private_ipv4(h: Column) -> Column:
    """Private, loopback, link-local, multicast, reserved or unspecified IPv4 literals, as number ranges."""
    parts = F.transform(F.split(h, r"\."), lambda x: x.try_cast("long"))
    n = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    ranges = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3"]
    inside = F.lit(False)
    for r in map(ipaddress.ip_network, ranges):
        inside = inside | n.between(int(r.network_address), int(r.broadcast_address))
    return h.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") & F.coalesce(inside, F.lit(True))


@pandas_udf(T.BooleanType())
def is_private_ip(h: pd.Series) -> pd.Series:
    """Any address literal, IPv6 included, that is not a public one; names are not addresses."""

    def unsafe(x: str | None) -> bool:
        try:
            a = ipaddress.ip_address((x or "").strip("[]"))
        except ValueError:
            return False
        return a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified

    return h.map(unsafe)


def is_unsafe(url: Column) -> Column:
    """Not http(s), no host, a user part, a metadata or local host name, or a private IPv4 address."""
    h = host(url)
    return ~is_public_source(url) | h.isin(METADATA_HOSTS) | (h == "localhost") | h.endswith(".localhost") | h.endswith(".local") | is_private_ipv4(h)


def unsafe_redirect(source: Column, target: Column) -> Column:
    """A redirect is judged by its destination alone; none at all is no redirect."""
    return F.coalesce(is_unsafe(target), F.lit(False))


def host_list(csv: Column) -> Column:
    """Comma-separated hosts as a sorted set, in lower case, without blanks and outer dots."""
    parts = F.transform(F.split(csv, ","), lambda x: F.btrim(F.btrim(F.lower(x)), F.lit(".")))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def service_url(value: Column) -> Column:
    """A service's base URL without blanks and closing slashes; null where it is blank or no plain http(s) URL (it has no
    host, or a user part, query or fragment)."""
    url = F.regexp_replace(F.btrim(value), "/+$", "")
    return F.when(is_public_source(url) & ~url.rlike("[?#]"), url)


@pandas_udf(T.StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """href joined to base, without fragment; null where it can't be joined."""

    def join(b: str | None, h: str | None) -> str | None:
        try:
            return urldefrag(urljoin(b or "", (h or "").strip()))[0] or None
        except ValueError:
            return None

    return pd.Series([join(b, h) for b, h in zip(base, href, strict=True)], index=href.index)
