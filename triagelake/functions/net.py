"""Address and URL tests. The public-address tests differ on purpose between callers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"


def is_ipv4(text: Column) -> Column:
    """Four dotted parts, each a number 0-255 (leading zeros accepted)."""
    return F.coalesce(text.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), F.lit(False)) & F.forall(
        F.split(text, r"\."), lambda p: F.coalesce(p.try_cast("long").between(0, 255), F.lit(False))
    )


def octet(ip: Column, n: int) -> Column:
    return F.get(F.split(ip, r"\."), F.lit(n - 1)).try_cast("int")


def url_host(url: Column) -> Column:
    """Host of a URL with a scheme; null when there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.when(host != "", host)


def in_private_block(ip: Column) -> Column:
    """10/8, 172.16/12 and 192.168/16."""
    return (
        ip.startswith("10.")
        | ip.startswith("192.168.")
        | (ip.startswith("172.") & F.coalesce(octet(ip, 2).between(16, 31), F.lit(False)))
    )


def is_ipv4_loose(host: Column) -> Column:
    """As is_ipv4, but empty parts are dropped and a sign is accepted."""
    parts = F.filter(F.split(host, r"\."), lambda p: p != "")
    ok = F.forall(parts, lambda p: p.rlike(r"^[+-]?[0-9]+$") & F.coalesce(p.try_cast("int").between(0, 255), F.lit(False)))
    return F.coalesce((F.size(parts) == 4) & ok, F.lit(False))


def urls_in(text: Column) -> Column:
    """http(s) links of a text: cut at blanks, quotes and angle brackets, punctuation trimmed."""
    pieces = F.split(text, "[ \\n\\t\\r<>\"']+")
    clean = F.transform(pieces, lambda p: F.regexp_replace(p, r"^[()\[\]{}.,;!]+|[()\[\]{}.,;!]+$", ""))
    return F.filter(clean, lambda p: F.lower(p).startswith("http://") | F.lower(p).startswith("https://"))


def authority_host(url: Column) -> Column:
    """Host of a URL with or without a scheme: behind the last '@', without port, brackets removed."""
    rest = F.regexp_replace(F.lower(url), r"^.*?://", "")
    authority = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", "")
    host = F.when(authority.startswith("["), F.regexp_extract(authority, r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(authority, r"^([^:]*)", 1))
    return F.when(host != "", host)
