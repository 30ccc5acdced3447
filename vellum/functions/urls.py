"""URL functions: identifiers, parts, and which addresses may be fetched."""

from __future__ import annotations

import ipaddress
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, functions as F

#: Networks that are never fetched from.
PRIVATE_V4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4")
LOCAL_NAMES = r"(^|\.)(localhost|local|internal|lan|home|intranet)$"
IPV4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"


def notice_id(url: Column) -> Column:
    """The deterministic key of a record: the first 16 hexadecimal digits of its address's SHA-256."""
    return F.substring(F.sha2(url, 256), 1, 16)


def host(url: Column) -> Column:
    return F.lower(F.call_function("try_parse_url", url, F.lit("HOST")))


def url_part(url: Column, part: str, key: str | None = None) -> Column:
    args = [url, F.lit(part)] + ([F.lit(key)] if key else [])
    return F.call_function("try_parse_url", *args)


def short_key(url: Column) -> Column:
    """The fragment, else the last part of the path without its extension."""
    last = F.regexp_extract(F.coalesce(url_part(url, "PATH"), F.lit("")), r"([^/]+?)(\.[A-Za-z0-9]+)?/?$", 1)
    return F.coalesce(F.nullif(url_part(url, "REF"), F.lit("")), F.nullif(last, F.lit("")))


def _ipv4_number(name: Column) -> Column:
    octets = F.transform(F.split(name, r"\."), lambda x: x.cast("long"))
    return F.aggregate(octets, F.lit(0).cast("long"), lambda n, x: n * 256 + x)


def _is_private_v4(name: Column) -> Column:
    number = _ipv4_number(name)
    hit = F.lit(False)
    for network in PRIVATE_V4:
        net = ipaddress.ip_network(network)
        hit = hit | number.between(int(net.network_address), int(net.broadcast_address))
    return hit


def may_fetch(url: Column, allowed_hosts: list[str] | None = None) -> Column:
    """Web addresses of public hosts (and of the allowed ones, if a list is given)."""
    scheme, name = F.lower(F.coalesce(url_part(url, "PROTOCOL"), F.lit(""))), F.coalesce(host(url), F.lit(""))
    public = ~name.rlike(LOCAL_NAMES) & ~F.when(name.rlike(IPV4), _is_private_v4(name)).otherwise(name.contains(":"))
    listed = F.lit(True) if allowed_hosts is None else name.isin(allowed_hosts)
    return scheme.isin("http", "https") & (name != "") & public & listed & F.coalesce(F.nullif(url_part(url, "USERINFO"), F.lit("")).isNull(), F.lit(True))


def resolved(base: Column, link: Column) -> Column:
    """Links against their page's address; null unless the result is a web address."""

    def run(bases: pd.Series, links: pd.Series) -> pd.Series:
        out = []
        for b, x in zip(bases, links):
            try:
                whole = urljoin(b or "", (x or "").strip())
                out.append(whole if x and urlsplit(whole).scheme in ("http", "https") else None)
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(base, link)


def alternate_hosts(a: Column, b: Column) -> Column:
    """Whether two hosts share their last three labels."""
    last = lambda x: F.slice(F.reverse(F.split(host(x), r"\.")), 1, 3)
    return (F.size(last(a)) == 3) & (last(a) == last(b)) & (host(a) != host(b))


def _common_labels(a: Column, b: Column) -> Column:
    """How many labels two hosts share at their ends."""
    same = F.zip_with(F.reverse(F.split(a, r"\.")), F.reverse(F.split(b, r"\.")), lambda x, y: x == y)
    differs = F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), False)
    return F.when(differs == 0, F.size(same)).otherwise(differs - 1)


def candidates(file: Column, page: Column, least: int = 3) -> Column:
    """Addresses to try for a file of a page, in order: its own, then its path on the page's host.

    The second comes only if the two origins differ and their hosts share at least ``least`` labels.
    """
    origin = lambda x: F.regexp_extract(x, r"^(?i)(https?://[^/?#]+)", 1)
    path = F.concat(F.coalesce(url_part(file, "PATH"), F.lit("")), F.coalesce(F.concat(F.lit("?"), url_part(file, "QUERY")), F.lit("")))
    other = F.concat(origin(page), path)
    apart = (F.lower(origin(file)) != F.lower(origin(page))) & (_common_labels(host(file), host(page)) >= least) & (other != file)
    return F.when(F.coalesce(apart, F.lit(False)), F.array(file, other)).otherwise(F.array(file))


def host_sites(hosts):
    """(host, first, n): hosts that others share their last three labels with, beside the first of these and their number."""
    site = F.array_join(F.slice(F.reverse(F.split("host", r"\.")), 1, 3), ".")
    keyed = hosts.where(F.size(F.split("host", r"\.")) >= 3).select("host", site.alias("site"))
    sites = keyed.groupBy("site").agg(F.min("host").alias("first"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(sites, "site").select("host", "first", "n")
