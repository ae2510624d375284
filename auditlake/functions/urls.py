"""URL functions: Column expressions for absolute URLs, Python ones for resolving references."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that carry a session (fixed values).
SESSION_KEYS = ("sid", "sessid", "sessionid", "session_id", "phpsessid", "jsessionid", "aspsessionid", "cfid",
    "cftoken")
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_DEFAULT_PORTS = {"http": ":80", "https": ":443"}


def normalize(url: str | None, base: str | None = None) -> str | None:
    """The absolute http(s) URL without fragment, default port and upper case in its host; None if there is none."""
    if url is None:
        return None
    try:
        parts = urlsplit(urljoin(base, url.strip()) if base else url.strip())
    except ValueError:
        return None
    scheme, host = parts.scheme.lower(), parts.netloc.lower()
    if scheme not in _DEFAULT_PORTS or not host:
        return None
    return urlunsplit((scheme, host.removesuffix(_DEFAULT_PORTS[scheme]), parts.path or "/", parts.query, ""))


def host(url: str | None) -> str:
    try:
        return urlsplit(url or "").netloc.lower().split(":", 1)[0]
    except ValueError:
        return ""


def same_site(a: str | None, b: str | None) -> bool:
    x, y = (host(u).removeprefix("www.") for u in (a, b))
    return bool(x) and x == y


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def normalized(url: Column) -> Column:
    """``normalize`` of an absolute URL; null for others."""
    u = F.trim(url)
    scheme, netloc, path, query = F.lower(_part(u, 1)), F.lower(_part(u, 2)), _part(u, 3), _part(u, 4)
    netloc = F.when(scheme == "http", F.regexp_replace(netloc, ":80$", "")).otherwise(F.regexp_replace(netloc, ":443$",
            ""))
    whole = F.concat(scheme, F.lit("://"), netloc, F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme.isin("http", "https") & (netloc != ""), whole)


def host_of(url: Column) -> Column:
    return F.split_part(F.lower(_part(url, 2)), F.lit(":"), F.lit(1))


def is_same_site(a: Column, b: Column) -> Column:
    x, y = (F.regexp_replace(host_of(u), r"^www\.", "") for u in (a, b))
    return F.coalesce((x != "") & (x == y), F.lit(False))


def depth(url: Column) -> Column:
    """Number of path segments that aren't empty."""
    return F.size(F.filter(F.split(_part(url, 3), "/"), lambda s: s != ""))


def has_session_id(url: Column) -> Column:
    keys = F.transform(F.split(_part(url, 4), "&"), lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1))))
    return F.arrays_overlap(keys, F.array(*map(F.lit, SESSION_KEYS)))


def has_params(url: Column) -> Column:
    return _part(url, 4) != ""
