"""URL functions.  What the JVM can express is a column expression; path arithmetic is an Arrow function."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TRACKING = frozenset("utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid ref source trk spm from mkt_tok".split())
_INDEX = re.compile(r"/(?:index\.html?|index\.md|README\.md|readme\.md)$")


def normalised(url: str, drop: frozenset[str] = TRACKING, keep: frozenset[str] = frozenset(), https: bool = True) -> str:
    """Lower-cased host, https, no default port, fragment, tracking parameters or index page; sorted query, plain path."""
    parts = urlsplit(url.strip())
    scheme = parts.scheme.lower() or "https"
    scheme = "https" if https and scheme == "http" else scheme
    host = parts.netloc.lower()
    port = {"http": ":80", "https": ":443"}.get(scheme)
    host = host.removesuffix(port) if port else host
    query = sorted((k.lower(), v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() in keep or k.lower() not in drop)
    path = posixpath.normpath(re.sub("/{2,}", "/", parts.path or "/"))
    path = path if path.startswith("/") else "/" + path
    path = _INDEX.sub("", path).rstrip("/") or "/"
    return f"{scheme}://{host}{path}" + (f"?{urlencode(query)}" if query else "")


def resolved(target: str, base: str) -> str:
    """A link target against its page; fragments and targets with a scheme stay."""
    target = target.strip()
    if not target or target.startswith("#") or urlsplit(target).scheme:
        return target
    if base.startswith("dash://"):
        host, folder = urlsplit(base).netloc, base.rpartition("/")[0]
        return f"dash://{host}{target}" if target.startswith("/") else f"{folder}/{target}"
    return urljoin(base, target)


def normalise_url(url: Column) -> Column:
    @F.pandas_udf(StringType())
    def run(urls: pd.Series) -> pd.Series:
        return urls.map(normalised, na_action="ignore")

    return run(url)


def resolve_link(target: Column, base: Column) -> Column:
    @F.pandas_udf(StringType())
    def run(targets: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else resolved(t, b or "") for t, b in zip(targets, bases, strict=True)], dtype="object")

    return run(target, base)


def simple_normal(url: Column) -> Column:
    """The normal form for plain paths, inside the JVM."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^http://", "https://")
    path, query = F.split_part(bare, F.lit("?"), F.lit(1)), F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(sorted(TRACKING)))
    joined = F.array_join(F.array_sort(kept), "&")
    clean = F.regexp_replace(F.regexp_replace(path, r"/(?:index\.html?|index\.md|README\.md|readme\.md)$", ""), "/+$", "")
    host = F.regexp_extract(clean, "^(https://[^/]*)", 1)
    whole = F.when(clean == host, F.concat(F.lower(host), F.lit("/"))).otherwise(F.concat(F.lower(host), F.substring(clean, F.length(host) + 1, F.length(clean))))
    return F.when(joined != "", F.concat(whole, F.lit("?"), joined)).otherwise(whole)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1)), F.lit("default"))


def looks_like_document(url: Column) -> Column:
    path = F.lower(F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1))
    media = path.rlike(r"\.(?:png|jpe?g|gif|svg|webp|ico|css|js|map|json|xml|zip|tar|gz|tgz|7z)$")
    return ~media & (path.rlike(r"\.(?:html?|md|txt|pdf|docx)$") | ~path.endswith("/"))
