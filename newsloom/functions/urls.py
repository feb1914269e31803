"""URL functions: native for http(s) addresses, a strict variant for the rest."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import for_match

#: Fixed value: query parameters that only track.
TRACKING = r"(?i)^(utm_.+|fbclid|gclid|mc_cid|mc_eid|ref|ref_src|ocid)$"
#: Fixed value: host endings of public bodies.
OFFICIAL = (".gov.br", ".leg.br", ".mp.br")


def canonical(url: Column) -> Column:
    """Without fragment and tracking parameters, scheme and host in lower case, default port dropped, at least the path "/".

    Text that is not an http(s) address comes back as it is.
    """
    web = url.rlike(r"(?i)^https?://[^/?#\s@]+")
    bare = F.regexp_replace(url, "(?s)#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"(?s)^([^/]+//[^/?]*)", 1))
    head = F.regexp_replace(F.regexp_replace(head, "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")
    rest = F.regexp_extract(bare, r"(?s)^[^/]+//[^/?]*(.*)$", 1)
    path = F.regexp_extract(rest, r"(?s)^([^?]*)", 1)
    query = F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1)
    parts = F.split(query, "&")
    kept = F.filter(parts, lambda p: (p != "") & ~F.regexp_extract(p, "(?s)^([^=]*)", 1).rlike(TRACKING))
    tracked = F.exists(parts, lambda p: F.regexp_extract(p, "(?s)^([^=]*)", 1).rlike(TRACKING))
    again = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    asked = F.when(tracked, again).when(rest.contains("?"), F.concat(F.lit("?"), query)).otherwise(F.lit(""))
    return F.when(web, F.concat(head, F.when(path == "", F.lit("/")).otherwise(path), asked)).otherwise(url)


def canonical_strict(url: Column) -> Column:
    """The same through a full parser: for other schemes, ports and encodings; queries are encoded anew only if something goes."""

    def one(value):
        try:
            u = urlsplit(value.strip())
            if not u.scheme or not u.hostname:
                return value
            pairs = parse_qsl(u.query, keep_blank_values=True)
            kept = [(k, v) for k, v in pairs if not re.match(TRACKING, k)]
            port = f":{u.port}" if u.port and (u.scheme, u.port) not in (("http", 80), ("https", 443)) else ""
            user = u.netloc.rpartition("@")[0]
            host = (user + "@" if user else "") + u.hostname + port
            return urlunsplit((u.scheme, host, u.path or "/", urlencode(kept) if len(kept) < len(pairs) else u.query, ""))
        except (ValueError, AttributeError):
            return value

    def run(urls: pd.Series) -> pd.Series:
        return urls.map(one, na_action="ignore")

    return F.pandas_udf(run, "string")(url)


def host(url: Column) -> Column:
    """Host in lower case; null where the address cannot be read."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def is_official(url: Column, endings: tuple[str, ...] = OFFICIAL) -> Column:
    out = F.lit(False)
    for ending in endings:
        out = out | host(url).endswith(ending)
    return F.coalesce(out, F.lit(False))


def absolute(value: Column, base: Column) -> Column:
    """An address relative to a base; the empty text where it cannot be built."""

    def one(value, base):
        try:
            out = urljoin(base, value)
            return out if urlsplit(out).scheme else ""
        except (ValueError, AttributeError, TypeError):
            return ""

    def run(values: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([one(v, b) for v, b in zip(values, bases)])

    return F.pandas_udf(run, "string")(value, base)


def item_id(url: Column, title: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(canonical(url), F.lit("")), F.lit("|"), for_match(title)), 256)
