"""URLs as columns."""

from __future__ import annotations

from urllib.parse import quote, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def _recoded(part: Column) -> Column:
    """A form value decoded and encoded again; one that can't be decoded is encoded as it stands."""
    return F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(part), part)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _pair(p: Column) -> Column:
    name, value = F.regexp_extract(p, "^([^=]*)", 1), F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)
    return F.concat(_recoded(name), F.lit("="), _recoded(value))


def canonical(url: Column) -> Column:
    """Scheme and authority lower-cased, repeated slashes collapsed, the query encoded anew; the last path segment's parameters,
    utm_ values and the fragment are dropped.

    //host gets https; a URL without a scheme is returned as it is.
    """
    trimmed = F.trim(url)
    full = F.when(trimmed.startswith("//"), F.concat(F.lit("https:"), trimmed)).otherwise(trimmed)
    bare = F.regexp_replace(full, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), ";[^/]*$", "")
    path = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "/{2,}", "/"))
    pairs = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: p != "")
    kept = F.filter(F.transform(pairs, _pair), lambda p: ~F.lower(p).startswith("utm_"))
    whole = F.concat(scheme, F.lit("://"), authority, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(scheme == "", url).otherwise(whole)


def host(url: Column) -> Column:
    """Lower-case host in ASCII, without user, port, trailing dot and a leading www.; null where there is none."""
    whole = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(whole), "^.*@", ""), r":\d*$", ""), r"\.$", "")
    name = F.regexp_replace(bare, r"^www\.", "")
    ascii_name = F.when(name.rlike(r"[^\x00-\x7f]"), F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), name)).otherwise(name)
    return F.nullif(F.lower(ascii_name), F.lit(""))


def authority(url: Column) -> Column:
    return F.coalesce(F.lower(_part(url, "AUTHORITY")), F.lit(""))


def is_internal(url: Column, site: Column) -> Column:
    """http or https, and the host of url is that of site or lies below it."""
    own, other = host(site), host(url)
    return F.coalesce(url.rlike("(?i)^https?:") & ((other == own) | other.endswith(F.concat(F.lit("."), own))), F.lit(False))


def is_navigation(url: Column) -> Column:
    """Not a mail, telephone or same-page link."""
    return ~F.lower(url).rlike("^(mailto:|tel:|#)")


def is_image(url: Column, hosts: tuple[str, ...]) -> Column:
    """An absolute image on one of the hosts."""
    return F.coalesce(F.lower(_part(url, "PROTOCOL")).isin("http", "https") & F.lower(_part(url, "HOST")).isin(*hosts) & F.lower(_part(url, "PATH")).rlike(r"\.(jpe?g|png|gif|webp|tiff?)$"), F.lit(False))


def image_address(url: Column) -> Column:
    """https, without query or fragment."""
    return F.concat(F.lit("https://"), F.lower(_part(url, "HOST")), _part(url, "PATH"))


def resolved(base: Column, reference: Column) -> Column:
    """A reference against its page for the usual forms: absolute, //host, /path, ?query, #fragment, relative."""
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    plain = F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(F.length(plain) > F.length(origin), F.regexp_replace(plain, "[^/]*$", "")).otherwise(F.concat(origin, F.lit("/")))
    return (
        F.when(reference.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), reference)
        .when(reference.startswith("//"), F.concat(scheme, reference))
        .when(reference.startswith("/"), F.concat(origin, reference))
        .when(reference.startswith("?"), F.concat(plain, reference))
        .when(reference.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), reference))
        .when(reference == "", base)
        .otherwise(F.concat(folder, reference))
    )


@F.pandas_udf(StringType())
def joined(base: pd.Series, reference: pd.Series) -> pd.Series:
    """Any reference against its page, dot segments included."""
    return pd.Series([None if b is None or r is None else urljoin(b, r) for b, r in zip(base, reference, strict=True)])


def safe_address(url: str) -> str:
    """An address with path and query decoded and encoded again; the last segment's parameters and the fragment are dropped."""
    p = urlsplit(url)
    folder, _, last = p.path.rpartition("/")
    path = f"{folder}/{last.partition(';')[0]}" if "/" in p.path else p.path.partition(";")[0]
    return p._replace(path=quote(unquote(path), safe="/%"), query=quote(unquote(p.query), safe="=&?/:+,%"), fragment="").geturl()


@F.pandas_udf(StringType())
def safe(url: pd.Series) -> pd.Series:
    """safe_address of each."""
    return url.map(safe_address, na_action="ignore")


def with_parameter(url: Column, name: str, value: Column) -> Column:
    sign = F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.concat(url, sign, F.lit(f"{name}="), F.url_encode(value.cast("string")))
