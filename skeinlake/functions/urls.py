"""Sort-friendly URL keys.

Rules follow the published descriptions of wayback-style canonicalisation: lower case, no scheme,
user, ``www`` label, default port or fragment, host labels reversed, query parameters in order,
session ids of 32 characters dropped. Lookup keys come in two families that differ in trailing slashes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SESSION = r"^(jsessionid|phpsessid|sid)=[0-9a-z]{32}$"


def _pieces(url: Column) -> tuple[Column, Column, Column]:
    """(reversed host with port, path, query) of a URL with an authority."""
    low = F.regexp_replace(F.lower(F.trim(url)), r"#.*$", "")
    bare = F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://", "")
    authority = F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^[^@]*@", "")
    authority = F.when(low.startswith("https://"), F.regexp_replace(authority, r":443$", "")).otherwise(F.regexp_replace(authority, r":80$", ""))
    six = authority.startswith("[")
    named = F.regexp_replace(authority, r"^www[0-9]*\.", "")
    host, port = F.regexp_extract(named, r"^([^:]*)", 1), F.regexp_extract(named, r"(:[0-9]+)$", 1)
    four = host.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    flipped = F.when(four, host).otherwise(F.array_join(F.reverse(F.split(host, r"\.")), ","))
    key = F.when(six, F.regexp_replace(authority, r"[\[\]]", "")).otherwise(F.concat(flipped, port))
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.when(rest.contains("?"), F.regexp_replace(rest, r"^[^?]*\?", ""))
    return key, path, query


def _key(url: Column, keep_slash: bool) -> Column:
    host, path, query = _pieces(url)
    path = F.when((path == "") | (path == "/"), "/").otherwise(path if keep_slash else F.regexp_replace(path, r"/+$", ""))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: ~p.rlike(SESSION) & (p != "")))
    tail = F.when(query.isNotNull() & (F.size(kept) > 0), F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(host, F.lit(")"), path, tail)


def surt_wayback(url: Column) -> Column:
    return _key(url, False)


def surt_warcio(url: Column) -> Column:
    """As surt_wayback, but a trailing slash stays."""
    return _key(url, True)


def lookup_keys(url: Column) -> Column:
    return F.array_distinct(F.array(surt_wayback(url), surt_warcio(url)))


def is_http(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://[^/]")


def key_sql(url: str, keep_slash: bool) -> str:
    """DuckDB text of the same key for a column or literal."""
    low = f"regexp_replace(lower(trim({url})), '#.*$', '')"
    bare = f"regexp_replace({low}, '^[a-z][a-z0-9+.-]*://', '')"
    auth0 = f"regexp_replace(regexp_extract({bare}, '^([^/?]*)', 1), '^[^@]*@', '')"
    auth = f"(CASE WHEN {low} LIKE 'https://%' THEN regexp_replace({auth0}, ':443$', '') ELSE regexp_replace({auth0}, ':80$', '') END)"
    named = f"regexp_replace({auth}, '^www[0-9]*\\.', '')"
    host, port = f"regexp_extract({named}, '^([^:]*)', 1)", f"regexp_extract({named}, '(:[0-9]+)$', 1)"
    flipped = f"(CASE WHEN regexp_matches({host}, '^[0-9]+(\\.[0-9]+){{3}}$') THEN {host} ELSE array_to_string(list_reverse(string_split({host}, '.')), ',') END)"
    key = f"(CASE WHEN {auth} LIKE '[%' THEN regexp_replace({auth}, '[\\[\\]]', '', 'g') ELSE {flipped} || {port} END)"
    rest = f"regexp_replace({bare}, '^[^/?]*', '')"
    path = f"regexp_extract({rest}, '^([^?]*)', 1)"
    query = f"(CASE WHEN contains({rest}, '?') THEN regexp_replace({rest}, '^[^?]*\\?', '') END)"
    shown = path if keep_slash else f"regexp_replace({path}, '/+$', '')"
    kept = f"list_sort(list_filter(string_split({query}, '&'), lambda p: NOT regexp_matches(p, '{SESSION}') AND p <> ''))"
    return (f"{key} || ')' || (CASE WHEN {path} IN ('', '/') THEN '/' ELSE {shown} END) || "
            f"(CASE WHEN {query} IS NOT NULL AND len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END)")
