"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col, first_nonblank, strip, text

_PARTS = r"\A(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_TRACKING = r"(?i)\A(utm_|ref|fbclid|gclid)"


def _bare(c: Column | str) -> Column:
    s = F.lower(strip(text(c)))
    s = F.regexp_replace(s, r"\Ahttps?://", "")
    s = F.regexp_replace(s, r"\Awww\.", "")
    return F.substring_index(s, "#", 1)


def normalize_link(c: Column | str) -> Column:
    """Link part of the fingerprint: tracking parameters are dropped."""
    s = F.regexp_replace(_bare(c), r"[?&](utm_[^=]+|ref|fbclid|gclid)=[^&]*", "")
    return F.regexp_replace(s, r"[/?&]+\z", "")


def gate_link(c: Column | str) -> Column:
    """Link key of the duplicate check: parameters stay."""
    return F.regexp_replace(_bare(c), r"/+\z", "")


def merge_link(c: Column | str) -> Column:
    """Link key of the exact dedup: trimmed, case kept."""
    return F.regexp_replace(strip(text(c)), r"/+\z", "")


def _form_decode(c: Column) -> Column:
    plain = F.replace(c, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(c), plain)


def _form_encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_url(c: Column | str) -> Column:
    """One spelling per page: https, no www, sorted parameters, no tracking, no fragment."""
    s = strip(text(c))
    host = F.regexp_replace(F.lower(F.regexp_extract(s, _PARTS, 1)), r"\Awww\.", "")
    path = F.regexp_replace(F.regexp_extract(s, _PARTS, 2), r"/+\z", "")
    path = F.when(path == "", "/").otherwise(path)
    pairs = F.filter(F.split(F.regexp_extract(s, _PARTS, 3), "&"), lambda p: p.rlike(r"\A[^=]*=.") & ~p.rlike(_TRACKING))
    decoded = F.transform(pairs, lambda p: F.struct(
        _form_decode(F.substring_index(p, "=", 1)).alias("k"),
        _form_decode(F.regexp_replace(p, r"\A[^=]*=", "")).alias("v")))
    query = F.array_join(F.transform(F.array_sort(decoded), lambda kv: F.concat(
        _form_encode(kv["k"]), F.lit("="), _form_encode(kv["v"]))), "&")
    full = F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(s.rlike(r"(?i)\Ahttps?://"), full).otherwise(F.lower(s))


def is_http(c: Column | str) -> Column:
    return text(c).startswith("http")


def primary_url(*cs: Column | str) -> Column:
    """First field that holds an http(s) URL, else ''."""
    vals = [strip(text(c)) for c in cs]
    return F.coalesce(*[F.when(v.rlike(r"(?i)\Ahttps?://"), v) for v in vals], F.lit(""))


def url_domain(c: Column | str) -> Column:
    host = F.lower(F.regexp_extract(strip(text(c)), r"(?i)\Ahttps?://([^/?#]+)", 1))
    return F.regexp_replace(F.substring_index(host, ":", 1), r"\Awww\.", "")


def url_path(c: Column | str) -> Column:
    p = F.regexp_extract(strip(text(c)), r"(?i)\Ahttps?://[^/?#]+(/[^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def path_depth(c: Column | str) -> Column:
    return F.size(F.filter(F.split(url_path(c), "/"), lambda p: p != ""))


def fingerprint(name: Column | str, link: Column | str, website: Column | str) -> Column:
    """Stable identity of a record: name and link hashed together."""
    from .text import normalize_title
    basis = F.concat(normalize_title(name), F.lit("|"), normalize_link(first_nonblank(link, website)))
    return F.substring(F.sha1(basis), 1, 20)


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link found on a page."""
    root = F.regexp_extract(base, r"\A(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"\A(https?://[^/?#]+(?:/[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    scheme = F.regexp_extract(base, r"\A(https?:)", 1)
    return (F.when(href.rlike(r"\A[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, href))
            .when(href.startswith("/"), F.concat(root, href))
            .when(href.startswith("#"), F.concat(F.substring_index(base, "#", 1), href))
            .when(href.startswith("?"), F.concat(F.regexp_extract(base, r"\A([^?#]*)", 1), href))
            .otherwise(F.concat(folder, href)))


def absolute(base: str, c: Column | str) -> Column:
    """Prefix a site root to links that are not absolute."""
    v = col(c)
    return F.when((v != "") & ~v.startswith("http"), F.concat(F.lit(base), v)).otherwise(v)
