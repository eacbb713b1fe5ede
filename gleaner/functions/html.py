"""HTML expressions.  Whole pages are read; nothing is cut before matching."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, functions as F

from .text import collapse, let, strip, text


# Standard tables of the language; the frequent names first, as a literal map is searched in order.
_FREQUENT = ["amp", "lt", "gt", "quot", "apos", "nbsp", "copy", "middot", "ndash", "mdash", "hellip", "rsquo", "lsquo", "ldquo", "rdquo", "bull", "reg", "trade"]
_NAMES = {n[:-1]: v for n, v in html5.items() if n.endswith(";")}
_ORDERED = {**{n: _NAMES[n] for n in _FREQUENT}, **_NAMES}
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)   # names that need no semicolon
_WINDOWS = {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}   # what such numbers stand for


def _constant_map(pairs: dict[str, str]) -> Column:
    """A map from one text literal; it is folded when the query is planned."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in pairs.items())), F.lit("\x01"), F.lit("\x02"))


def _character(code: Column) -> Column:
    """The character that a number (as text) stands for, '' for control characters."""
    def of(n: Column) -> Column:
        control = (n < 9) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | ((n % 65536) >= 65534)
        return (F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd").when(n == 13, "\r")
                .when(n.between(0x80, 0x9F), _constant_map(_WINDOWS)[n.cast("string")]).when(control, "")
                .otherwise(F.decode(F.unhex(F.lpad(F.conv(n.cast("string"), 10, 16), 8, "0")), "UTF-32")))

    return let(code.cast("decimal(38,0)"), of)


def unescape(c: Column) -> Column:
    """Decode character references in one pass, by the full standard table; decoded text is not decoded again."""
    table, bare = _constant_map(_ORDERED), _constant_map({n: html5[n] for n in _BARE})

    def decode(piece: Column) -> Column:
        """A piece that followed an ampersand."""
        number = F.regexp_extract(piece, r"\A#(?:(\d+)|[xX]([0-9a-fA-F]+))(;?)", 0)
        digits = F.regexp_replace(number, ";", "")
        code = F.when(F.lower(digits).startswith("#x"), F.conv(F.substring(digits, 3, 40), 16, 10)).otherwise(F.substring(digits, 2, 40))
        name = F.regexp_extract(piece, r"\A([A-Za-z][A-Za-z0-9]*);", 1)
        short = F.regexp_extract(piece, r"\A(" + "|".join(_BARE) + ")", 1)
        after = lambda n: F.substring(piece, n + 1, F.length(piece))
        # a name that is not in the table may begin with one that needs no semicolon
        return F.when(number != "", F.concat(_character(code), after(F.length(number)))).otherwise(
            F.coalesce(F.concat(table[name], after(F.length(name) + 1)), F.concat(bare[short], after(F.length(short))), F.concat(F.lit("&"), piece)))

    def pieces(s: Column) -> Column:
        parts = F.split(s, "&")
        decoded = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), decode)
        return F.concat(F.get(parts, F.lit(0)), F.array_join(decoded, ""))

    return let(c, lambda s: F.when(F.contains(s, F.lit("&")), pieces(s)).otherwise(s))


def drop_hidden(c: Column) -> Column:
    return F.regexp_replace(c, r"(?is)<(script|style|noscript|template)[^>]*>.*?</\1>", " ")


def visible_text(c: Column | str) -> Column:
    """What a reader sees, on one line."""
    body = F.regexp_replace(drop_hidden(text(c)), r"<[^>]+>", " ")
    return F.regexp_replace(unescape(body), r"[\s\p{Z}]+", " ")


def strip_html(c: Column | str) -> Column:
    """Readable plain text that keeps line breaks."""
    s = drop_hidden(text(c))
    s = F.regexp_replace(s, r"(?i)<br\s*/?>|</p>|</div>|</li>", "\n")
    s = unescape(F.regexp_replace(s, r"<[^>]+>", " "))
    s = F.regexp_replace(s, r"[ \t\f\x0B]+", " ")
    return strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def clean_text(c: Column | str) -> Column:
    return collapse(unescape(text(c)))


def element_text(c: Column, tag: str) -> Column:
    return F.regexp_extract(c, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)


def meta_pairs(c: Column) -> Column:
    """All (key, content) pairs of meta tags in page order."""
    tags = F.regexp_extract_all(c, F.lit(r"(?i)(<meta\s[^>]*>)"), F.lit(1))
    key, val = r"""(?i)(?:property|name)\s*=\s*["']([^"']+)["']""", r"""(?i)content\s*=\s*["']([^"']*)["']"""
    pairs = F.transform(tags, lambda t: F.struct(
        F.lower(strip(F.regexp_extract(t, key, 1))).alias("key"),
        F.regexp_extract(t, val, 1).alias("content"), t.rlike(val).alias("ok")))
    return F.filter(pairs, lambda p: p["ok"] & (p["key"] != ""))


def meta_value(pairs: Column, key: str) -> Column:
    """Content of the first tag with that key."""
    return F.get(F.filter(pairs, lambda p: p["key"] == key), F.lit(0))["content"]
