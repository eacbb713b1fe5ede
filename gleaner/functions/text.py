"""Text expressions: names, tokens, term tests, sources."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import vocab as V

WORD = r"\p{L}\p{N}_"        # Unicode word characters, without combining marks
SPACE = r"\s\p{Z}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Missing and empty are the same everywhere."""
    return F.coalesce(col(c), F.lit(""))


def quoted(terms: Iterable[str]) -> str:
    """SQL list of string literals."""
    return ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in terms)


def lits(terms: Iterable[str]) -> Column:
    """Constant array of strings, parsed in one step."""
    return F.expr(f"array({quoted(terms)})")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however often filters and later columns use them.

    A generator keeps the optimizer from writing the expression out at each use.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def head(items: Column, n: Column | int | None) -> Column:
    """The first ``n`` items, or all."""
    return items if n is None else F.slice(items, 1, n)


def first_nonblank(*cs: Column | str) -> Column:
    """First value that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs], F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"[{SPACE}]+", " "))


def normalize_name(c: Column | str) -> Column:
    """Name key of the exact dedup: keeps hyphens."""
    return collapse(F.lower(F.regexp_replace(text(c), rf"[^{WORD}{SPACE}-]", "")))


def normalize_title(c: Column | str) -> Column:
    """Name key of memory, gate and similarity: drops hyphens."""
    return collapse(F.lower(F.regexp_replace(text(c), rf"[^{WORD}{SPACE}]", "")))


def contains_any(c: Column, terms: Iterable[str]) -> Column:
    """Plain substring test; the text is computed once, however many terms there are."""
    terms = list(terms)
    if len(terms) < 3:
        return reduce(lambda a, b: a | b, [c.contains(t) for t in terms], F.lit(False))
    return let(c, lambda v: F.exists(lits(terms), lambda t: F.contains(v, t)))


def has_word(c: Column, terms: Iterable[str]) -> Column:
    """Any of the terms with no word character on either side.

    The cheap substring test decides most rows before the expression runs.
    """
    terms = list(terms)
    body = "|".join(re.escape(t) for t in terms)
    return contains_any(c, terms) & c.rlike(rf"(?<![{WORD}])(?:{body})(?![{WORD}])")


def found_terms(c: Column, terms: list[str]) -> Column:
    """The listed terms that occur in the text, in listed order."""
    return let(c, lambda v: F.filter(lits(terms), lambda t: F.contains(v, t)))


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit("([a-z0-9]+)"), F.lit(1))


def distinctive_tokens(c: Column | str) -> Column:
    """Distinct words over two letters that are not filler."""
    return F.array_except(F.filter(words(c), lambda w: F.length(w) > 2), lits(V.GENERIC_TOKENS))


def title_key(c: Column | str) -> Column:
    """Order-free title key; short titles fall back to all their words."""
    best = let(distinctive_tokens(c), lambda t: F.when(F.size(t) >= 2, t).otherwise(F.array_distinct(words(c))))
    return F.array_join(F.array_sort(best), " ")


def similarity_tokens(c: Column | str) -> Column:
    """Distinct words of the normalised title without stop words."""
    return F.array_except(F.split(normalize_title(c), " "), lits([*V.STOP_WORDS, ""]))


def _shared(a: Column, b: Column, share: Callable[[Column, Column, Column], Column]) -> Column:
    """``share`` of the two sizes and the number of common words, 0 if a side has none; either side is computed once."""
    sizes = lambda s: F.struct(F.size(s["a"]).alias("a"), F.size(s["b"]).alias("b"), F.size(F.array_intersect(s["a"], s["b"])).alias("both"))
    return let(let(F.struct(a.alias("a"), b.alias("b")), sizes),
               lambda n: F.when((n["a"] > 0) & (n["b"] > 0), share(n["a"], n["b"], n["both"])).otherwise(F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    return _shared(a, b, lambda n, m, both: both / (n + m - both))


def containment(claim: Column, page: Column) -> Column:
    return _shared(claim, page, lambda n, m, both: both / n)


def source_family(c: Column | str) -> Column:
    """Origin of a source: text before ':', '/' or '-' when that head has four letters."""
    def head_of(s: Column) -> Column:
        out = s
        for sep in ("-", "/", ":"):
            head = F.substring_index(s, sep, 1)
            out = F.when(F.contains(s, F.lit(sep)) & (F.length(head) >= 4), head).otherwise(out)
        return out

    return let(F.lower(F.trim(first_nonblank(c, F.lit("unknown")))), head_of)


def source_trust(c: Column | str) -> Column:
    """Trust of a source: the longest listed key that occurs in it."""
    def look_up(s: Column) -> Column:
        keys = sorted(V.SOURCE_TRUST, key=lambda k: -len(k))   # stable: the first listed wins a tie
        hit = F.get(F.filter(lits(keys), lambda k: F.contains(s, k)), F.lit(0))
        values = F.expr("array(" + ", ".join(f"{V.SOURCE_TRUST[k]}D" for k in keys) + ")")
        return F.when(hit.isNull(), F.lit(V.DEFAULT_TRUST)).otherwise(F.get(values, (F.array_position(lits(keys), hit) - 1).cast("int")))

    return let(F.lower(F.trim(text(c))), look_up)


def cascade(c: Column, rules: dict[str, list[str]], default: str) -> Column:
    """First rule with a matching term names the class."""
    def pick(v: Column) -> Column:
        out = F.lit(default)
        for name, terms in reversed(rules.items()):
            out = F.when(F.exists(lits(terms), lambda t: F.contains(v, t)), F.lit(name)).otherwise(out)
        return out

    return let(c, pick)


def first_match(c: Column, patterns: list[str], group: int = 1) -> Column:
    """First pattern that matches gives the value, else null."""
    return F.coalesce(*[F.when(c.rlike(p), F.regexp_extract(c, p, group)) for p in patterns])


def strip_markdown(c: Column | str) -> Column:
    plain = F.regexp_replace(text(c), r"[*_~`]", "")
    return strip(F.regexp_replace(plain, r"\[([^\]]*)\]\([^)]*\)", "$1"))


def extract_url(c: Column | str) -> Column:
    """First markdown link target, else first plain URL, else ''."""
    s = text(c)
    link = F.regexp_extract(s, r"\]\((https?://[^)]+)\)", 1)
    return strip(F.when(link != "", link).otherwise(F.regexp_extract(s, r"""(https?://[^\s)\]"'>]+)""", 1)))


def clean_title(c: Column | str) -> Column:
    s = collapse(text(c))
    s = F.regexp_replace(s, r"\A[#*\-•\d.\s]+", "")
    return F.trim(F.regexp_replace(s, r"[|·–—]\s*\z", ""))


def plausible_title(c: Column | str) -> Column:
    """Eight characters, three letters in a row, no navigation word, no URL."""
    return let(text(c), lambda s: (
        (F.length(s) >= 8) & ~F.lower(s).isin(V.NAV_WORDS) & s.rlike("[A-Za-z]{3}") & ~s.rlike(r"(?i)\A(http|www\.|data:)")))


def news_announcement(title: Column, summary: Column) -> Column:
    """A strong term alone, or a weak term together with a call to apply."""
    return let(F.lower(F.concat_ws(" ", text(title), text(summary))), lambda hay: (
        contains_any(hay, V.STRONG_NEWS) | (contains_any(hay, V.WEAK_NEWS) & contains_any(hay, V.APPLY_SIGNALS))))


def deadline_in_text(c: Column | str) -> Column:
    return first_match(text(c), V.DEADLINE_PATTERNS)


def reward_in_text(c: Column | str) -> Column:
    """First reward pattern whose value is shorter than 40 characters."""
    s = text(c)
    vals = [F.when(s.rlike(p), strip(F.regexp_extract(s, p, 1))) for p in V.REWARD_PATTERNS]
    return F.coalesce(*[let(v, lambda x: F.when(F.length(x) < 40, x)) for v in vals])


def url_in_post(url: Column | str, body: Column | str) -> Column:
    """The post's own external URL, else the first known URL in its body."""
    own = text(url)
    internal = own.contains("reddit.com") | own.contains("redd.it")
    found = F.regexp_replace(first_match(text(body), V.POST_URL_PATTERNS, 0), r"[).,;]+\z", "")
    return F.when((own != "") & ~internal, own).otherwise(found)


def status_mark(c: Column | str) -> Column:
    out = F.lit("⚪")
    for status, mark in V.STATUS_MARKS.items():
        out = F.when(col(c) == status, F.lit(mark)).otherwise(out)
    return out
