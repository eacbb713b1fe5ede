"""DuckDB spellings used by the check queries.

They are written from the rules, not from the Spark expressions: regular
expressions are RE2 (no look-around, no back references).
"""

from __future__ import annotations

import re

from ..functions import vocab as V
from ..functions.dates import FORMATS
from .fixtures import AS_OF

W = r"\p{L}\p{N}_"
S = r"\s\p{Z}"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def strip(c):
    return f"regexp_replace({c}, '^[{S}]+|[{S}]+$', '', 'g')"


def collapse(c):
    return f"trim(regexp_replace({c}, '[{S}]+', ' ', 'g'))"


def norm_name(c):
    return collapse(f"lower(regexp_replace({c}, '[^{W}{S}-]', '', 'g'))")


def norm_title(c):
    return collapse(f"lower(regexp_replace({c}, '[^{W}{S}]', '', 'g'))")


def bare_link(c):
    return f"split_part(regexp_replace(regexp_replace(lower(trim({c})), '^https?://', ''), '^www\\.', ''), '#', 1)"


def norm_link(c):
    return f"regexp_replace(regexp_replace({bare_link(c)}, '[?&](utm_[^=]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '[/?&]+$', '')"


def gate_link(c):
    return f"rtrim({bare_link(c)}, '/')"


def fingerprint(name="name", link="application_link", site="website"):
    return f"substring(sha1({norm_title(name)} || '|' || {norm_link(f'case when coalesce({link},{q('')}) <> {q('')} then {link} else coalesce({site},{q('')}) end')}), 1, 20)"


def any_in(c, terms):
    return "(" + " or ".join(f"contains({c}, {q(t)})" for t in terms) + ")"


def any_word(c, terms):
    body = "|".join(re.escape(t).replace("\\ ", " ").replace("\\&", "&").replace("\\-", "-") for t in terms)
    return f"regexp_matches({c}, {q(f'(^|[^{W}])({body})($|[^{W}])')})"


def tokens(c):
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: length(w) > 2 and not list_contains({lst(V.GENERIC_TOKENS)}, w)))"


def title_key(c):
    return (f"array_to_string(list_sort(case when len({tokens(c)}) >= 2 then {tokens(c)} "
            f"else list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+')) end), ' ')")


def sim_tokens(c):
    return f"list_distinct(list_filter(string_split({norm_title(c)}, ' '), lambda w: w <> '' and not list_contains({lst(V.STOP_WORDS)}, w)))"


def jaccard(a, b):
    both = f"len(list_intersect({a}, {b}))"
    return f"case when len({a}) > 0 and len({b}) > 0 then {both} / (len({a}) + len({b}) - {both}) else 0.0 end"


def trust(c):
    items = sorted(V.SOURCE_TRUST.items(), key=lambda kv: -len(kv[0]))
    whens = " ".join(f"when contains(lower(trim({c})), {q(k)}) then {v}::double" for k, v in items)
    return f"case {whens} else {V.DEFAULT_TRUST}::double end"


def family(c):
    s = f"lower(trim(case when coalesce({c}, '') = '' then 'unknown' else {c} end))"
    whens = " ".join(f"when contains({s}, '{x}') and length(split_part({s}, '{x}', 1)) >= 4 then split_part({s}, '{x}', 1)" for x in ":/-")
    return f"case {whens} else {s} end"


def canonical(c):
    """https + host + path + sorted query without tracking."""
    p = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    host = f"regexp_replace(lower(regexp_extract({c}, {q(p)}, 1)), '^www\\.', '')"
    path = f"rtrim(regexp_extract({c}, {q(p)}, 2), '/')"
    pairs = (f"list_sort(list_filter(string_split(regexp_extract({c}, {q(p)}, 3), '&'), lambda x: regexp_matches(x, '^[^=]*=.') "
             f"and not regexp_matches(lower(x), '^(utm_|ref|fbclid|gclid)')))")
    return (f"case when regexp_matches({c}, '^https?://') then 'https://' || {host} || case when {path} = '' then '/' else {path} end || "
            f"case when len({pairs}) > 0 then '?' || array_to_string({pairs}, '&') else '' end else lower({c}) end")


def domain(c):
    return f"regexp_replace(split_part(lower(regexp_extract({c}, '^https?://([^/?#]+)', 1)), ':', 1), '^www\\.', '')"


def path(c):
    return f"case when regexp_extract({c}, '^https?://[^/?#]+(/[^?#]*)', 1) = '' then '/' else regexp_extract({c}, '^https?://[^/?#]+(/[^?#]*)', 1) end"


def depth(c):
    return f"len(list_filter(string_split({path(c)}, '/'), lambda x: x <> ''))"


def primary(*cs):
    return "coalesce(" + ", ".join(f"case when regexp_matches(lower(trim({c})), '^https?://') then trim({c}) end" for c in cs) + ", '')"


def mk_date(y, m, d):
    return f"try_cast({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') as date)"


def lenient(c, as_of=AS_OF):
    y0, m0, d0 = as_of.split("-")
    whens = []
    for pat, gy, gm, gd in FORMATS:
        g = lambda i: f"regexp_extract(lower({c}), {q(pat)}, {i})"
        y = g(gy) if gy else q(y0)
        m = f"case when regexp_matches({g(gm)}, '^[a-z]') then cast((instr('janfebmaraprmayjunjulaugsepoctnovdec', left({g(gm)}, 3)) + 2) // 3 as varchar) else {g(gm)} end"
        d = g(gd) if gd else q(str(int(d0)))
        whens.append(f"when regexp_matches(lower({c}), {q(pat)}) then {mk_date(y, m, d)}")
    return "case " + " ".join(whens) + " end"


def tail(c):
    return f"trim(list_last(regexp_split_to_array({c}, '[{S}]+[-–—][{S}]+|[{S}]+to[{S}]+|[–—]')))"


def claimed(c, as_of=AS_OF):
    iso = mk_date(*[f"split_part(trim({c}), '-', {i})" for i in (1, 2, 3)])
    return (f"case when trim({c}) = '' or {any_in(f'lower({c})', V.CLAIM_NON_DATE)} then null "
            f"when regexp_matches(trim({c}), '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') then {iso} "
            f"else coalesce({lenient(tail(c), as_of)}, {lenient(c, as_of)}) end")


def past(c, as_of=AS_OF):
    year = int(as_of[:4])
    return (f"case when {c} = '' or {any_in(f'lower({c})', V.NEVER_PAST)} then false "
            f"when list_max(list_transform(regexp_extract_all({c}, '\\b(202[0-9])\\b', 1), lambda y: cast(y as int))) < {year} then true "
            f"when {any_in(f'lower({c})', V.PAST_WORDS)} then true "
            f"when regexp_matches(trim({c}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') then coalesce(try_cast(trim({c}) as date) < date '{as_of}', false) "
            f"else coalesce({lenient(tail(c), as_of)} < date '{as_of}', false) end")


def iso(c):
    return f"coalesce(strftime({c}, '%Y-%m-%d'), '')"


def unescape(c):
    """The references that the given tables hold: amp, quot, copy, middot, lt, gt, nbsp and numbers, in one pass."""
    names = {"amp": "&", "quot": '"', "copy": "©", "middot": "·", "lt": "<", "gt": ">", "nbsp": "\u00a0"}
    bare = " ".join(f"when starts_with(x, {q(n)}) then {q(v)} || substring(x, {len(n) + 1} + case when substring(x, {len(n) + 1}, 1) = ';' then 1 else 0 end)" for n, v in names.items())
    number = "when regexp_matches(x, '^#[0-9]+;') then chr(cast(regexp_extract(x, '^#([0-9]+);', 1) as int)) || regexp_replace(x, '^#[0-9]+;', '')"
    pieces = f"list_transform(string_split({c}, '&')[2:], lambda x: case {bare} {number} else '&' || x end)"
    return f"(string_split({c}, '&')[1] || array_to_string({pieces}, ''))"


def visible(c):
    out = c
    for tag in ("script", "style", "noscript", "template"):
        out = f"regexp_replace({out}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    out = unescape(f"regexp_replace({out}, '<[^>]+>', ' ', 'g')")
    return f"regexp_replace({out}, '[{S}]+', ' ', 'g')"


def clean(c):
    return collapse(unescape(c))


def cascade(c, rules, default):
    whens = " ".join(f"when {any_in(c, terms)} then {q(name)}" for name, terms in rules.items())
    return f"case {whens} else {q(default)} end"


def first_match(c, patterns, group=1):
    """First matching pattern; Java's end-of-input becomes RE2's."""
    return "coalesce(" + ", ".join(
        f"case when regexp_matches({c}, {q(p)}) then regexp_extract({c}, {q(p)}, {group}) end" for p in patterns) + ")"
