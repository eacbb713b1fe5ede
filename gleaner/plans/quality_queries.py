"""Dedup and plausibility queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import dedup, titles
from . import duck as D
from .registry import query

# The sequential rule, row by row: kept names and links travel with the recursion.
MERGE = f"""recursive
keyed as materialized (select seq, category, batch = 0 as known, md5({D.norm_name('name')}) as nk, length({D.norm_name('name')}) as nl, rtrim(trim(application_link), '/') as lk from opp),
inc as materialized (select *, row_number() over (order by seq) as rn from keyed where not known),
old as (select category, list(category || '|' || nk) as ns, list(category || '|' || lk) as ls from keyed where known group by category),
start as (select flatten(list(ns)) as ns, flatten(list(ls)) as ls from old),
walk(rn, ns, ls, seq, kept) as (
  select 0::bigint, ns, ls, -1::bigint, true from start
  union all
  select i.rn, case when i.ok then list_append(i.ns, i.category || '|' || i.nk) else i.ns end, case when i.ok then list_append(i.ls, i.category || '|' || i.lk) else i.ls end, i.seq, i.ok
  from (select x.rn, w.ns, w.ls, x.seq, x.category, x.nk, x.nl, x.lk,
    not ((x.nl > 4 and list_contains(w.ns, x.category || '|' || x.nk)) or (length(x.lk) > 10 and list_contains(w.ls, x.category || '|' || x.lk))) as ok
    from walk w join inc x on x.rn = w.rn + 1) i)"""


def _split(df):
    """Existing snapshot and incoming batch; together they are the whole table."""
    return df.where("batch = 0"), df.where("batch <> 0")


@query("merge_dedup", f"with {MERGE} select seq from walk where kept and seq >= 0")
def _(t):
    return dedup.merge_dedup(*_split(t.opp)).select("seq")


@query("feed_dedup", f"""with recursive
keyed as materialized (select seq, category || '|' || md5( trim(regexp_replace(lower(name), '[^{D.W}]+', ' ', 'g'))) as nk, category || '|' || lower(rtrim(application_link, '/')) as lk,
  trim(regexp_replace(lower(name), '[^{D.W}]+', ' ', 'g')) <> '' as hn, application_link <> '' as hl, row_number() over (order by seq) as rn from opp),
walk(rn, ns, ls, seq, kept) as (
  select 0::bigint, []::varchar[], []::varchar[], -1::bigint, true
  union all
  select i.rn, case when i.ok then list_append(i.ns, i.nk) else i.ns end, case when i.ok then list_append(i.ls, i.lk) else i.ls end, i.seq, i.ok
  from (select x.*, w.ns, w.ls, not ((hn and list_contains(w.ns, x.nk)) or (hl and list_contains(w.ls, x.lk))) as ok from walk w join keyed x on x.rn = w.rn + 1) i)
select seq from walk where kept and seq >= 0""")
def _(t):
    return dedup.feed_dedup(t.opp).select("seq")


# SQL is too slow for similar titles over whole texts: tests/test_dedup.py compares with a plain sequential fold.
@query("fuzzy_dedup")
def _(t):
    return titles.fuzzy_dedup(t.titles.where("known"), t.titles.where("not known")).select("seq")


@query("fuzzy_pairs")
def _(t):
    return titles.fuzzy_pairs(t.titles.where("known"), t.titles.where("not known"))


# ---- plausibility --------------------------------------------------------

from ..operators import plausibility as P  # noqa: E402
from .fixtures import AS_OF  # noqa: E402

_LEN = lambda c, n, p: f"case when length(trim(coalesce({c}, ''))) >= {n} then {p}::double else 0::double end"
_SCHEMA = ("least(1.0::double, " + " + ".join([_LEN("name", 3, 0.4)] + [_LEN(c, 3, 0.15) for c in ("application_link", "deadline", "source")]
           + [_LEN(c, 2, 0.025) for c in ("prize", "organizer", "description")] + ["case when len(tags) > 0 then 0.025::double else 0::double end"]) + ")")
_DUE = D.lenient(D.tail("deadline"))
_YEAR = "list_max(list_transform(regexp_extract_all(deadline, '\\b(20[0-9]{2})\\b', 1), lambda y: cast(y as int)))"
_DATE = (f"case when deadline = '' then 0.5 when {D.any_in('lower(deadline)', V.L1_SOFT_DATES)} then 0.8 when {_DUE} < date '{AS_OF}' then 0.0 "
         f"when {_DUE} > date '{AS_OF}' + 730 then 0.3 when {_DUE} is not null then 1.0 when {_YEAR} < {AS_OF[:4]} then 0.1 else 0.5 end::double")
_HAY = "lower(coalesce(name, '') || ' ' || coalesce(description, '') || ' ' || coalesce(prize, ''))"
_SOFT = " + ".join(f"case when contains({_HAY}, {D.q(t)}) then 1 else 0 end" for t in V.SOFT_SPAM)
_SPAM = (f"case when {D.any_in(_HAY, V.HARD_SPAM)} then 0.0::double else greatest(0.0::double, least(1.0::double, greatest(0.0::double, 1.0::double - ({_SOFT}) * 0.15::double) "
         f"- case when name = upper(name) and length(name) > 10 then 0.2::double else 0::double end - case when name <> '' and length(trim(name)) < 5 then 0.3::double else 0::double end)) end")


def _best(view, cap=None):
    """First URL field with text; the rows that are probed, all or the first of each category."""
    pick = "case when coalesce(application_link, '') <> '' then application_link when coalesce(url, '') <> '' then url else coalesce(website, '') end"
    rank = "row_number() over (partition by category order by seq)" if cap else "1"
    return f"""picked as (select *, {pick} as purl from {view}),
ranked as (select seq as rseq, {rank} as probe_rank from picked where purl like 'http%'),
capped as (select p.*, r.probe_rank from picked p left join ranked r on p.seq = r.rseq and r.probe_rank <= {cap or 1})"""


_CONTENT_WORDS = f"list_filter(list_distinct(regexp_extract_all(regexp_replace(lower(name), '[^a-z]*[^{D.W}]+[^a-z]*|^[^a-z]+|[^a-z]+$', ' ', 'g'), '[a-z]+')), lambda w: true)"
_L1_REST = f""",
landed as (select key, x.st as st, x.body as body from (select {D.canonical('url')} as key, arg_min({{'st': status, 'body': body}}, (tier, capture_id)) as x from captures_all group by 1)),
probed as (select c.*, l.st, l.body from capped c left join landed l on c.probe_rank is not null and l.key = {D.canonical('c.purl')}),
urled as (select *, case when purl not like 'http%' then 0.3 when probe_rank is null then 0.7 when st < 400 then 1.0 when st in (401, 403) then 0.7 else 0.2 end::double as s_url,
  list_filter(list_distinct(list_filter(regexp_split_to_array(lower(name), '[^{D.W}]+'), lambda w: regexp_matches(w, '^[a-z]{{4,}}$'))), lambda w: not list_contains({D.lst(V.CONTENT_GENERIC)}, w)) as cw from probed),
scored as (select *, {_SCHEMA} as s_schema, {_DATE} as s_date, {_SPAM} as s_spam,
  case when s_url < 0.5 or application_link not like 'http%' or name = '' then 0.5 when probe_rank is null then 0.7 when len(cw) < 2 then 0.6
    when st is null or st >= 400 then 0.5 when len(list_filter(cw, lambda w: contains(lower(body), w))) > 0 then 1.0 else 0.3 end::double as s_content from urled)"""
L1 = _best("opp_pages") + _L1_REST
L1_BATCH = "batch as (select * from opp_pages where batch <> 0),\n" + _best("batch") + _L1_REST


@query("l1_schema", f"select seq, round({_SCHEMA}, 6) as score from opp")
def _(t):
    df = t.opp
    return df.select("seq", F.round(P.schema_score(df), 6).alias("score"))


@query("l1_date", f"select seq, {_DATE} as score from opp")
def _(t):
    return t.opp.select("seq", P.date_score("deadline", AS_OF)[0].alias("score"))


@query("l1_spam", f"select seq, round({_SPAM}, 6) as score from opp")
def _(t):
    df = t.opp
    return df.select("seq", F.round(P.spam_score(df)[0], 6).alias("score"))


@query("probe_cap", f"with {_best('opp', 20)} select seq, probe_rank from capped")
def _(t):
    return P.probe_cap(t.opp).select("seq", "probe_rank")


@query("l1_url", f"with {L1} select seq, s_url as score from urled")
def _(t):
    return P.record_scores(t.opp_pages, t.captures_all, AS_OF).select("seq", F.col("s_url").alias("score"))


@query("l1_content", f"with {L1} select seq, s_content as score from scored")
def _(t):
    return P.record_scores(t.opp_pages, t.captures_all, AS_OF).select("seq", F.col("s_content").alias("score"))


def _total(f):
    base = f"s_schema * 0.25::double + s_url * 0.2::double + s_date * 0.15::double + s_content * 0.15::double + s_spam * 0.15::double + {f} * 0.1::double"
    base = f"case when s_spam = 0 then least({base}, 0.15::double) else {base} end"
    base = f"case when {f} = 0 then least({base}, 0.1::double) else {base} end"
    return f"case when s_date = 0 then least({base}, 0.2::double) else {base} end"


VERIFY = f"""recursive {L1_BATCH},
old as (select category, list_sort({D.sim_tokens('name')}) as ws from opp_pages where batch = 0),
toks as (select *, list_sort({D.sim_tokens('name')}) as ws, length({D.norm_title('name')}) as len from scored),
alone as (select *, case when len < 5 then 0.5::double else 1.0::double end as f1 from toks),
inc as (select *, {_total('f1')} >= 0.3 as eligible, row_number() over (order by seq) as rn from alone),
start as (select list({{'c': category, 'w': ws}}) as kept from old where len(ws) > 0),
walk(rn, kept, seq, dup) as (
  select 0::bigint, kept, -1::bigint, false from start
  union all
  select i.rn, case when i.eligible and not i.dup and len(i.ws) > 0 then list_append(i.kept, {{'c': i.category, 'w': i.ws}}) else i.kept end, i.seq, i.dup
  from (select x.*, w.kept, x.len >= 5 and len(x.ws) > 0 and len(list_filter(w.kept, lambda k: k.c = x.category
      and len(list_intersect(k.w, x.ws)) / (len(k.w) + len(x.ws) - len(list_intersect(k.w, x.ws))) >= 0.85)) > 0 as dup
    from walk w join inc x on x.rn = w.rn + 1) i),
judged as (select i.*, case when w.dup then 0.0::double else f1 end as s_fuzzy from inc i join walk w on i.seq = w.seq),
totals as (select *, {_total('s_fuzzy')} as total from judged),
verified as (select *, case when total < 0.3 then 'reject' when total < 0.6 then 'warn' else 'accept' end as outcome from totals)"""


def _verified(t):
    df = t.opp_pages
    return P.verify(df.where("batch <> 0"), df.where("batch = 0"), t.captures_all, AS_OF)


@query("l1_verify", f"with {VERIFY} select seq, category, round(total, 6) as total, outcome, s_fuzzy from verified")
def _(t):
    return _verified(t).select("seq", "category", F.round("raw_score", 6).alias("total"), "outcome", "s_fuzzy")


@query("l1_fuzzy", f"with {VERIFY} select seq, s_fuzzy as score from verified")
def _(t):
    return _verified(t).select("seq", F.col("s_fuzzy").alias("score"))


@query("l1_stats", f"with {VERIFY} select category, count(*) as total, count(*) filter (outcome <> 'reject') as accepted, count(*) filter (outcome = 'warn') as warned, count(*) filter (outcome = 'reject') as rejected from verified group by category")
def _(t):
    return P.l1_stats(_verified(t))
