"""Search, ranking, matching and feature-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import facets as Q
from . import duck as D
from .registry import query

_TAGS = "lower(array_to_string(tags, ' '))"


def _hay(*cols, tags=True):
    body = " || ' ' || ".join(f"coalesce({c}, '')" for c in cols)
    return f"lower({body})" + (f" || ' ' || {_TAGS}" if tags else "")


def _filter(name, variants, spark_test, sql_test):
    """One row per record and variant that keeps it."""
    body = "\nunion all ".join(f"select seq, '{v}' as choice from opp where {sql_test(v)}" for v in variants)

    @query(name, body)
    def run(t):
        flags = F.array_compact(F.array(*[F.when(spark_test(v), F.lit(v)) for v in variants]))
        return t.opp.select("seq", F.explode(flags).alias("choice"))


_filter("filter_search", ["python", "remote", "org 1"], Q.matches_search, lambda v: f"contains({_hay('name', 'organizer', 'description', 'location')}, '{v}')")
_filter("filter_status", ["all", "open", "closed"], Q.matches_status, lambda v: "true" if v == "all" else f"status = '{v}'")
_filter("filter_domain", list(V.DOMAINS), Q.matches_domain, lambda v: D.any_in(f"({_hay('name', 'description')})", V.DOMAINS[v]))
_LEGACY = _hay("location", "mode", "location_label", tags=False)
_STRUCT = {"remote": "location_mode = 'remote'", "india": "upper(country) = 'IN'", "usa": "upper(country) = 'US'", "canada": "upper(country) = 'CA'",
           "europe": f"list_contains({D.lst(V.EUROPE)}, upper(country))", "international": "country <> '' and upper(country) <> 'IN'"}
_LOC = lambda v: f"case when location_mode <> '' or country <> '' then {_STRUCT[v]} else {D.any_in(_LEGACY, V.LOCATION_HINTS[v]) if v in V.LOCATION_HINTS else 'true'} end"
_filter("filter_location", list(_STRUCT), Q.matches_location, _LOC)
_LEVEL = _hay("name", "eligibility", "description")
_filter("filter_level", [*V.LEVELS, "off-season"], Q.matches_level, lambda v: D.any_in(f"({_LEVEL})", V.LEVELS[v]) if v in V.LEVELS else "true")
_COMP = _hay("stipend", "prize", "fee", tags=False)
_filter("filter_compensation", ["paid", "free"], Q.matches_compensation,
        lambda v: D.any_in(_COMP, V.PAID_MARKS) if v == "paid" else f"not (contains({_COMP}, 'fee') and not contains({_COMP}, 'free'))")
_MODES = {"online": ["remote", "remote_geo"], "in-person": ["onsite"], "hybrid": ["hybrid"]}
_filter("filter_work_mode", list(_MODES), Q.matches_work_mode,
        lambda v: f"case when location_mode <> '' then list_contains({D.lst(_MODES[v])}, location_mode) else {D.any_in(_LEGACY, V.MODE_HINTS[v])} end")
_CHIP = lambda v: "status = 'open'" if v == "open" else D.any_in(f"({_hay('name', 'description', 'location', 'stipend', 'prize')})", V.CHIPS[v])
_filter("filter_chips", [*V.CHIPS, "open"], lambda v: Q.matches_chips([v]), _CHIP)

_SPEC = Q.FacetSpec(search="e", status="open", domain="swe", location="international", level="off-season", compensation="free", mode="online", chips=["open"], sort="default", pages=2)


@query("faceted_query", f"""with f as (select * from opp where contains({_hay('name', 'organizer', 'description', 'location')}, 'e') and status = 'open'
  and {D.any_in(f"({_hay('name', 'description')})", V.DOMAINS['swe'])} and {_LOC('international')} and not (contains({_COMP}, 'fee') and not contains({_COMP}, 'free'))
  and case when location_mode <> '' then location_mode in ('remote', 'remote_geo') else {D.any_in(_LEGACY, V.MODE_HINTS['online'])} end),
r as (select *, row_number() over (order by status <> 'open', seq) as position, count(*) over () as total from f) select seq, name, position, total from r where position <= 72""")
def _(t):
    return Q.faceted_query(t.opp, _SPEC).select("seq", "name", "position", "total")


@query("paginate", "with r as (select *, row_number() over (order by status <> 'open', seq) as position, count(*) over () as total from opp) select seq, position, total from r where position <= 108")
def _(t):
    return Q.page(t.opp, "default", 3).select("seq", "position", "total")


@query("sort_facets", "select seq, status, name from opp order by status <> 'open', seq")
def _(t):
    return Q.order_by(t.opp, "default").select("seq", "status", "name")


@query("filter_active", "select seq, status from opp where status in ('open', 'coming-soon')")
def _(t):
    return Q.active(t.opp).select("seq", "status")


_RE2_CASH = V.CASH_PATTERN


@query("filter_cash_prize", f"select seq, prize from opp where status in ('open', 'coming-soon') and category in ('hackathons', 'competitions') and regexp_matches(trim(prize), {D.q(_RE2_CASH)})")
def _(t):
    return Q.cash_prizes(t.opp).select("seq", "prize")


@query("filter_stipend", f"select seq, stipend from opp where status in ('open', 'coming-soon') and category in ('open-source-programs', 'fellowships') and regexp_matches(trim(stipend), {D.q(V.STIPEND_PATTERN)})")
def _(t):
    return Q.stipends(t.opp).select("seq", "stipend")


_JOBS = f"""acts as (select * from opp where status in ('open', 'coming-soon') and category = 'internships'),
tracks as (select * from acts where {D.any_in('lower(name)', V.FEATURED_EMPLOYERS)} or (select count(*) from acts where {D.any_in('lower(name)', V.FEATURED_EMPLOYERS)}) = 0)"""


@query("filter_job_tracks", f"with {_JOBS} select seq, name from tracks")
def _(t):
    return Q.job_tracks(t.opp).select("seq", "name")


def _first(*cs, default):
    whens = " ".join(f"when coalesce({c}, '') <> '' then {c}" for c in cs)
    return f"replace(case {whens} else '{default}' end, '|', '-')"


def _cells_sql():
    out = []
    for i in range(4):
        whens = " ".join(f"when category = '{cat}' then {_first(*cells[i][0], default=cells[i][1])}" for cat, cells in Q._CELLS.items())
        out.append(f"case {whens} else '' end as cell{i + 1}")
    return ", ".join(out)


@query("topk_category", f"""with r as (select *, row_number() over (partition by category order by seq) as rank from opp where status in ('open', 'coming-soon'))
select category, rank, replace(name, '|', '-') as name, {_cells_sql()}, case status when 'coming-soon' then '🟡 Soon' else '🟢 Open' end as status, {_first('application_link', 'website', default='#')} as link
from r where rank <= case when category in ('competitions', 'fellowships') then 8 else 12 end""")
def _(t):
    return Q.feature_tables(t.opp)


def _reward(kind, src, cells):
    rank = "row_number() over (order by list_position(" + D.lst(V.CATEGORIES) + ", category), seq)"
    cols = ", ".join(f"{c} as cell{i + 1}" for i, c in enumerate(cells))
    return f"select * from (select '{kind}' as kind, {rank} as rank, replace(name, '|', '-') as name, {cols}, {_first('application_link', 'website', default='#')} as link from {src}) where rank <= 10"


@query("topk_rewards", f"with {_JOBS} " + "\nunion all ".join([
    _reward("cash", f"opp where status in ('open', 'coming-soon') and category in ('hackathons', 'competitions') and regexp_matches(trim(prize), {D.q(_RE2_CASH)})",
            ["case when list_contains(tags, 'hackathon') then '🏆 Hackathon' else '⚔️ Contest' end", _first("prize", default="Cash Prize"), _first("mode", default="Online"), _first("deadline", default="Check page")]),
    _reward("stipend", f"opp where status in ('open', 'coming-soon') and category in ('open-source-programs', 'fellowships') and regexp_matches(trim(stipend), {D.q(V.STIPEND_PATTERN)})",
            [_first("organizer", default="Open Source"), _first("stipend", default="Stipend Provided"), _first("duration", default="10-12 weeks"), _first("eligibility", default="Students & Developers")]),
    _reward("job", "tracks", [_first("location", "mode", default="Various"), _first("eligibility", default="Students / New Grads"), _first("stipend", default="Competitive"), "''"])]))
def _(t):
    return Q.reward_tables(t.opp)


_RESUME = "Python and React developer with AWS, Docker, C++ and machine learning; research internship in the cloud, le des the ist und"
_KW = D.lst(Q.resume_keywords(_RESUME))
_MHAY = f"({_hay('name', 'description', 'location')} || ' ' || {_hay('eligibility', 'organizer', tags=False)})"
_N = min(len(Q.resume_keywords(_RESUME)), 15)


@query("match_score", f"""with h as (select seq, list_filter({_KW}, lambda k: contains({_MHAY}, k)) as hits from opp)
select seq, case when len(hits) = 0 then 50 else least(99, greatest(50, floor(len(hits) / {_N} * 65 + len(list_filter(hits, lambda k: list_contains({D.lst(V.RESUME_TECH)}, k))) * 1.5 * 5 + 45 + 0.5)))::bigint end as score from h""")
def _(t):
    return Q.match_score(t.opp, _RESUME).select("seq", "score")


_CHOSEN = "chosen as (select distinct case when doc_id % 2 = 0 then 'id-' || doc_id else '' end as key from labels where quality = 1 union select name from opp where status = 'coming-soon' and id = '')"


def _chosen(t):
    ids = t.labels.where("quality = 1").selectExpr("case when doc_id % 2 = 0 then concat('id-', doc_id) else '' end as key")
    names = t.opp.where("status = 'coming-soon' and id = ''").selectExpr("name as key")
    return ids.union(names).distinct()


@query("selected_items", f"with {_CHOSEN} select seq, id, name from opp where case when id <> '' then id else name end in (select key from chosen)")
def _(t):
    return Q.selected_items(t.opp, _chosen(t)).select("seq", "id", "name")


@query("application_packet", f"""with {_CHOSEN}, picked as (select *, row_number() over (order by list_position({D.lst(V.CATEGORIES)}, category), seq) as number from opp where case when id <> '' then id else name end in (select key from chosen))
select seq, number, '[' || number || '] ' || name || ' (' || case when organizer <> '' then organizer else 'Company' end || ')' as title,
  case when application_link <> '' then application_link when website <> '' then website else 'N/A' end as target, case when deadline <> '' then deadline else 'Check listing' end as due from picked""")
def _(t):
    return Q.application_packet(Q.selected_items(t.opp, _chosen(t)))
