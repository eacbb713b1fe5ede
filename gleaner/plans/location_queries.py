"""Location, expiry and reminder queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.dates import WHOLE_DATE
from ..operators import location as L, reminders as R
from . import duck as D
from .fixtures import AS_OF
from .registry import query

_PUBLISHED = (f"case when regexp_matches(trim(deadline), '^\\d{{4}}-\\d{{2}}-\\d{{2}}') then try_cast(left(trim(deadline), 10) as date) "
              f"when regexp_matches(deadline, {D.q(WHOLE_DATE)}) then {D.lenient('deadline')} end")


def _clean(c):
    return D.collapse(f"regexp_replace(regexp_replace({c}, '[–—→↳>|/\\\\]+', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')")


def _bare(c: str) -> str:
    names = {**V.BARE_CODE_ALIASES, **{x: x for x in V.BARE_CODES_SAME}}
    codes = "|".join(re.escape(x) for x in sorted(names, key=len, reverse=True))
    found = f"regexp_extract({c}, {D.q(r'(^|[(\[|,\-–—/]\s*|\s)(' + codes + r')($|[)\]|,\-–—/]|\s|\b)')}, 2)"
    return f"case {found} when 'USA' then 'US' when 'U.S.' then 'US' when 'U.S.A.' then 'US' when 'UK' then 'GB' else {found} end"


def _classify_cte() -> str:
    """Regular-expression form of the classification."""
    country = " ".join(f"when {D.any_word('geo', terms)} then '{code}'" for code, terms in V.COUNTRY_TERMS.items())
    bare = _bare("raw")
    auth = " ".join(f"when {D.any_in('hay', p)} then '{c}'" for c, p in V.AUTH_PHRASES.items())
    city = "trim(split_part(lower(raw), ',', 1))"
    spaced = [t for t in V.REMOTE_TERMS if " " in t]
    single = [t for t in V.REMOTE_TERMS if " " not in t]
    return f"""
texts as (select *, {_clean("case when trim(location) <> '' then trim(location) else trim(mode) end")} as raw,
  {_clean("mode || ' ' || eligibility || ' ' || description || ' ' || name")} as extra from opp),
hays as (select *, lower(raw) as geo, trim(lower(raw || ' ' || extra)) as hay from texts),
hits as (select *,
  {D.any_word('geo', V.HOME_NAMES)} or {D.any_word('geo', V.HOME_CITIES)} or {D.any_word('geo', V.HOME_REGIONS)} as home,
  case when len(list_filter(regexp_extract_all(raw, ',\\s*([A-Z]{{2}})\\b', 1), lambda c: list_contains({D.lst(V.US_STATE_CODES)}, c) and
      (c <> 'IN' or not (list_contains({D.lst(V.HOME_CITIES)}, {city}) or {D.any_in(city, V.HOME_NAMES)})))) > 0 then 'US'
    when {D.any_word('geo', V.US_STATE_NAMES)} then 'US' when {D.any_word('geo', V.US_CITIES)} then 'US'
    {country} else {bare} end as other,
  {D.any_in('geo', V.GLOBAL_TERMS)} as is_global, {D.any_in('hay', V.HYBRID_TERMS)} as hybrid,
  ({D.any_in('hay', spaced)} or {D.any_word('hay', single)}) as remote, {D.any_in('hay', V.ONSITE_TERMS)} as onsite,
  case {auth} else '' end as auth from hays),
modes as (select *, case when home then 'IN' else other end as place,
  case when auth <> '' then auth when not home then other else '' end as tied from hits),
located as (select *, case when hay = '' then 'unknown' when hybrid then 'hybrid'
  when remote and not onsite then case when is_global or tied = '' then 'remote' else 'remote_geo' end
  when onsite or place <> '' then 'onsite' when auth <> '' then 'remote_geo' else 'unknown' end as loc_mode from modes),
classified as (select *, case when place <> '' then place
  when loc_mode = 'remote_geo' then case when remote and not onsite then tied else auth end else '' end as loc_country from located),
labelled as (select *, case loc_mode when 'remote' then 'Remote' when 'remote_geo' then 'Remote' when 'hybrid' then 'Hybrid'
  when 'onsite' then 'In-person' else 'Unspecified' end || case when loc_country <> '' then ' · ' || loc_country else '' end as loc_label from classified),
ruled as (select *, case loc_mode when 'remote' then 'any' when 'unknown' then 'keep' else 'home' end as rule,
  (category in ('internships', 'jobs')) as named from labelled),
policed as (select *, (rule <> 'home' or is_global or loc_country in ('', 'IN')) as allowed from ruled)"""


CLASSIFY = _classify_cte()


@query("classify_location", f"with {CLASSIFY} select seq, loc_mode as mode, loc_country as country, home as is_home, is_global, loc_label as label from labelled")
def _(t):
    return L.classify_location(t.opp).select("seq", "loc.mode", "loc.country", "loc.is_home", "loc.is_global", "loc.label")


@query("gazetteer_match", f"with {CLASSIFY} select seq, raw, place as country from modes")
def _(t):
    out = L.classify_location(t.opp)
    place = F.when(F.col("loc.is_home"), F.lit(V.HOME_COUNTRY)).otherwise(
        F.coalesce(F.get(F.filter(F.transform("loc.signals", lambda s: F.regexp_extract(s, "^country:(.*)$", 1)), lambda s: s != ""), F.lit(0)), F.lit("")))
    return out.select("seq", "loc.raw", place.alias("country"))


@query("clean_location", f"select seq, {_clean('location')} as place from opp")
def _(t):
    return t.opp.select("seq", L.clean_location("location").alias("place"))


@query("city_state_rule", f"with {CLASSIFY} select seq, len(list_filter(regexp_extract_all(raw, ',\\s*([A-Z]{{2}})\\b', 1), lambda c: c <> 'IN' and list_contains({D.lst(V.US_STATE_CODES)}, c))) > 0 "
       f"or (regexp_matches(raw, ',\\s*IN\\b') and not list_contains({D.lst(V.HOME_CITIES)}, trim(split_part(lower(raw), ',', 1)))) as is_us from texts")
def _(t):
    raw = L.clean_location(F.when(F.trim("location") != "", F.trim("location")).otherwise(F.trim("mode")))
    return t.opp.withColumn("raw", raw).select("seq", L.city_state_us("raw").alias("is_us"))


@query("bare_country_code", f"select seq, {_bare(_clean('location'))} as code from opp")
def _(t):
    return t.opp.select("seq", L.bare_country_code(L.clean_location("location")).alias("code"))


@query("auth_restriction", f"select seq, case {' '.join(f'when {D.any_in(chr(39) + chr(39) + ' || lower(eligibility || description)', p)} then {D.q(c)}' for c, p in V.AUTH_PHRASES.items())} else '' end as restricted_to from opp")
def _(t):
    return t.opp.select("seq", L.auth_restriction(F.lower(F.concat("eligibility", "description"))).alias("restricted_to"))


@query("location_label", f"with {CLASSIFY} select seq, loc_label as label from labelled")
def _(t):
    return L.annotate(t.opp).select("seq", F.col("location_label").alias("label"))


@query("filter_geo_policy", f"""with {CLASSIFY} select seq, category, (not named or allowed) as keep,
  case when not named then 'category is not filtered' when rule = 'keep' then loc_mode || ': kept by policy'
    when rule = 'any' then loc_mode || ': no geographic restriction' when is_global then loc_mode || ': explicitly worldwide'
    when loc_country = '' then loc_mode || ': country unknown, kept' when loc_country = 'IN' then loc_mode || ': in IN'
    else loc_mode || ' in ' || loc_country || ', outside IN' end as reason from policed""")
def _(t):
    return L.geo_policy(L.classify_location(t.opp)).select("seq", "category", "keep", "reason")


@query("location_modes", f"""with {CLASSIFY}
select category, 'mode' as facet, loc_mode as value, count(*) as n, count(*) filter (named and not allowed) as dropped from policed group by category, loc_mode
union all select category, 'country', case when loc_country = '' then '(unknown)' else loc_country end, count(*), count(*) filter (named and not allowed) from policed group by all""")
def _(t):
    return L.location_summary(L.geo_policy(L.classify_location(t.opp)))


@query("top_countries", f"""with {CLASSIFY}, c as (select category, case when loc_country = '' then '(unknown)' else loc_country end as value, count(*) as n from policed group by all),
r as (select *, row_number() over (partition by category order by n desc, value) as rank from c) select category, value, n, rank from r where rank <= 5""")
def _(t):
    return L.top_countries(L.location_summary(L.geo_policy(L.classify_location(t.opp)))).select("category", "value", "n", "rank")


@query("annotate_backfill", f"""with {CLASSIFY} select category, count(*) as before_n, count(*) filter (not allowed) as drop_eligible,
  count(*) filter (allowed or category not in ('internships', 'jobs')) as after_n from policed group by category""")
def _(t):
    chosen = F.col("category").isin(V.GEO_CATEGORIES)
    return (L.backfill(t.opp).groupBy("category")
            .agg(F.count("*").alias("before_n"), F.count_if("drop_eligible").alias("drop_eligible"),
                 F.count_if(~(F.col("drop_eligible") & chosen)).alias("after_n")))


@query("expire_status", f"""select seq, case when status <> 'closed' and ({D.past('deadline')} or {D.past('event_date')}
  or {D.any_in('lower(description)', V.CLOSED_DESCRIPTION)}) then 'closed' else status end as status,
  status <> 'closed' and ({D.past('deadline')} or {D.past('event_date')} or {D.any_in('lower(description)', V.CLOSED_DESCRIPTION)}) as expired from opp""")
def _(t):
    return R.expire_status(t.opp, AS_OF).select("seq", "status", "expired")


UPCOMING = f"""due as (select *, date_diff('day', date '{AS_OF}', case when not regexp_matches(deadline, '\\s[-–—]\\s|\\sto\\s|[–—]') then {_PUBLISHED} end) as days_left
  from opp where status <> 'closed' and deadline <> '' and not {D.any_in('lower(deadline)', V.REMINDER_SKIP)}),
upcoming as (select * from due where days_left in (7, 3, 1)),
people as (select *, array_to_string(list_sort(string_split(categories, ',')), ',') as audience from subscribers)"""


@query("upcoming_deadlines", f"with {UPCOMING} select seq, category, name, deadline, days_left from upcoming")
def _(t):
    return R.upcoming_deadlines(t.opp, AS_OF).select("seq", "category", "name", "deadline", "days_left")


@query("subscriber_match", f"""with {UPCOMING}, wanted as (select distinct audience, unnest(string_split(audience, ',')) as category from people)
select w.audience, u.category, u.seq, u.name, u.deadline, u.days_left, u.application_link from wanted w join upcoming u on w.category = u.category""")
def _(t):
    return R.subscriber_match(R.upcoming_deadlines(t.opp, AS_OF), t.subscribers)


@query("digest", f"""with {UPCOMING} select p.email, case when whatsapp <> '' and whatsapp not like '+%' then '+91' || whatsapp else whatsapp end as phone,
  p.audience, count(*) as n_items, count(*) || ' deadline(s) approaching!' as subject
from people p join upcoming u on list_contains(string_split(p.categories, ','), u.category) group by p.email, whatsapp, p.audience""")
def _(t):
    return R.digest(R.upcoming_deadlines(t.opp, AS_OF), t.subscribers)


@query("digest_items", f"""with {UPCOMING} select p.email, case when whatsapp <> '' and whatsapp not like '+%' then '+91' || whatsapp else whatsapp end as phone,
  p.audience, u.seq, u.category, u.name, u.deadline, u.days_left, u.application_link from people p join upcoming u on list_contains(string_split(p.categories, ','), u.category)""")
def _(t):
    return R.digest_items(R.upcoming_deadlines(t.opp, AS_OF), t.subscribers)
