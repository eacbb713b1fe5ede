"""Page evidence and adjudication queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.dates import WHOLE_DATE, day
from ..functions.text import text
from ..operators import adjudication as A, evidence as E
from . import duck as D
from .fixtures import AS_OF
from .registry import query


def _meta(*keys):
    tags = "regexp_extract_all(body, '(?i)<meta\\s[^>]*>')"
    one = lambda k: (f"nullif(regexp_extract(list_filter({tags}, lambda g: lower(trim(regexp_extract(g, '(?i)(?:property|name)\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1))) = '{k}' "
                     f"and regexp_matches(g, '(?i)content\\s*=\\s*[\"'']'))[1], '(?i)content\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1), '')")
    return D.clean("coalesce(" + ", ".join(one(k) for k in keys) + ", '')")


def _title():
    t = D.clean("regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1)")
    h = D.clean("regexp_replace(regexp_extract(body, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g')")
    return f"case when {t} <> '' then {t} else {h} end"


def _pub(c):
    return (f"case when regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') then try_cast(left({c}, 10) as date) "
            f"when regexp_matches({c}, {D.q(WHOLE_DATE)}) then {D.lenient(c)} end")


def _phrases(c, terms, n=None):
    out = f"list_filter({D.lst(terms)}, lambda p: contains({c}, p))"
    return f"list_slice({out}, 1, {n})" if n else out


_J = lambda path: f"(j->>'{path}')"
FACTS = f"""
raw as (select * from captures_all),
coded as (select *, case when coalesce(error, '') <> '' then error when status is null then 'unexpected:none' when status in (401, 403, 429) then 'blocked_' || status
  when status >= 400 then 'http_' || status else '' end as code, {D.canonical('url')} as key from raw),
paged as (select *, {_title()} as title, {_meta('og:title', 'twitter:title')} as og_title, {_meta('og:description', 'twitter:description', 'description')} as meta_description,
  {_meta('og:site_name')} as site_name, {D.visible('body')} as visible from coded),
signalled as (select *, list_concat(list_filter({D.lst(V.CHALLENGE_TITLES)}, lambda p: contains(lower(title), p) or contains(lower(og_title), p)),
    case when length(trim(visible)) < 2000 then {_phrases('lower(visible)', V.CHALLENGE_BODIES)} else [] end) as challenge,
  {_phrases('lower(visible)', V.CLOSED_PHRASES)} as closed_raw, {_phrases('lower(title)', V.ROT_PHRASES)} as rot_raw from paged),
blocks as (select capture_id, unnest(regexp_extract_all(body, '(?is)<script[^>]+type\\s*=\\s*["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1)) as b from raw),
nodes as (select capture_id, unnest(case when json_contains(b::json, '{{}}') and (b::json->'$."@graph"') is not null then list_prepend(b::json, from_json(b::json->'$."@graph"', '["JSON"]')) else [b::json] end) as j,
  generate_subscripts(case when (b::json->'$."@graph"') is not null then list_prepend(b::json, from_json(b::json->'$."@graph"', '["JSON"]')) else [b::json] end, 1) as pos from blocks where json_valid(b)),
typed as (select *, lower(case when json_type(j, '$."@type"') = 'ARRAY' then {_J('$."@type"[0]')} else {_J('$."@type"')} end) as ty from nodes),
kinds as (select *, list_contains({D.lst(V.EVENT_TYPES)}, ty) as ev, list_contains({D.lst(V.POSTING_TYPES)}, ty) as po from typed),
vals as (select capture_id, pos, case when ev then {_J('$.name')} when po then coalesce({_J('$.title')}, {_J('$.name')}) else '' end as name,
  case when ev then {_pub(_J('$.startDate'))} when po then {_pub(_J('$.datePosted'))} end as s, case when ev then {_pub(_J('$.endDate'))} end as e, case when po then {_pub(_J('$.validThrough'))} end as v,
  case when ev then coalesce({_J('$.organizer.name')}, {_J('$.organizer')}, '') when po then coalesce({_J('$.hiringOrganization.name')}, '') else '' end as o,
  case when ev and {_J('$.offers[0].price')} is not null then trim({_J('$.offers[0].priceCurrency')} || ' ' || {_J('$.offers[0].price')}) else '' end as prize,
  case when ev and (contains(lower({_J('$.eventStatus')}), 'cancel') or contains(lower({_J('$.eventStatus')}), 'postpone')) then 'eventStatus=' || list_last(string_split(lower({_J('$.eventStatus')}), '/')) end as off from kinds),
ld as (select capture_id, coalesce(arg_min({D.clean('name')}, pos) filter (name <> ''), '') as jsonld_name, arg_min(s, pos) filter (s is not null) as start_date, arg_min(e, pos) filter (e is not null) as end_date,
  arg_min(v, pos) filter (v is not null) as valid_through, coalesce(arg_min(o, pos) filter (o <> ''), '') as organizer, coalesce(arg_min(prize, pos) filter (prize <> ''), '') as prize_text,
  coalesce(arg_min(off, pos) filter (off is not null), '') as called_off from vals group by capture_id),
facts as (select p.*, coalesce(l.jsonld_name, '') as jsonld_name, l.start_date, l.end_date, l.valid_through, coalesce(l.organizer, '') as organizer, coalesce(l.prize_text, '') as prize_text,
  coalesce(l.called_off, '') as called_off, code = '' as fetched, code = '' and len(challenge) = 0 as ok from signalled p left join ld l using (capture_id)),
single as (select capture_id, tier, key, url, coalesce(final_url, url) as final_url, status, ok,
  case when not ok then 'none' when jsonld_name <> '' or coalesce(start_date, end_date, valid_through) is not null then 'jsonld' when og_title <> '' or meta_description <> '' then 'opengraph' when title <> '' then 'html' else 'none' end as kind,
  case when fetched and len(challenge) > 0 then 'challenge_page:' || left(challenge[1], 24) else code end as error,
  case when ok then title else '' end as title, case when ok then og_title else '' end as og_title, case when ok then jsonld_name else '' end as jsonld_name, case when ok then meta_description else '' end as description,
  case when ok then site_name else '' end as site_name, case when ok then organizer else '' end as organizer,
  case when ok then start_date end as start_date, case when ok then end_date end as end_date, case when ok then valid_through end as valid_through, case when ok then prize_text else '' end as prize_text,
  case when ok then closed_raw else [] end as closed_signals, case when ok then rot_raw when status in (404, 410) then [code] else [] end as rot_signals, case when fetched then challenge else [] end as challenge,
  case when fetched then left(sha256(body), 16) else '' end as content_hash, case when tier > 0 then 'reach' else 'direct' end as via from facts),
rated as (select *, case when tier = 0 and not (len(rot_signals) = 0 and case when ok then kind = 'none' or (title = '' and og_title = '' and jsonld_name = '' and coalesce(start_date, end_date, valid_through) is null)
    else regexp_matches(error, '^(blocked_|http_5|network:|unexpected:)') end) then 0
  when tier > 0 and ok and (kind <> 'none' or title <> '' or og_title <> '' or jsonld_name <> '') then 1 when tier = 0 then 2 else 3 end as quality from single),
probes as (select capture_id, (code like 'network:%' or code like 'unexpected:%')::int as hard from coded where tier = 0),
running as (select capture_id, row_number() over w as attempts, (sum(hard) over w)::bigint as hard_failures from probes
  window w as (order by capture_id nulls first, hard rows between unbounded preceding and current row)),
trips as (select *, attempts >= 6 and hard_failures >= 0.75 * attempts as trips from running),
health as (select coalesce(min(attempts) filter (trips), max(attempts), 0) as attempts, coalesce(arg_min(hard_failures, attempts) filter (trips), arg_max(hard_failures, attempts), 0) as hard_failures,
  arg_min(capture_id, attempts) filter (trips) as tripped_at, count(*) filter (trips) > 0 as network_down from trips),
ranked as (select *, row_number() over (partition by key, tier = 0 order by quality, tier, capture_id, url) as nth, row_number() over (partition by key order by quality, tier, capture_id, url) as rn from rated),
evidence as (select r.* replace (case when (r.error like 'network:%' or r.error like 'unexpected:%') and h.network_down then 'network_down' else r.error end as error,
    case when r.tier > 0 and d.key is not null then d.status else r.status end as status, case when r.tier > 0 and d.key is not null then d.final_url else r.final_url end as final_url)
  from ranked r left join (select * from ranked where tier = 0 and nth = 1) d on d.key = r.key, health h where r.rn = 1)"""


@query("page_facts", f"with {FACTS} select capture_id, title, og_title, meta_description, site_name from paged")
def _(t):
    return E.page_facts(t.captures_all).select("capture_id", "title", "og_title", "meta_description", "site_name")


@query("challenge_gate", f"with {FACTS} select capture_id, array_to_string(challenge, '; ') as signals, len(challenge) = 0 as readable from signalled")
def _(t):
    return (E.challenge_signals(E.page_facts(t.captures_all))
            .select("capture_id", F.array_join("challenge", "; ").alias("signals"), (F.size("challenge") == 0).alias("readable")))


@query("structured_facts", f"with {FACTS} select capture_id, jsonld_name, {D.iso('start_date')} as start_date, {D.iso('end_date')} as end_date, {D.iso('valid_through')} as valid_through, organizer, prize_text, called_off from facts")
def _(t):
    return (E.structured_facts(t.captures_all, AS_OF).withColumnRenamed("ld_organizer", "organizer")
            .select("capture_id", "jsonld_name", *[day(F.col(c)).alias(c) for c in ("start_date", "end_date", "valid_through")], "organizer", "prize_text", "called_off"))


@query("evidence_kind", f"with {FACTS} select capture_id, kind, error from single")
def _(t):
    return E.capture_evidence(t.captures_all, AS_OF).select("capture_id", "kind", "error")


@query("closure_rot_signals", f"with {FACTS} select capture_id, array_to_string(closed_raw, '; ') as closed, array_to_string(rot_raw, '; ') as rot from signalled")
def _(t):
    return (E.page_signals(E.page_facts(t.captures_all))
            .select("capture_id", F.array_join("closed_signals", "; ").alias("closed"), F.array_join("rot_signals", "; ").alias("rot")))


@query("capture_status", f"with {FACTS} select capture_id, code from coded")
def _(t):
    return t.captures_all.select("capture_id", E.capture_error(F.col("status"), F.col("error")).alias("code"))


_EV = "key, url, final_url, status, ok, kind, error, title, og_title, jsonld_name, description, site_name, organizer, prize_text, content_hash, via"


@query("evidence", f"with {FACTS} select {_EV}, {D.iso('start_date')} as start_date, {D.iso('end_date')} as end_date, {D.iso('valid_through')} as valid_through, "
       "array_to_string(closed_signals, '; ') as closed, array_to_string(rot_signals, '; ') as rot from evidence")
def _(t):
    return E.build_evidence(t.captures_all, AS_OF).select(
        *[c.strip() for c in _EV.split(",")], *[day(F.col(c)).alias(c) for c in ("start_date", "end_date", "valid_through")],
        F.array_join("closed_signals", "; ").alias("closed"), F.array_join("rot_signals", "; ").alias("rot"))


@query("url_once", f"select {D.canonical('url')} as key, min(url) as url, count(*) as n from pages group by 1")
def _(t):
    from ..functions.urls import canonical_url
    return t.pages.groupBy(canonical_url("url").alias("key")).agg(F.min("url").alias("url"), F.count("*").alias("n"))


@query("network_health", f"with {FACTS} select attempts, hard_failures, tripped_at, network_down from health")
def _(t):
    return E.network_health(t.captures_all)


@query("prefer_capture", "select url, arg_min(capture_id, (tier, capture_id)) as capture_id from captures_all where trim(body) <> '' group by url")
def _(t):
    from ..sources.captures import prefer_capture
    return prefer_capture(t.captures_all).select("url", "capture_id")


@query("evidence_stats", f"""with {FACTS} select kind, via, split_part(error, ':', 1) as error, count(*) as n, count(*) filter (len(challenge) > 0) as challenge_pages from evidence group by all""")
def _(t):
    return A.evidence_stats(E.build_evidence(t.captures_all, AS_OF))


@query("evidence_summary", f"""with {FACTS} select key, case when not ok then 'no-evidence(' || case when error <> '' then error else coalesce(status::varchar, '') end || ')'
  else concat_ws(' ', kind, case when via <> 'direct' then 'via=' || via end, case when coalesce(valid_through, end_date) is not null then 'ends=' || {D.iso('coalesce(valid_through, end_date)')} end,
    case when len(closed_signals) > 0 then 'closed:' || left(closed_signals[1], 28) end, case when len(rot_signals) > 0 then 'rot:' || left(rot_signals[1], 20) end) end as summary from evidence""")
def _(t):
    return E.build_evidence(t.captures_all, AS_OF).select("key", E.evidence_summary().alias("summary"))


# ---- adjudication --------------------------------------------------------

_PRIMARY = D.primary("application_link", "url", "website", "link")
JOINED = f"""{FACTS},
sourced as (select *, {_PRIMARY} as purl, {D.claimed('deadline')} as due, {D.claimed('event_date')} as evd, {D.title_key('name')} as tkey, {D.trust('source')} as trust,
  {D.tokens('name')} as nt from opp_pages),
families as (select tkey, count(distinct fam) as n from (select {D.title_key('name')} as tkey, {D.family('source')} as fam from opp_pages) where tkey <> '' group by tkey),
joined as (select s.*, coalesce(greatest(1, f.n), 1) as corroboration, coalesce(e.ok, false) as ev_ok, e.kind, e.final_url as ev_final, e.title as ev_title, e.og_title, e.jsonld_name, e.description as ev_description,
  e.site_name, e.organizer as ev_organizer, e.start_date, coalesce(e.valid_through, e.end_date) as pend, e.closed_signals, e.rot_signals, e.content_hash,
  case when purl = '' then 'no_url' when e.key is null then 'not_captured' else e.error end as ev_error
  from sourced s left join families f on s.tkey = f.tkey left join evidence e on s.purl <> '' and e.key = {D.canonical('s.purl')})"""

_NOW = f"date '{AS_OF}'"
_CONT = lambda c: f"case when len(nt) > 0 and len({D.tokens(c)}) > 0 then len(list_intersect(nt, {D.tokens(c)})) / len(nt) else 0 end"
_FD, _CD, _WD = D.domain("ev_final"), D.domain("application_link"), D.domain("website")
_ROOT = f"({_CD} = {_FD} and {D.depth('application_link')} >= 2 and {D.depth('ev_final')} = 0)"


def _rows(src, rules):
    """Union of (condition, code, severity, detail, fix_field, fix_value)."""
    return "\nunion all ".join(
        f"select seq, '{code}' as code, '{sev}' as severity, {detail} as detail, {f or 'null::varchar'} as fix_field, {v or 'null::varchar'} as fix_value from {src} where {cond}"
        for cond, code, sev, detail, f, v in rules)


INTERNAL = _rows("joined", [
    (f"status = 'open' and due < {_NOW}", "stale_open_status", "suspicion", f"'status=open but deadline ' || {D.iso('due')} || ' already passed'", "'status'", "'closed'"),
    (f"status = 'closed' and coalesce(due, evd) is not null and coalesce(due > {_NOW}, true) and coalesce(evd > {_NOW}, true)", "contradictory_closed_status", "suspicion",
     "'status=closed but all dates are in the future (' || concat_ws(', ', strftime(due, '%Y-%m-%d'), strftime(evd, '%Y-%m-%d')) || ')'", None, None),
    ("due > evd + 30", "deadline_after_event", "suspicion", f"'deadline ' || {D.iso('due')} || ' is well after eventDate ' || {D.iso('evd')}", None, None),
    *[(f"list_contains({D.lst(V.PLACEHOLDERS)}, lower(trim({c})))", "placeholder_field", "suspicion", f"'{s} is a placeholder (''' || lower(trim({c})) || ''')'", None, None)
      for c, s in (("name", "name"), ("deadline", "deadline"), ("application_link", "applicationLink"))],
    (f"{_CD} <> '' and {_WD} <> '' and {_CD} <> {_WD}", "link_domain_split", "info", f"'applicationLink(' || {_CD} || ') != website(' || {_WD} || ')'", None, None)])
LINK = _rows("joined", [
    ("ev_ok and len(rot_signals) > 0", "link_rot", "contradiction", "'target page looks dead (' || array_to_string(list_slice(rot_signals, 1, 2), ', ') || ')'", None, None),
    (f"ev_ok and len(rot_signals) = 0 and application_link <> '' and ev_final <> '' and {_ROOT}", "redirect_to_root", "suspicion", "'deep link redirected to site root (' || ev_final || ')'", None, None),
    (f"ev_ok and len(rot_signals) = 0 and application_link <> '' and ev_final <> '' and not {_ROOT} and {_CD} <> '' and {_FD} <> '' and {_CD} <> {_FD}", "cross_domain_redirect", "suspicion",
     f"'redirected off-domain: ' || {_CD} || ' -> ' || {_FD}", None, None)])
OVERLAP = f"""overlapped as (select *, greatest({', '.join(_CONT(c) for c in ('jsonld_name', 'og_title', 'ev_title', 'ev_description', 'site_name', 'ev_organizer'))}) as best,
  coalesce(nullif(jsonld_name, ''), nullif(og_title, ''), nullif(ev_title, '')) as first_title from joined where ev_ok)"""
TITLE = _rows("overlapped", [
    ("len(nt) >= 2 and first_title is not null and best < 0.15 and kind in ('jsonld', 'opengraph')", "title_mismatch", "contradiction",
     "'page describes something else (overlap=' || printf('%.2f', best) || ', page=''' || left(first_title, 60) || ''')'", None, None),
    ("len(nt) >= 2 and first_title is not null and best < 0.34 and not (best < 0.15 and kind in ('jsonld', 'opengraph'))", "weak_title_match", "suspicion",
     "'low title overlap with page (overlap=' || printf('%.2f', best) || ')'", None, None)])
DATES = _rows("joined", [
    (f"ev_ok and pend < {_NOW}", "publisher_says_ended", "suspicion", f"'publisher end date ' || {D.iso('pend')} || ' is in the past'", "'status'", "'closed'"),
    ("ev_ok and due > pend + 30", "deadline_overshoots_publisher", "contradiction", f"'claimed deadline ' || {D.iso('due')} || ' is after publisher end ' || {D.iso('pend')}", "'deadline'", D.iso("pend")),
    ("ev_ok and abs(date_diff('day', start_date, evd)) > 45", "event_date_drift", "contradiction",
     f"'claimed eventDate ' || {D.iso('evd')} || ' vs published ' || {D.iso('start_date')} || ' (' || abs(date_diff('day', start_date, evd)) || 'd drift)'", "'event_date'", D.iso("start_date")),
    ("ev_ok and start_date is not null and evd is null", "event_date_enriched", "info", f"'adopted publisher start date ' || {D.iso('start_date')}", "'event_date'", D.iso("start_date")),
    ("ev_ok and pend is not null and due is null and trim(deadline) = ''", "deadline_enriched", "info", f"'adopted publisher end date ' || {D.iso('pend')}", "'deadline'", D.iso("pend"))])
CLOSURE = _rows("joined", [
    ("ev_ok and len(closed_signals) > 0 and lower(status) = 'closed'", "closure_confirmed", "info", "'page confirms closed status'", None, None),
    ("ev_ok and len(closed_signals) > 0 and lower(status) <> 'closed'", "closure_detected", "suspicion", "'page states ''' || closed_signals[1] || ''' but record says ' || status", "'status'", "'closed'")])
_E = "not ev_ok and "
UNREACHED = _rows("joined", [
    (_E + "ev_error in ('http_404', 'http_410')", "dead_link", "contradiction", "'link returns ' || substring(ev_error, 6, 3)", None, None),
    (_E + "ev_error like 'blocked~_%' escape '~'", "bot_walled", "info", "'page not readable (' || ev_error || ')'", None, None),
    (_E + "ev_error like 'challenge~_page%' escape '~'", "bot_challenge", "info", "'anti-bot interstitial (' || ev_error || ')'", None, None),
    (_E + "ev_error in ('network_down', 'not_captured')", "not_checked", "info", "'evidence skipped (' || ev_error || ')'", None, None),
    (_E + "ev_error = 'no_url'", "no_verifiable_url", "suspicion", "'no usable URL to verify against'", None, None),
    (_E + "ev_error like 'http~_5%' escape '~'", "server_error", "suspicion", "'publisher server error (' || ev_error || ')'", None, None),
    (_E + "not regexp_matches(ev_error, '^(http_404|http_410|blocked_|challenge_page|network_down|not_captured|no_url|http_5)')", "unreachable", "suspicion", "'could not fetch evidence (' || ev_error || ')'", None, None)])


def _joined(t):
    rich = A.corroborate(t.opp_pages, A.corroboration_index(t.opp_pages)).withColumn("trust", A.source_trust("source"))
    return A.attach_evidence(rich, E.build_evidence(t.captures_all, AS_OF))


def _check(name, body, expr, extra=""):
    @query(name, f"with {JOINED}{extra}\n{body}")
    def run(t):
        df = A._dates(_joined(t), AS_OF)
        df = df.withColumn("_overlap", A.title_overlap(df))
        return df.select("seq", F.explode(expr(df)).alias("f")).select("seq", "f.*")


def _when_ok(check):
    return F.when(F.col("ev_ok"), check)


_check("chk_internal", INTERNAL, lambda df: A.chk_internal(df, AS_OF))
_check("chk_link", LINK, lambda df: _when_ok(A.chk_link(df)))
_check("chk_title", TITLE, lambda df: _when_ok(A.chk_title(df)), ",\n" + OVERLAP)
_check("chk_dates", DATES, lambda df: _when_ok(A.chk_dates(df, AS_OF)))
_check("chk_closure", CLOSURE, lambda df: _when_ok(A.chk_closure(df)))
_check("chk_unreachable", UNREACHED, lambda df: F.when(~F.col("ev_ok"), A.chk_unreachable(F.col("ev_error"))))

ADJUDICATED = f"""{JOINED},
{OVERLAP},
found as ({INTERNAL}
union all {LINK}
union all {TITLE}
union all {DATES}
union all {CLOSURE}
union all {UNREACHED}),
sums as (select seq, count(*) filter (severity = 'contradiction') as wrong, count(*) filter (severity = 'suspicion') as odd, bool_or(fix_field = 'status') as over,
  max(fix_value) filter (fix_field = 'deadline') as fix_deadline, max(fix_value) filter (fix_field = 'event_date') as fix_event from found group by seq),
gated as (select j.*, coalesce(wrong, 0) as wrong, coalesce(odd, 0) as odd, fix_deadline, fix_event,
  case when coalesce(wrong, 0) > 0 then 'contradiction' when coalesce(over, false) then 'over' when not (ev_ok and kind <> 'none') and (trust >= 0.75 or corroboration >= 2) then 'believed'
    when not (ev_ok and kind <> 'none') then 'unproven' when coalesce(odd, 0) >= 3 then 'suspicious' else 'proven' end as gate from joined j left join sums s using (seq)),
adjudicated as (select *, case when gate in ('contradiction', 'over') then 'reject' when gate in ('unproven', 'suspicious') then 'quarantine' else 'accept' end as verdict from gated)"""


def _adjudicated(t):
    return A.adjudicate(t.opp_pages, E.build_evidence(t.captures_all, AS_OF), A.corroboration_index(t.opp_pages), AS_OF)


@query("evidence_join", f"with {JOINED} select seq, ev_ok, coalesce(kind, 'none') as kind, ev_error from joined")
def _(t):
    return _joined(t).select("seq", "ev_ok", F.coalesce("ev.kind", F.lit("none")).alias("kind"), "ev_error")


@query("corroboration_index", f"select {D.title_key('name')} as key, count(distinct {D.family('source')}) as families from opp where {D.title_key('name')} <> '' group by 1")
def _(t):
    return A.corroboration_index(t.opp)


@query("corroboration_join", f"with {JOINED} select seq, corroboration from joined")
def _(t):
    return A.corroborate(t.opp_pages, A.corroboration_index(t.opp_pages)).select("seq", "corroboration")


@query("l2_decide", f"with {ADJUDICATED} select seq, gate, verdict, trust, corroboration from adjudicated")
def _(t):
    return _adjudicated(t).select("seq", "gate", "verdict", "trust", "corroboration")


@query("apply_corrections", f"""with {ADJUDICATED} select seq, status, case when verdict = 'accept' and fix_deadline is not null then fix_deadline else deadline end as deadline,
  case when verdict = 'accept' and fix_event is not null then fix_event else event_date end as event_date from adjudicated""")
def _(t):
    return _adjudicated(t).select("seq", "status", "deadline", "event_date")


@query("l2_adjudicate", f"""with {ADJUDICATED} select seq, verdict, case gate when 'over' then 'already closed at time of discovery'
  when 'believed' then 'unproven but ' || case when trust >= 0.75 then 'trusted source ' else 'corroborated ' end || '(trust=' || printf('%.2f', trust) || ', sources=' || corroboration || ')'
  when 'unproven' then 'no evidence (' || case when ev_error = '' then 'none' else ev_error end || '), low trust (trust=' || printf('%.2f', trust) || ', sources=' || corroboration || ')'
  when 'proven' then case when odd = 0 then 'corroborated by publisher metadata' else 'see findings' end else 'see findings' end as reason, coalesce(content_hash, '') as evidence_hash,
  wrong, odd from adjudicated""")
def _(t):
    df = _adjudicated(t)
    n = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s)).cast("bigint")
    listed = F.col("gate").isin("contradiction", "suspicious") | ((F.col("gate") == "proven") & (n("suspicion") > 0))
    return df.select("seq", "verdict", F.when(listed, "see findings").otherwise(F.get("l2_reasons", F.lit(0))).alias("reason"),
                     "evidence_hash", n("contradiction").alias("wrong"), n("suspicion").alias("odd"))


@query("l2_stats", f"""with {ADJUDICATED} select count(*) as total, count(*) filter (verdict = 'accept') as accepted, count(*) filter (verdict = 'quarantine') as quarantined, count(*) filter (verdict = 'reject') as rejected,
  count(*) filter (verdict = 'accept' and ((fix_deadline is not null and fix_deadline <> deadline) or (fix_event is not null and fix_event <> event_date))) as corrected,
  sum(wrong)::bigint as contradictions, count(*) filter (gate in ('believed', 'unproven')) as unproven from adjudicated""")
def _(t):
    return A.l2_stats(_adjudicated(t))
