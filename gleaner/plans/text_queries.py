"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, html, text, urls
from ..functions import vocab as V
from ..operators import evidence
from . import duck as D
from .fixtures import AS_OF
from .registry import query


def scalar(name, view, key, expr, sql_expr):
    """One column computed for every row of a view."""
    @query(name, f"select {key}, {sql_expr} as {name} from {view}")
    def run(t):
        return getattr(t, view).select(key, expr().alias(name))


scalar("normalize_name", "documents", "doc_id", lambda: text.normalize_name("text"), D.norm_name("text"))
scalar("normalize_title", "documents", "doc_id", lambda: text.normalize_title("text"), D.norm_title("text"))
scalar("normalize_link", "pages", "page_id", lambda: urls.normalize_link("url"), D.norm_link("url"))
scalar("gate_link", "pages", "page_id", lambda: urls.gate_link("url"), D.gate_link("url"))
scalar("canonical_url", "pages", "page_id", lambda: urls.canonical_url("url"), D.canonical("url"))
scalar("fingerprint", "opp", "seq", lambda: urls.fingerprint("name", "application_link", "website"), D.fingerprint())
scalar("primary_url", "opp", "seq", lambda: urls.primary_url("application_link", "url", "website", "link"),
       D.primary("application_link", "url", "website", "link"))
scalar("url_domain", "pages", "page_id", lambda: urls.url_domain("url"), D.domain("url"))
scalar("url_path", "pages", "page_id", lambda: urls.url_path("url"), D.path("url"))
scalar("path_depth", "pages", "page_id", lambda: urls.path_depth("url"), D.depth("url"))
scalar("distinctive_tokens", "documents", "doc_id",
       lambda: F.array_join(F.array_sort(text.distinctive_tokens("text")), " "),
       f"array_to_string(list_sort({D.tokens('text')}), ' ')")
scalar("title_key", "opp", "seq", lambda: text.title_key("name"), D.title_key("name"))
scalar("source_family", "opp", "seq", lambda: text.source_family("source"), D.family("source"))
scalar("trust_match", "opp", "seq", lambda: text.source_trust("source"), D.trust("source"))
scalar("containment", "opp", "seq",
       lambda: F.round(text.containment(text.distinctive_tokens("name"), text.distinctive_tokens("description")), 6),
       f"case when len({D.tokens('name')}) > 0 and len({D.tokens('description')}) > 0 then "
       f"round(len(list_intersect({D.tokens('name')}, {D.tokens('description')})) / len({D.tokens('name')}), 6) else 0.0 end")
scalar("token_jaccard", "opp", "seq",
       lambda: F.round(text.jaccard(text.similarity_tokens("name"), text.similarity_tokens("description")), 6),
       f"round({D.jaccard(D.sim_tokens('name'), D.sim_tokens('description'))}, 6)")
scalar("visible_text", "pages", "page_id", lambda: html.visible_text("html"), D.visible("html"))
scalar("clean_text", "pages", "page_id", lambda: html.clean_text("html"), D.clean("html"))
scalar("parse_claimed_date", "opp", "seq", lambda: dates.day(dates.parse_claimed_date("deadline", AS_OF)),
       D.iso(D.claimed("deadline")))
scalar("parse_published_date", "opp", "seq", lambda: dates.day(dates.parse_published_date("event_date", AS_OF)),
       D.iso(f"case when regexp_matches(event_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') then try_cast(left(event_date, 10) as date) when regexp_matches(event_date, {D.q(dates.WHOLE_DATE)}) then {D.lenient('event_date')} end"))
scalar("is_past", "opp", "seq", lambda: dates.is_past("deadline", AS_OF), D.past("deadline"))
scalar("deadline_in_text", "posts", "post_id", lambda: text.deadline_in_text("body"), D.first_match("body", V.DEADLINE_PATTERNS))
scalar("post_category", "posts", "post_id",
       lambda: text.cascade(F.lower(F.concat_ws(" ", "title", "body")), V.POST_CATEGORY, "competitions"),
       D.cascade("lower(title || ' ' || body)", V.POST_CATEGORY, "competitions"))
scalar("social_category", "posts", "post_id",
       lambda: text.cascade(F.lower(F.concat_ws(" ", "title", "body")), V.SOCIAL_CATEGORY, "hackathons"),
       D.cascade("lower(title || ' ' || body)", V.SOCIAL_CATEGORY, "hackathons"))
scalar("status_mark", "opp", "seq",
       lambda: F.concat(text.status_mark("status"), F.lit(" "), F.col("name"), F.lit(" — Deadline: "), F.col("deadline")),
       "case status when 'open' then '🟢' when 'closed' then '🔴' when 'coming-soon' then '🟡' else '⚪' end || ' ' || name || ' — Deadline: ' || deadline")


def _reward_sql():
    vals = [f"case when regexp_matches(body, {D.q(p)}) and length({D.strip(f'regexp_extract(body, {D.q(p)}, 1)')}) < 40 "
            f"then {D.strip(f'regexp_extract(body, {D.q(p)}, 1)')} end" for p in V.REWARD_PATTERNS]
    return "coalesce(" + ", ".join(vals) + ")"


scalar("reward_in_text", "posts", "post_id", lambda: text.reward_in_text("body"), _reward_sql())
scalar("url_in_text", "posts", "post_id", lambda: text.url_in_post("url", "body"),
       "case when url <> '' and not (contains(url, 'reddit.com') or contains(url, 'redd.it')) then url else "
       f"regexp_replace({D.first_match('body', V.POST_URL_PATTERNS, 0)}, '[).,;]+$', '') end")
scalar("clean_title", "documents", "doc_id", lambda: text.clean_title(F.concat(F.lit("# 1. "), "text", F.lit(" —"))),
       f"trim(regexp_replace(regexp_replace({D.collapse(chr(39) + '# 1. ' + chr(39) + ' || text || ' + chr(39) + ' —' + chr(39))}, '^[#*\\-•\\d.\\s]+', ''), '[|·–—]\\s*$', ''))")
scalar("filter_plausible_title", "opp", "seq", lambda: text.plausible_title("name"),
       f"length(name) >= 8 and not list_contains({D.lst(V.NAV_WORDS)}, lower(name)) and regexp_matches(name, '[A-Za-z]{{3}}') "
       "and not regexp_matches(lower(name), '^(http|www\\.|data:)')")


def _strip_html_sql(c):
    out = c
    for tag in ("script", "style", "noscript", "template"):
        out = f"regexp_replace({out}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?i)<br\\s*/?>|</p>|</div>|</li>', chr(10), 'g')"
    out = D.unescape(f"regexp_replace({out}, '<[^>]+>', ' ', 'g')")
    out = f"regexp_replace(regexp_replace({out}, '[ \\t\\f\\v]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return D.strip(out)


scalar("strip_html", "pages", "page_id", lambda: html.strip_html("html"), _strip_html_sql("html"))


@query("strip_markdown", f"""
select doc_id, {D.strip(r"regexp_replace(regexp_replace(body, '[*_~`]', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g')")} as plain from markdown_docs""")
def _(t):
    return t.markdown_docs.select("doc_id", text.strip_markdown("body").alias("plain"))


@query("extract_url", r"""
select doc_id, regexp_extract(body, '\]\((https?://[^)]+)\)', 1) as url from markdown_docs""")
def _(t):
    return t.markdown_docs.select("doc_id", text.extract_url("body").alias("url"))


@query("meta_tags", r"""
with tags as (select page_id, unnest(regexp_extract_all(body, '(?i)<meta\s[^>]*>')) as tag, generate_subscripts(regexp_extract_all(body, '(?i)<meta\s[^>]*>'), 1) as pos from captures),
kv as (select page_id, pos, lower(trim(regexp_extract(tag, '(?i)(?:property|name)\s*=\s*["'']([^"'']+)["'']', 1))) as key,
  regexp_extract(tag, '(?i)content\s*=\s*["'']([^"'']*)["'']', 1) as content from tags where regexp_matches(tag, '(?i)content\s*=\s*["'']'))
select page_id, key, arg_min(content, pos) as content from kv where key <> '' group by page_id, key""")
def _(t):
    pairs = t.captures.select("page_id", F.posexplode(html.meta_pairs(F.col("body"))).alias("pos", "p"))
    return (pairs.groupBy("page_id", F.col("p.key").alias("key"))
            .agg(F.min_by("p.content", "pos").alias("content")))


@query("json_ld_nodes", r"""
with blocks as (select page_id, unnest(regexp_extract_all(body, '(?is)<script[^>]+type\s*=\s*["'']application/ld\+json["''][^>]*>(.*?)</script>', 1)) as b from captures),
roots as (select page_id, b::json as j from blocks where json_valid(b)),
kids as (select page_id, unnest(json_extract(j, '$."@graph"[*]')) as j from roots where (j->'$."@graph"') is not null),
nodes as (select * from roots union all select * from kids)
select page_id, coalesce(lower(case when json_type(j, '$."@type"') = 'ARRAY' then (j->>'$."@type"[0]') else (j->>'$."@type"') end), '') as types,
  coalesce((j->>'$.name'), '') as name from nodes""")
def _(t):
    nodes = evidence.json_ld_nodes(t.captures, "page_id")
    return nodes.select("page_id", F.array_join("types", ",").alias("types"),
                        F.coalesce(F.get_json_object("node", "$.name"), F.lit("")).alias("name"))
