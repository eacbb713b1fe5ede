"""Source normaliser queries over landed documents derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import news_announcement
from ..sources import apis, cards, documents as T, social
from . import duck as D
from .registry import query

_NOW = 1706745600
_DAY = "strftime(to_timestamp({0}) at time zone 'UTC', '%Y-%m-%d')"
_MIN = "strftime(to_timestamp({0}) at time zone 'UTC', '%Y-%m-%d %H:%M UTC')"


@query("src_contests_epoch", f"""with i as (select doc_id, unnest(from_json(body::json->'$.result', '["JSON"]')) as j from contest_docs where kind = 0 and (body::json->>'$.status') = 'OK')
select doc_id, coalesce(j->>'$.name', 'Codeforces Contest') as name, case when (j->>'$.startTimeSeconds') is null then 'Check page' else {_DAY.format("(j->>'$.startTimeSeconds')::bigint")} end as deadline,
  case when (j->>'$.startTimeSeconds') is null then '' else {_MIN.format("(j->>'$.startTimeSeconds')::bigint")} end as event_date,
  'Codeforces ' || case j->>'$.type' when 'CF' then 'Cf' else 'Icpc Like' end || ' contest. Duration: ' || case when (j->>'$.durationSeconds') is null then '' else '2h 30m' end as description,
  'https://codeforces.com/contest/' || (j->>'$.id') as application_link from i where (j->>'$.phase') = 'BEFORE'""")
def _(t):
    return (apis.epoch_contests(t.contest_docs.where("kind = 0"), "doc_id")
            .select("doc_id", "name", "deadline", "event_date", "description", "application_link"))


@query("upcoming_topk", f"""with i as (select doc_id, unnest(from_json(body::json->'$.data.allContests', '["JSON"]')) as j from contest_docs where kind = 1),
r as (select *, row_number() over (partition by doc_id order by (j->>'$.startTime')::bigint) as n from i where (j->>'$.startTime')::bigint > {_NOW})
select doc_id, n - 1 as pos, j->>'$.title' as name, {_MIN.format("(j->>'$.startTime')::bigint")} as event_date, case when (j->>'$.duration')::bigint = 0 then '' else ((j->>'$.duration')::bigint // 60) || ' minutes' end as took,
  'https://leetcode.com/contest/' || case when (j->>'$.titleSlug') <> '' then (j->>'$.titleSlug') || '/' else '' end as application_link from r where n <= 10""")
def _(t):
    return (apis.query_contests(t.contest_docs.where("kind = 1"), _NOW, "doc_id", limit=10)
            .select("doc_id", "pos", "name", "event_date", F.regexp_extract("description", "Duration: (.*)$", 1).alias("took"), "application_link"))


@query("src_contests_dates", """with i as (select doc_id, 0 as g, unnest(from_json(body::json->'$.future_contests', '["JSON"]')) as j from contest_docs where kind = 2
  union all select doc_id, 1, unnest(from_json(body::json->'$.present_contests', '["JSON"]')) from contest_docs where kind = 2)
select doc_id, 'CodeChef: ' || (j->>'$.contest_name') as name, 'https://www.codechef.com/' || (j->>'$.contest_code') as url,
  coalesce(nullif(j->>'$.contest_end_date', ''), nullif(j->>'$.contest_start_date', ''), 'Check CodeChef') as deadline from i""")
def _(t):
    return apis.list_contests(t.contest_docs.where("kind = 2"), "doc_id").select("doc_id", "name", "url", "deadline")


@query("src_contests_archive", f"""with i as (select doc_id, unnest(from_json(body::json, '["JSON"]')) as j from contest_docs where kind = 3)
select doc_id, 'AtCoder: ' || (j->>'$.title') as name, 'https://atcoder.jp/contests/' || (j->>'$.id') as url, {_MIN.format("(j->>'$.start_epoch_second')::bigint")} as deadline from i where (j->>'$.start_epoch_second')::bigint > {_NOW}""")
def _(t):
    return apis.archive_contests(t.contest_docs.where("kind = 3"), _NOW, "doc_id").select("doc_id", "name", "url", "deadline")


@query("src_hackathon_api", """select p_partkey as doc_id, p_name || ' Hack ' || p_partkey as name, case p_size % 3 when 0 then 'In-Person' when 1 then 'Online' else 'Berlin' end as mode,
  '$' || p_size || ',000' as prize, case when p_size % 4 = 0 then 'Check event page' else 'Aug 01 - Sep 30, 2026' end as deadline, case p_size % 3 when 0 then 'open' when 1 then 'coming-soon' else 'closed' end as status,
  'devpost,hackathon,' || lower(p_type) || ',ai,health,fun' as tags, 'Live Hackathon on Devpost. Themes: ' || p_type || ', AI, Health, Fun.' as description,
  case when p_size % 5 = 0 then 'https://devpost.com/hackathons' else 'https://h' || p_partkey || '.example.com/' end as website from part""")
def _(t):
    return apis.hackathons(t.hack_docs, "doc_id").select("doc_id", "name", "mode", "prize", "deadline", "status", F.array_join("tags", ",").alias("tags"), "description", "website")


@query("src_job_feed", """select s_suppkey as doc_id, s_name || ': Software Engineer Intern ' || s_suppkey as name, 'internships' as category, 'https://j.example.com/' || s_suppkey as url, case when s_suppkey % 2 = 0 then '$1000 - $2000 / yr' else 'Competitive Remote Pay' end as prize from supplier
union all select s_suppkey, 'Tech Company: Data Scientist', 'jobs', 'https://u.example.com/' || s_suppkey, 'Competitive Remote Pay' from supplier""")
def _(t):
    return apis.jobs(t.job_docs, "doc_id").select("doc_id", "name", "category", "url", "prize")


@query("src_program", "select s_suppkey as doc_id, s_name as name, 'open-source-programs' as category, 'gsoc-api' as source from supplier")
def _(t):
    raw = t.supplier.selectExpr("s_suppkey as doc_id", "concat('{\"name\":\"', s_name, '\"}') as body")
    return apis.programs(raw, "doc_id").select("doc_id", "name", "category", "source")


@query("src_html_table", """select c_custkey as doc_id, c_name || ' — Engineer & Builder' as name, case c_nationkey % 4 when 0 then 'Bengaluru, IN' when 1 then 'New York, NY' when 2 then '' else 'Remote (US)' end as location,
  case c_nationkey % 4 when 0 then 'onsite' when 1 then 'onsite' when 2 then 'unknown' else 'remote_geo' end as location_mode, case c_nationkey % 4 when 0 then 'IN' when 2 then '' else 'US' end as country,
  case when c_custkey % 3 = 0 then 'https://ap.example.com/' || c_custkey else 'https://co.example.com/' || c_custkey end as application_link from customer
union all select c_custkey, c_mktsegment || ' — Analyst', 'Toronto', 'onsite', 'CA', 'https://simplify.jobs' from customer""")
def _(t):
    return (T.table_listings(t.html_docs, "doc_id")
            .select("doc_id", "name", "location", "location_mode", F.coalesce("country", F.lit("")).alias("country"), "application_link"))


@query("src_markdown_table", """select p_partkey as doc_id, 'name' as first_header, '**[' || p_name || '](https://ex.example.org/p/' || p_partkey || ')**' as first_cell, 4::bigint as n from part
union all select p_partkey, 'name', p_brand, 4 from part union all select p_partkey, 'event', '⭐ ' || p_type || ' days', 2 from part union all select p_partkey, 'event', '![badge](https://img.shields.io/x)', 2 from part""")
def _(t):
    return (T.markdown_rows(t.markdown_docs, "doc_id")
            .select("doc_id", F.get("cells.h", F.lit(0)).alias("first_header"), F.get("cells.v", F.lit(0)).alias("first_cell"), F.size("cells").cast("bigint").alias("n")))


@query("src_markdown_programs", """select p_partkey as doc_id, p_name as name, '$' || p_size || '00' as stipend, '2026-10-01' as deadline, 'Remote' as mode, 'https://ex.example.org/p/' || p_partkey as application_link from part
union all select p_partkey, p_brand, 'Check program page', 'Rolling', 'Online / Remote', 'https://github.com' from part
union all select p_partkey, p_type || ' days', 'Check program page', 'Annual / Check page', 'Online / Remote', 'https://ev.example.org/' || p_size from part""")
def _(t):
    return T.markdown_programs(t.markdown_docs, "doc_id").select("doc_id", "name", "stipend", "deadline", "mode", "application_link")


@query("src_markdown_positional", """select p_partkey as doc_id, '**[' || p_name || '](https://ex.example.org/p/' || p_partkey || ')**' as name, '$' || p_size || '00' as description, '2026-10-01' as eligibility, 'Remote' as deadline,
  'https://ex.example.org/p/' || p_partkey as application_link from part
union all select p_partkey, p_brand, '', 'Rolling', 'Check program page', 'Check program page' from part
union all select p_partkey, '⭐ ' || p_type || ' days', '<https://ev.example.org/' || p_size || '>', 'Check program page', 'Check program page', 'Check program page' from part
union all select p_partkey, '![badge](https://img.shields.io/x)', 'y', 'Check program page', 'Check program page', 'https://img.shields.io/x' from part""")
def _(t):
    return (T.positional_programs(t.markdown_docs, "doc_id")
            .select("doc_id", "name", "description", "eligibility", "deadline", "application_link"))


@query("src_markdown_list", """select p_partkey as doc_id, p_type as name, 'grant ' || p_brand as description, 'https://ex.example.org/t/' || p_partkey as application_link from part
union all select p_partkey, p_name, 'note', 'https://ex.example.org/n' from part""")
def _(t):
    return T.markdown_list(t.markdown_docs, "doc_id").select("doc_id", "name", "description", "application_link")


@query("src_markdown_sections", """select p_partkey as doc_id, 'hackathons' as category, p_name as name, 'Pune' as mode, 'Oct 2026' as deadline, 'https://s.example.com/' || p_partkey as application_link from part
union all select p_partkey, 'competitions', p_type || ' Cup', 'Online', 'Check competition portal', 'https://unstop.com' from part
union all select p_partkey, 'fellowships', p_brand || ' Fellows', 'Check listing', 'Annual / Check portal', 'https://fel.example.com/' from part""")
def _(t):
    return T.markdown_sections(t.sections_docs, "doc_id").select("doc_id", "category", "name", "mode", "deadline", "application_link")


_ENTRIES = """entries as (select p_partkey as doc_id, 0 as pos, p_name || ' hackathon is open' as title, 'https://f.example.com/' || p_partkey as link, 'Tue, 01 Sep 2026' as published, 'Apply & win' as summary, p_brand, p_size from part where p_partkey % 2 = 0
union all select p_partkey, 1, 'Take our ' || p_type || ' quiz', 'https://f.example.com/q', '', '', p_brand, p_size from part where p_partkey % 2 = 0
union all select p_partkey, 0, 'The challenge of ' || p_type, 'https://a.example.com/' || p_partkey, '2026-09-01', 'apply now soon', p_brand, p_size from part where p_partkey % 2 = 1)"""


@query("src_feed_entries", f"with {_ENTRIES} select doc_id, pos, title, link, published, summary from entries")
def _(t):
    return T.feed_entries(t.feed_docs, "doc_id").withColumn("summary", F.regexp_replace("summary", " +", " "))


@query("filter_news", f"with {_ENTRIES} select doc_id, pos from entries where {D.any_in(chr(40) + 'lower(title || chr(32) || summary)' + chr(41), V.STRONG_NEWS)} or ({D.any_in('lower(title || chr(32) || summary)', V.WEAK_NEWS)} and {D.any_in('lower(title || chr(32) || summary)', V.APPLY_SIGNALS)})")
def _(t):
    return T.feed_entries(t.feed_docs, "doc_id").where(news_announcement(F.col("title"), F.col("summary"))).select("doc_id", "pos")


@query("src_feed_records", f"""with {_ENTRIES} select doc_id, pos, title as name, link as application_link, 'reach:news:' || p_brand as source, summary as description, '' as deadline from entries
where p_size % 2 = 1 or {D.any_in('lower(title || chr(32) || summary)', V.STRONG_NEWS)} or ({D.any_in('lower(title || chr(32) || summary)', V.WEAK_NEWS)} and {D.any_in('lower(title || chr(32) || summary)', V.APPLY_SIGNALS)})""")
def _(t):
    rows = T.feed_records(T.feed_entries(t.feed_docs, "doc_id", "source", "filter"), "doc_id")
    return rows.select("doc_id", "pos", "name", "application_link", "source", F.regexp_replace("description", " +", " ").alias("description"), "deadline")


@query("reader_record", f"with {_ENTRIES} select doc_id, pos, '' as organizer, '' as deadline, 'open' as status, 'agent-reach' as tags from entries where p_size % 2 = 1 or contains(title, 'hackathon') or contains(title, 'challenge')")
def _(t):
    rows = T.feed_records(T.feed_entries(t.feed_docs, "doc_id", "source", "filter"), "doc_id")
    return rows.select("doc_id", "pos", "organizer", "deadline", "status", F.array_join("tags", ",").alias("tags"))


@query("src_listing_links", """select c_custkey as doc_id, c_mktsegment || ' Hackathon ' || c_custkey as name, 'https://list.example.com/hackathons/' || c_custkey || '/' as application_link from customer
union all select c_custkey, 'Spring coding challenge', 'https://list.example.com/deep/challenge?x=1' from customer""")
def _(t):
    return T.listing_links(t.listing_docs, "doc_id").select("doc_id", "name", "application_link")


@query("src_search_hits", f"""with h as (select post_id, trim(regexp_replace(regexp_replace(title || ' challenge', '[{D.S}]+', ' ', 'g'), '^[#*\\-•\\d.\\s]+', '')) as name, body as description from posts)
select post_id, name, description from h where length(name) >= 8 and regexp_matches(name, '[A-Za-z]{{3}}') and {D.any_in('lower(name)', V.LISTING_HINTS)} and not regexp_matches(lower(name), '^(http|www\\.|data:)')""")
def _(t):
    hits = t.posts.selectExpr("post_id", "title || ' challenge' as title", "permalink as url", "body as snippet")
    return T.search_records(hits, "post_id").select("post_id", "name", "description")


@query("src_reader_payload", "select doc_id, 'Doc ' || doc_id as title, regexp_replace(text, '^\\s+', '') as body from documents")
def _(t):
    docs = t.documents.selectExpr("doc_id", "'Title: Doc ' || doc_id || '\nURL Source: https://x/\n\nMarkdown Content:\n' || text as body")
    return T.reader_payload(docs, "doc_id").select("doc_id", "title", F.col("text").alias("body"))


@query("src_text_blocks", """select c_custkey as doc_id, 'Post ' || c_name as title, 'https://lone.example.com/' || c_custkey as url, 'first line more of ' || c_mktsegment as body from customer
union all select c_custkey, 'Second', 'https://b.example.com/' || c_nationkey, ' free text' from customer""")
def _(t):
    return T.post_blocks(t.block_docs, "doc_id").select("doc_id", "title", "url", "body")


@query("src_tweet_blocks", "select c_custkey as doc_id, 'Big hackathon number ' || c_custkey || ' starts' as text, '@u' || c_nationkey as author, 'https://t.example.com/' as url from customer")
def _(t):
    return T.tweet_blocks(t.block_docs, "doc_id").select("doc_id", "text", "author", "url")


@query("src_tweets_records", """select c_custkey as doc_id, 'Big hackathon number ' || c_custkey || ' starts' as name, 'hackathons' as category, '@u' || c_nationkey as organizer,
  'twitter-' || case c_custkey % 3 when 0 then 'csMajors' else 'hackathons' end as source, true as needs_review from customer""")
def _(t):
    tweets = T.tweet_blocks(t.block_docs, "doc_id", "channel")
    return social.tweet_records(tweets, "doc_id").select("doc_id", "name", "category", "organizer", "source", "needs_review")


@query("src_posts_json", """select s_suppkey as doc_id, 'Flat ' || s_name as title, 'x' as body, 'https://reddit.com/r/a/1' as permalink, 3 as score from supplier where s_suppkey % 2 = 0
union all select s_suppkey, 'Deep ' || s_name, '', 'https://reddit.com/r/b/2', 0 from supplier where s_suppkey % 2 = 1 union all select s_suppkey, 'Two', '', 'https://reddit.com', 0 from supplier where s_suppkey % 2 = 1""")
def _(t):
    return apis.posts(t.post_answers, "doc_id").select("doc_id", "title", "body", "permalink", "score")


@query("filter_keywords_posts", f"select post_id from posts where {D.any_in('lower(title || chr(32) || body)', V.POST_KEYWORDS)}")
def _(t):
    return social.relevant_posts(t.posts).select("post_id")


_FULL = f"({D.strip('title')} || ' ' || {D.strip('body')})"
_REWARD = "coalesce(" + ", ".join(f"case when regexp_matches({_FULL}, {D.q(p)}) and length({D.strip(f'regexp_extract({_FULL}, {D.q(p)}, 1)')}) < 40 then {D.strip(f'regexp_extract({_FULL}, {D.q(p)}, 1)')} end" for p in V.REWARD_PATTERNS) + ")"
_DESC = f"case when {D.strip('body')} <> '' then {D.strip('body')} else {D.strip('title')} end"


@query("src_posts_records", f"""with p as (select *, {D.cascade(f'lower({_FULL})', V.POST_CATEGORY, 'competitions')} as topic, {D.strip('title')} as name, {_DESC} as description, {_REWARD} as reward from posts
  where {D.any_in('lower(title || chr(32) || body)', V.POST_KEYWORDS)})
select post_id, 'reddit-' || channel || '-' || lower(regexp_replace({D.strip('title')}, '[^a-zA-Z0-9]', '', 'g')) as id, name, topic, {D.cascade("lower(name || ' ' || description)", V.SOCIAL_CATEGORY, 'hackathons')} as category, description,
  coalesce({D.first_match(_FULL, V.DEADLINE_PATTERNS)}, 'Check community post') as deadline, case topic when 'hackathons' then coalesce(reward, 'Community Hackathon') when 'competitions' then coalesce(reward, 'Prizes & Recognition') end as prize,
  case topic when 'internships' then coalesce(reward, 'Competitive / Check listing') when 'open-source-programs' then coalesce(reward, 'Stipend / Mentorship') end as stipend,
  coalesce(case when url <> '' and not (contains(url, 'reddit.com') or contains(url, 'redd.it')) then url else regexp_replace({D.first_match('body', V.POST_URL_PATTERNS, 0)}, '[).,;]+$', '') end, permalink) as application_link from p""")
def _(t):
    rows = social.post_records(social.relevant_posts(t.posts), "post_id")
    return rows.select("post_id", "id", "name", F.element_at("tags", 4).alias("topic"), "category", "description", "deadline", "prize", "stipend", "application_link")


def _card_sql():
    cols = lambda c: "case site " + " ".join(f"when '{s}' then {D.q(str(d.get(c) or ''))}" for s, d in cards.SITES.items()) + " end"
    link = "case when link like '/%' and root <> '' then root || link when link like 'http%' then link else '' end"
    return f"""with d as (select *, {cols('root')} as root, {cols('home')} as home, {cols('least')}::int as least, {cols('organizer')} as dorg, {cols('prize')} as dprize, {cols('deadline')} as ddl, {cols('mode')} as dmode, {cols('category')} as dcat,
  {cols('tags')} || case when site <> 'hackerearth' then '' when regexp_matches(lower(name), 'hack|buildathon') then ',hackathon' else ',competition' end as tags from landed_cards)
select card_id, case when site = 'linkedin' then case when organizer <> '' then organizer else dorg end || ': ' || name else name end as name, case when organizer <> '' then organizer else dorg end as organizer,
  case when site = 'linkedin' and contains(lower(name), 'intern') then 'internships' else dcat end as category, case when prize <> '' then prize else dprize end as prize, ddl as deadline,
  case when site <> 'linkedin' then case when {link} <> '' then {link} else home end end as application_link, case when site = 'linkedin' then split_part(link, '?', 1) end as url,
  case when site <> 'linkedin' then 'open' end as status, tags,
  case when site = 'internshala' and contains(lower(location), 'work from home') then 'Remote / Work From Home' when site = 'internshala' and location <> '' then location else dmode end as mode
from d where length(name) >= least and not (site = 'mlh' and lower(name) in ('mlh', 'major league hacking', 'menu', 'events'))"""


@query("src_defaults", _card_sql())
def _(t):
    return (cards.apply_source_defaults(t.landed_cards, cards.defaults_table(t.spark))
            .select("card_id", "name", "organizer", "category", "prize", "deadline", "application_link", "url", "status", F.array_join("tags", ",").alias("tags"), "mode"))


# ---- catalogue and union -------------------------------------------------

_CATALOGUE = [("ListA", "markdown_docs", "markdown_table", "open-source-programs", None, None, True),
              ("ListB", "markdown_list_docs", "markdown_list", "fellowships", None, None, True),
              ("Off", "html_docs", "html_table", "jobs", None, None, False),
              ("News", "feed_docs", "feed", "hackathons", 1, "keywords", True)]


def _route_inputs(t):
    md = t.markdown_docs.selectExpr("doc_id * 4 as capture_id", "'markdown_docs' as url", "body")
    lists = t.markdown_docs.selectExpr("doc_id * 4 + 1 as capture_id", "'markdown_list_docs' as url", "body")
    html = t.html_docs.selectExpr("doc_id * 4 + 2 as capture_id", "'html_docs' as url", "body")
    feeds = t.feed_docs.selectExpr("doc_id * 4 + 3 as capture_id", "'feed_docs' as url", "body")
    cat = t.spark.createDataFrame(_CATALOGUE, "name string, url string, parser string, category string, limit int, filter string, enabled boolean")
    return md.unionByName(lists).unionByName(html).unionByName(feeds), cat


@query("route_sources")
def _(t):
    from ..sources.registry import route
    out = route(*_route_inputs(t))
    return out.groupBy("origin", "category").agg(F.count("*").alias("n"))


def _sources():
    """Three sources over one landing table and one that fails."""
    from ..sources.seed import seed_records

    def broken(captures):
        raise ValueError("unreadable answer")

    return {"codeforces": ("competitions", lambda c: apis.epoch_contests(c.where("kind = 0"), "doc_id").withColumn("seq", F.col("doc_id") * 16 + F.col("pos"))),
            "leetcode": ("competitions", lambda c: apis.query_contests(c.where("kind = 1"), _NOW, "doc_id").withColumn("seq", F.col("doc_id") * 16 + F.col("pos"))),
            "company": (None, lambda c: seed_records(c.sparkSession)), "mlh": ("hackathons", broken)}


@query("union_sources", f"""with i as (select doc_id, unnest(from_json(body::json->'$.result', '["JSON"]')) as j from contest_docs where kind = 0 and (body::json->>'$.status') = 'OK'),
k as (select doc_id, unnest(from_json(body::json->'$.data.allContests', '["JSON"]')) as j from contest_docs where kind = 1)
select 'codeforces' as origin, 'competitions' as category, coalesce(j->>'$.name', 'Codeforces Contest') as name from i where (j->>'$.phase') = 'BEFORE'
union all select 'leetcode', 'competitions', j->>'$.title' from k where (j->>'$.startTime')::bigint > {_NOW}
union all select 'company', 'hackathons', unnest(['Razorpay AI Buildathon 2026', 'Flipkart GRiD 6.0 / 7.0 — Software Development Challenge', 'Amazon WOW (Women of the World) Technology Challenge', 'Google Solution Challenge 2026', 'Microsoft Imagine Cup 2026'])""")
def _(t):
    from ..sources.registry import union_sources
    return union_sources(t.contest_docs, _sources())[0].select("origin", "category", "name")


@query("source_report", f"""with i as (select doc_id, unnest(from_json(body::json->'$.result', '["JSON"]')) as j from contest_docs where kind = 0 and (body::json->>'$.status') = 'OK'),
k as (select doc_id, unnest(from_json(body::json->'$.data.allContests', '["JSON"]')) as j from contest_docs where kind = 1)
select 'codeforces' as origin, 'competitions' as category, count(*) as n, '' as error from i where (j->>'$.phase') = 'BEFORE' union all select 'leetcode', 'competitions', count(*), '' from k where (j->>'$.startTime')::bigint > {_NOW}
union all select 'company', 'hackathons', 5, '' union all select 'mlh', '', 0, 'unreadable answer'""")
def _(t):
    from ..sources.registry import source_report, union_sources
    return source_report(*union_sources(t.contest_docs, _sources()))


# typed by hand: what the seed adds to the hackathons
_SEEDED = """(values
 ('razorpay-ai-buildathon-2026', 'Razorpay', '2026-09-05', 'https://razorpay.com/buildathon/', 9, 'Students & Early-Career Developers (B.Tech / M.Tech / BCA / MCA / Self-taught)', 'Build-to-Hire AI Hackathon by Razorpay. '),
 ('flipkart-grid-software-challenge', 'Flipkart', 'Rolling / Annual (Check Portal)', 'https://unstop.com/competitions/flipkart-grid-60-software-development-track-flipkart-995200', 7, 'B.Tech/B.E./M.Tech students (Batches 2025, 2026, 2027, 2028)', 'Flipkart''s flagship campus engineering c'),
 ('amazon-wow-india', 'Amazon', 'Rolling (Annual Registration)', 'https://amazon.jobs/en/landing_pages/wow-india', 7, 'Female engineering students (B.E./B.Tech/M.E./M.Tech/MCA/MS)', 'Amazon''s diversity hiring and coding pro'),
 ('google-solution-challenge-2026', 'Google Developer Student Clubs', '2026-03-31', 'https://developers.google.com/community/gdsc-solution-challenge', 7, 'University students globally (GDSC members or individual students)', 'Annual global student hackathon where un'),
 ('microsoft-imagine-cup-2026', 'Microsoft', '2026-01-25', 'https://imaginecup.microsoft.com/', 7, 'Students aged 16+ enrolled in high school or university (global)', 'Global student technology competition by')
) v(id, organizer, deadline, application_link, n_tags, eligibility, opening)"""


@query("src_static_seed", f"""select category, id, organizer, deadline, application_link, len(tags)::int as n_tags, eligibility, left(description, 40) as opening, 0 as seeded from opp
union all select 'hackathons', id, organizer, deadline, application_link, n_tags, eligibility, opening, 1 from {_SEEDED}""")
def _(t):
    from ..sources.seed import seed_records
    cols = ["category", "id", "organizer", "deadline", "application_link", F.size("tags").alias("n_tags"), "eligibility", F.substring("description", 1, 40).alias("opening")]
    return t.opp.select(*cols, F.lit(0).alias("seeded")).unionByName(seed_records(t.spark).select(*cols, F.lit(1).alias("seeded")))
