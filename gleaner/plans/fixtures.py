"""Record views derived from the given tables.

Every text runs unchanged in Spark SQL and in DuckDB, so a query and its check
start from the same rows.  The fixed date of all of them is AS_OF.  A column
``batch`` names the delivery of a record: some deliveries make up the existing
snapshot and the others arrive, so that both together are the whole table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

AS_OF = "2026-09-01"
NOW = "2024-02-01 00:00:00"

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

VIEWS: dict[str, str] = {}

VIEWS["opp"] = """
select doc_id as seq, cast(doc_id % 3 as int) as batch,
  case when doc_id % 2 = 0 then 'id-' || cast(doc_id as string) else '' end as id,
  case when doc_id % 11 = 5 then 'open-source-programs' when doc_id % 11 = 6 then 'fellowships'
    else case doc_id % 4 when 0 then 'hackathons' when 1 then 'internships' when 2 then 'jobs' else 'competitions' end end as category,
  case when doc_id % 97 = 0 then '' when doc_id % 41 = 7 then 'Google ' || words || ' Intern'
    when doc_id % 41 = 11 then 'SUMMER CODING CAMP ' || cast(doc_id % 5 as string) when doc_id % 41 = 13 then 'AI'
    when doc_id % 41 = 15 then 'Open-Source Hackathon ' || words else words end as name,
  case doc_id % 5 when 0 then '' when 1 then 'Major | Org' else 'Org ' || cast(doc_id % 50 as string) end as organizer,
  text || case doc_id % 23 when 0 then ' Remote work from home, python and machine learning internship.'
    when 1 then ' Hybrid role in the cloud security team, new grad.'
    when 2 then ' On-site research, must be authorized to work in the United States.'
    when 3 then ' Applications closed for this summer.' when 4 then ' This guaranteed income network marketing offer.'
    when 5 then ' Earn money fast!!!! refer and earn, limited spots act now.' when 6 then ' Open source GSoC mentorship, LFX.'
    when 7 then ' Entry level junior developer at nvidia.' when 8 then ' Fellowship grant in research for India.'
    when 9 then ' Coding contest challenge, online.' when 10 then ' UK only, no green card.' else '' end as description,
  case doc_id % 8 when 0 then 'Students' when 1 then 'US only' when 3 then 'EU-based students' else '' end as eligibility,
  case doc_id % 10 when 0 then 'Online' when 1 then 'In-person' when 2 then 'Hybrid' when 3 then 'Remote - UK' else '' end as mode,
  case doc_id % 6 when 0 then 'Free' when 1 then 'Entry fee 10' else '' end as fee,
  case doc_id % 7 when 0 then '$5,000 cash' when 1 then '₹75,000' when 2 then 'Swag' when 3 then '120000 points' else '' end as prize,
  case doc_id % 9 when 0 then '$2000 per month' when 1 then 'Paid' when 2 then 'grant' else '' end as stipend,
  case doc_id % 4 when 0 then '10 weeks' else '' end as duration,
  case doc_id % 7 when 0 then 'Rolling' when 1 then '' when 2 then case doc_id % 3 when 0 then 'Check page' when 1 then 'n/a' else 'Entries ended' end
    when 3 then cast(date '2026-06-01' + cast(doc_id % 200 as int) as string)
    when 4 then cast(date '2025-11-01' + cast(doc_id % 500 as int) as string)
    when 5 then case doc_id % 9 when 0 then 'Jul 31 - Oct 01, 2026' when 1 then 'September 30, 2026' when 2 then '5 Sep 2026'
      when 3 then '09/15/2026' when 4 then '2026-09-08 10:00 UTC' when 5 then 'Sep 4' when 6 then 'Summer 2025'
      when 7 then 'Aug 2026 to Nov 2026' else 'Oct 3rd, 2026' end
    else cast(date '2028-01-01' + cast(doc_id % 900 as int) as string) end as deadline,
  case doc_id % 6 when 0 then '' when 1 then cast(date '2026-08-01' + cast(doc_id % 120 as int) as string) when 2 then 'October 12, 2026'
    when 3 then 'Sep 18 - 20, 2026' when 4 then 'TBD' else '2026-09-15 10:00 UTC' end as event_date,
  case when doc_id % 13 = 0 then '' else 'https://www.' || source || '.example.org/' || lang || '/' || cast(doc_id % 800 as string)
    || case when doc_id % 3 = 0 then '/' when doc_id % 5 = 0 then '?utm_source=x' else '' end end as application_link,
  case doc_id % 3 when 0 then 'https://' || source || '.example.org/' when 1 then 'https://mirror.example.net/' || cast(doc_id as string) else '' end as website,
  case when doc_id % 26 = 0 then 'https://alt.example.com/' || cast(doc_id as string) else '' end as url,
  case when doc_id % 39 = 0 then 'https://link.example.com/' || cast(doc_id as string) else '' end as link,
  split(case doc_id % 4 when 0 then 'hackathon,python' when 1 then 'internship,Remote' when 2 then 'jobs' else 'contest,AI' end, ',') as tags,
  case doc_id % 6 when 0 then 'closed' when 1 then 'coming-soon' when 2 then case when doc_id % 5 = 0 then 'unlisted' else 'open' end else 'open' end as status,
  case doc_id % 9 when 0 then 'devpost-live-api' when 1 then 'mlh-live-events' when 2 then 'reddit:r/hackathons'
    when 3 then 'github-ListA' when 4 then 'reach:web:unstop' when 5 then 'twitter-#hackathon'
    when 6 then 'company:acme' when 7 then 'reddit:r/leetcode' else '' end as source,
  case doc_id % 24 when 0 then 'Bengaluru, IN' when 1 then 'Fort Wayne, IN' when 2 then 'Remote (US)' when 3 then 'New York, NY'
    when 4 then 'Hybrid - London' when 5 then 'San FranciscoNew York' when 6 then 'Remote, worldwide' when 7 then 'Remote'
    when 8 then 'Pune' when 9 then 'Toronto' when 10 then 'on-site' when 11 then 'Remote - EU' when 12 then 'Jammu & Kashmir'
    when 13 then 'Mexico City / Paris' when 14 then 'Karnataka' when 15 then 'U.S. | Remote' when 16 then 'Zürich' when 17 then 'SG'
    when 18 then 'Work from home, Germany' when 19 then 'Salt Lake City' when 20 then 'Various Canadian Universities' else '' end as location,
  case doc_id % 5 when 0 then '' when 1 then 'remote' when 2 then 'remote_geo' when 3 then 'onsite' else 'hybrid' end as location_mode,
  case when doc_id % 5 = 0 then '' else case doc_id % 7 when 0 then 'IN' when 1 then 'US' when 2 then 'CA' when 3 then 'GB' when 4 then 'SG' else '' end end as country,
  case doc_id % 10 when 0 then 'Online' when 5 then 'In-person, Berlin' else '' end as location_label
from (select *, replace(text, chr(10), ' ') as words from documents) d
"""

VIEWS["titles"] = """
select doc_id as seq, lang as category, replace(text, chr(10), ' ') as name,
  doc_id % 3 = 0 as known from documents
"""

VIEWS["opp_pages"] = """
select page_id as seq, cast(page_id % 7 as int) as batch,
  case when page_id % 5 = 0 then 'Unrelated distinctive listing ' || cast(page_id as string)
       else trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) end as name,
  case page_id % 4 when 0 then 'hackathons' when 1 then 'internships' when 2 then 'jobs' else 'competitions' end as category,
  case page_id % 5 when 0 then 'devpost-live-api' when 1 then 'reddit:r/hackathons' when 2 then 'reach:web:unstop' when 3 then 'github-ListA' else 'company:acme' end as source,
  case when page_id % 29 = 0 then '' else url end as application_link,
  case page_id % 3 when 0 then 'https://mirror.example.net/' when 1 then url else '' end as website, '' as url, '' as link,
  case page_id % 4 when 0 then '' when 1 then 'Rolling' else cast(date '2026-07-01' + cast(page_id % 120 as int) as string) end as deadline,
  case page_id % 3 when 0 then '' else cast(date '2026-08-01' + cast(page_id % 90 as int) as string) end as event_date,
  case page_id % 6 when 0 then 'closed' else 'open' end as status,
  case page_id % 3 when 0 then '' else 'Org ' || cast(page_id % 9 as string) end as organizer, case page_id % 4 when 0 then '$100' else '' end as prize,
  case page_id % 13 when 0 then 'Free bitcoin for all' when 1 then 'Refer and earn, too good to be true!!!!' else 'A listing' end as description,
  split(case page_id % 2 when 0 then 'a,b' else 'c' end, ',') as tags
from pages
"""

VIEWS["captures"] = """
select page_id, url, case when page_id % 17 = 0 then 'https://other.example.net/' when page_id % 19 = 0 then regexp_extract(url, '^https?://[^/]+/', 0) else url end as final_url,
  case when page_id % 31 = 0 then null else case page_id % 11 when 0 then 404 when 1 then 403 when 2 then 500 else 200 end end as status,
  case when page_id % 31 = 0 then 'network:timeout' else '' end as error,
  case when page_id % 11 in (0, 1, 2) or page_id % 31 = 0 then ''
       when page_id % 7 = 0 then '<html><head><title>Just a moment...</title></head><body>verify you are a human</body></html>'
       when page_id % 7 = 1 then replace(html, '<style>', '<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"WebSite","name":"Site"},{"@type":"Event","name":"' || trim(regexp_extract(html, '<title>([^<"&]*)', 1)) || '","startDate":"' || cast(date '2026-08-01' + cast(page_id % 200 as int) as string) || '","endDate":"' || cast(date '2026-08-03' + cast(page_id % 200 as int) as string) || 'T18:00:00Z","organizer":{"@type":"Organization","name":"Org ' || cast(page_id % 9 as string) || '"},"offers":[{"price":"' || cast(page_id % 50 as string) || '","priceCurrency":"USD"}],"eventStatus":"https://schema.org/' || case when page_id % 3 = 0 then 'EventCancelled' else 'EventScheduled' end || '"}]}</script><style>')
       when page_id % 7 = 2 then replace(html, '<style>', '<meta property="og:title" content="Open listing ' || cast(page_id as string) || '"><meta name="description" content="A listing"><meta property="og:site_name" content="Site"><style>')
       when page_id % 7 = 3 then replace(html, '<article>', '<article><p>Registration is closed.</p>')
       when page_id % 7 = 4 then replace(html, '<style>', '<script type="application/ld+json">{"@type":["JobPosting"],"title":"Posting ' || cast(page_id as string) || '","validThrough":"' || cast(date '2026-08-15' + cast(page_id % 90 as int) as string) || '","datePosted":"2026-07-01","hiringOrganization":{"name":"Firm ' || cast(page_id % 5 as string) || '"}}</script><style>')
       when page_id % 7 = 5 then replace(html, '<title>', '<title>Page not found: ')
       else html end as body
from pages
union all
select page_id + 2000000000 as page_id, replace(url, '://', '://whole.') as url, replace(url, '://', '://whole.') as final_url, 200 as status, '' as error, html as body
from pages where page_id % 11 in (0, 1, 2) or page_id % 31 = 0 or page_id % 7 = 0
"""

VIEWS["captures_all"] = """
select page_id as capture_id, 0 as tier, url, final_url, status, error, body from captures
union all
select page_id + 1000000000 as capture_id, 1 as tier, url, url as final_url, 200 as status, '' as error,
  replace(html, '<style>', '<meta property="og:title" content="Rendered ' || cast(page_id as string) || '"><style>') as body
from pages where page_id % 11 in (0, 1, 2)
"""

VIEWS["decisions"] = """
select event_id as seq, substring(sha1(cast(user_id as string)), 1, 20) as fp,
  case user_id % 3 when 0 then 'hackathons' when 1 then 'jobs' else 'fellowships' end as category,
  'User ' || cast(user_id as string) as name, 'src-' || cast(user_id % 4 as string) as source, 'https://u.example.org/' || cast(user_id as string) as link,
  case event_type when 'error' then 'reject' when 'view' then 'quarantine' else 'accept' end as decision,
  case when event_type = 'error' and value > 50 then 'L1' when event_type = 'error' and value > 40 then 'quarantine-expiry' else 'L2' end as layer,
  ts as checked_at, cast(event_id % 100 as double) / 100 as trust, event_type || ':' || cast(event_id % 7 as string) as reason
from events
"""

VIEWS["subscribers"] = """
select 'c' || cast(c_custkey as string) || '@example.org' as email,
  case c_nationkey % 3 when 0 then '' when 1 then '+4415' || cast(c_custkey as string) else '98' || cast(c_custkey as string) end as whatsapp,
  case c_nationkey % 4 when 0 then 'hackathons' when 1 then 'internships,jobs' when 2 then 'competitions' else 'jobs,hackathons,competitions' end as categories
from customer
"""

VIEWS["posts"] = """
select conv_id * 1000 + turn as post_id, case conv_id % 3 when 0 then 'hackathons' when 1 then 'developersIndia' else 'csMajors' end as channel,
  replace(text, chr(10), ' ') as title,
  text || case turn % 6 when 0 then ' Hackathon deadline: 2026-09-30 see https://devfolio.co/h/x).' when 1 then ' Paid internship, apply by: September 30, 2026 stipend: $500 per month.'
    when 2 then ' Win $5,000 cash' when 3 then ' New fellowship grant, last date: Oct 3rd, 2026; ₹50,000 each' when 4 then ' GSoC mentorship program prize: big swag. https://x.example.org/apply/now;' else '' end as body,
  case turn % 3 when 0 then 'https://www.reddit.com/r/x/' || cast(conv_id as string) when 1 then '' else 'https://site.example.org/' || cast(conv_id as string) end as url,
  'https://reddit.com/r/p/' || cast(conv_id as string) || '/' || cast(turn as string) as permalink
from conversations
"""

VIEWS["markdown_docs"] = """
select p_partkey as doc_id,
  '# Programs' || chr(10) || chr(10) || '| Name | Stipend | Deadline | Location |' || chr(10) || '|:---|:---|---|---|' || chr(10)
  || '| **[' || p_name || '](https://ex.example.org/p/' || cast(p_partkey as string) || ')** | $' || cast(p_size as string) || '00 | 2026-10-01 | Remote |' || chr(10)
  || '| ' || p_brand || ' | | Rolling |' || chr(10) || 'text' || chr(10) || '| Event | Link |' || chr(10) || '|---|---|' || chr(10)
  || '| ⭐ ' || p_type || ' days | <https://ev.example.org/' || cast(p_size as string) || '> |' || chr(10) || '| ![badge](https://img.shields.io/x) | y |' || chr(10)
  || chr(10) || '- [' || p_type || '](https://ex.example.org/t/' || cast(p_partkey as string) || ') - grant ' || p_brand || chr(10)
  || '2. [Awesome list](https://ex.example.org/a)' || chr(10) || '* [' || p_name || '](https://ex.example.org/n): note' || chr(10) as body
from part
"""

VIEWS["contest_docs"] = """
select c_custkey as doc_id, kind, case kind
  when 0 then '{"status":"' || case when c_custkey % 20 = 0 then 'FAILED' else 'OK' end || '","result":[{"id":' || cast(c_custkey as string) || ',"name":"Round ' || cast(c_custkey as string) || '","type":"ICPC_LIKE","phase":"BEFORE","startTimeSeconds":'
    || cast(1704067200 + c_custkey * 977 as string) || ',"durationSeconds":9000},{"id":7,"name":"Old","type":"CF","phase":"FINISHED","startTimeSeconds":1,"durationSeconds":7200},{"id":8,"type":"CF","phase":"BEFORE"}]}'
  when 1 then '{"data":{"allContests":[{"title":"Weekly ' || cast(c_custkey as string) || '","titleSlug":"weekly-' || cast(c_custkey as string) || '","startTime":' || cast(1704067200 + c_custkey * 9770 as string) || ',"duration":5400},{"title":"Later","titleSlug":"","startTime":1900000000,"duration":0},{"title":"Sooner","titleSlug":"s","startTime":1800000000,"duration":60}]}}'
  when 2 then '{"future_contests":[{"contest_name":"Starters ' || cast(c_custkey as string) || '","contest_code":"S' || cast(c_custkey as string) || '","contest_start_date":"2026-09-10","contest_end_date":"' || case when c_custkey % 8 = 2 then '' else '2026-09-12' end || '"}],"present_contests":[{"contest_name":"Now","contest_code":"N"}]}'
  else '[{"id":"abc' || cast(c_custkey as string) || '","title":"Beginner ' || cast(c_custkey as string) || '","start_epoch_second":' || cast(1704067200 + c_custkey * 9770 as string) || '},{"id":"z","title":"Old","start_epoch_second":5}]' end as body
from customer cross join (values (0), (1), (2), (3)) as k(kind)
"""

VIEWS["hack_docs"] = """
select p_partkey as doc_id, '{"hackathons":[{"title":" ' || p_name || ' Hack ' || cast(p_partkey as string) || ' ","url":"' || case when p_size % 5 = 0 then '' else 'https://h' || cast(p_partkey as string) || '.example.com/' end || '","submission_period_dates":"' || case when p_size % 4 = 0 then '' else 'Aug 01 - Sep 30, 2026' end
  || '","prize_amount":"$<span data-currency-value>' || cast(p_size as string) || ',000</span>","themes":[{"name":"' || p_type || '"},{"name":""},{"name":"AI"},{"name":"Health"},{"name":"Fun"}],"displayed_location":'
  || case p_size % 3 when 0 then '{"location":"In-person only"}' when 1 then '{"location":"Online"}' else '{"location":"Berlin"}' end || ',"open_state":"' || case p_size % 3 when 0 then 'open' when 1 then 'upcoming' else 'ended' end || '"},{"title":"","url":"x"}]}' as body
from part
"""

VIEWS["job_docs"] = """
select s_suppkey as doc_id, '{"jobs":[{"title":"Software Engineer Intern ' || cast(s_suppkey as string) || '","companyName":"' || s_name || '","applicationLink":"https://j.example.com/' || cast(s_suppkey as string) || '","minSalary":"' || case when s_suppkey % 2 = 0 then '1000' else '' end || '","maxSalary":"2000","location":"Remote"},{"title":"Gardener","companyName":"G"},{"title":"Data Scientist","url":"https://u.example.com/' || cast(s_suppkey as string) || '"}]}' as body
from supplier
"""

VIEWS["html_docs"] = """
select c_custkey as doc_id, '<h2>Jobs</h2><table><thead><tr><th>Company</th><th>Role</th><th>Location</th><th>Apply</th></tr></thead><tbody><tr><td><a href="https://co.example.com/' || cast(c_custkey as string) || '">' || c_name || '</a></td><TD>Engineer &amp; Builder</TD><td>'
  || case c_nationkey % 4 when 0 then 'Bengaluru, IN' when 1 then 'New York, NY' when 2 then '' else 'Remote (US)' end || '</td><td>' || case when c_custkey % 3 = 0 then '<a href="https://ap.example.com/' || cast(c_custkey as string) || '"><img src="x"></a>' else 'n/a' end
  || '</td></tr><tr><td>Locked 🔒</td><td>Role</td><td>Pune</td></tr><tr><td>Two</td><td>cells</td></tr><tr class="x"><td>' || c_mktsegment || '</td><td><a href="/rel">Analyst</a></td><td>Toronto</td><td></td></tr></tbody></table>' as body
from customer
"""

VIEWS["feed_docs"] = """
select p_partkey as doc_id, 'reach:news:' || p_brand as source, case when p_size % 2 = 0 then 'keywords' else '' end as filter, case when p_partkey % 2 = 0 then
  '<?xml version="1.0"?><rss><channel><title>Feed</title><item><title>' || p_name || ' hackathon is open</title><link>https://f.example.com/' || cast(p_partkey as string) || '</link><pubDate>Tue, 01 Sep 2026</pubDate><description><![CDATA[<p>Apply &amp; win</p>]]></description></item><item><title>Take our ' || p_type || ' quiz</title><link>https://f.example.com/q</link></item><item><link>https://no.title/</link></item></channel></rss>'
  else '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">The challenge of ' || p_type || '</title><link rel="self" href="https://self.example.com/"/><link rel="alternate" href="https://a.example.com/' || cast(p_partkey as string) || '"/><updated>2026-09-01</updated><summary>apply now &lt;b&gt;soon&lt;/b&gt;</summary></entry></feed>' end as body
from part
"""

VIEWS["listing_docs"] = """
select c_custkey as doc_id, 'https://list.example.com/hackathons' as url, 'reach:web:list' as source, '# All' || chr(10) || '[1. ' || c_mktsegment || ' Hackathon ' || cast(c_custkey as string) || '](/hackathons/' || cast(c_custkey as string) || '/) [Home](/)' || chr(10)
  || '[Again the same hackathon](https://list.example.com/hackathons/' || cast(c_custkey as string) || ') [Login](/login/now) [Other site challenge](https://other.example.com/a/b) [Short jam](/jam) [Spring coding challenge](deep/challenge?x=1)' as body
from customer
"""

VIEWS["block_docs"] = """
select c_custkey as doc_id, case c_custkey % 3 when 0 then 'csMajors' else 'hackathons' end as channel, 'URL: https://lone.example.com/' || cast(c_custkey as string) || chr(10) || chr(10) || 'Title: Post ' || c_name || chr(10) || 'Body: first line' || chr(10) || 'more of ' || c_mktsegment || chr(10) || chr(10) || chr(10)
  || '  Title: Second' || chr(10) || 'Link: https://b.example.com/' || cast(c_nationkey as string) || chr(10) || 'free text' || chr(10) || chr(10) || 'Tweet: Big hackathon number ' || cast(c_custkey as string) || ' starts' || chr(10) || 'User: @u' || cast(c_nationkey as string) || chr(10) || 'URL: https://t.example.com/' as body
from customer
"""

VIEWS["post_answers"] = """
select s_suppkey as doc_id, case when s_suppkey % 2 = 0 then '{"data":[{"title":"Flat ' || s_name || '","selftext":"x","url":"https://e.example.com/","permalink":"/r/a/1","score":3}]}'
  else '{"data":{"children":[{"data":{"title":"Deep ' || s_name || '","permalink":"/r/b/2"}},{"data":{"title":"Two"}}]}}' end as body from supplier
"""

VIEWS["landed_cards"] = """
select c_custkey as card_id, case c_custkey % 7 when 0 then 'devfolio' when 1 then 'unstop' when 2 then 'hackerearth' when 3 then 'internshala' when 4 then 'mlh' when 5 then 'unstop-competitions' else 'linkedin' end as site,
  case c_nationkey % 7 when 0 then 'ab' when 1 then 'abc' when 2 then 'Events' when 3 then 'Code Hack Day' else c_name || case when c_custkey % 4 = 1 then ' Intern' else '' end end as name,
  case c_nationkey % 3 when 0 then '' when 1 then '/x/' || cast(c_custkey as string) else 'https://abs.example.com/' || cast(c_custkey as string) || case when c_nationkey % 2 = 0 then '?ref=card' else '' end end as link,
  case c_nationkey % 5 when 0 then '' else 'Host ' || c_mktsegment end as organizer, case c_nationkey % 4 when 0 then '' when 1 then 'Work from home' else 'Pune' end as location,
  case c_nationkey % 2 when 0 then '' else '$' || cast(c_nationkey as string) end as prize
from customer
"""

VIEWS["sections_docs"] = """
select p_partkey as doc_id, '# Hackathons & Competitions' || chr(10) || '| Event | Location | Event Dates |' || chr(10) || '|---|---|---|' || chr(10) || '| [' || p_name || '](https://s.example.com/' || cast(p_partkey as string) || ') | Pune | Oct 2026 |' || chr(10) || '## 2.2 Competitions' || chr(10)
  || '| ID | Name | Status 2025 |' || chr(10) || '|---|---|---|' || chr(10) || '| 1 | **' || p_type || ' Cup** | running |' || chr(10) || '## Student Fellowship Programs' || chr(10) || '- [' || p_brand || ' Fellows](https://fel.example.com/) - paid' || chr(10) || '# End' || chr(10) || '- [Not this one](https://x.example.com/) - no' || chr(10) as body
from part
"""


# landed documents made of short rows: their table is spread before the texts are made and parsed
SPREAD = {"markdown_docs", "contest_docs", "hack_docs", "job_docs", "html_docs", "feed_docs", "listing_docs", "block_docs", "post_answers", "sections_docs"}


def closure(body: str) -> list[str]:
    """Fixture views that a SQL text needs, in definition order."""
    need = {v for v in VIEWS if re.search(rf"\b{v}\b", body)}
    for v in reversed(VIEWS):
        if v in need:
            need |= {u for u in VIEWS if u != v and re.search(rf"(from|join) {u}\b", VIEWS[v])}
    return [v for v in VIEWS if v in need]


def with_views(body: str) -> str:
    """Prefix a DuckDB query with the fixture views it uses."""
    body = body.strip()
    names = closure(body)
    ctes = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in names)
    m = re.match(r"(?is)with\s+(recursive\s+)?", body)
    head = "with recursive " if m and m.group(1) else "with "
    if not names:
        return body
    return head + ctes + (",\n" + body[m.end():] if m else "\n" + body)


class Inputs:
    """The given tables and the fixture views of one data folder."""

    _opened: dict[tuple[str, str, str], DataFrame] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES and name not in VIEWS:
            raise AttributeError(name)
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in self._opened:
            if name in TABLES:
                self._opened[key] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                for used in re.findall(r"(?:from|join) (\w+)", VIEWS[name]):
                    if used in TABLES or used in VIEWS:
                        source = getattr(self, used)
                        (spread(source) if name in SPREAD else source).createOrReplaceTempView(used)
                self._opened[key] = self.spark.sql(VIEWS[name])
        return self._opened[key]
