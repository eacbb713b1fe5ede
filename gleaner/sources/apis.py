"""Records from landed JSON answers: contests, hackathons, jobs, programs, posts.

Input rows have a text column ``body`` with one answer each.  The list inside
an answer is filtered, ordered and cut inside its row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocab as V
from ..functions.text import contains_any, first_nonblank, head, strip, text
from ..schema import conform


def _tags(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _rows(raw: DataFrame, keys: list[str], items: Column) -> DataFrame:
    return raw.select(*keys, F.posexplode(items).alias("pos", "x"))


def _utc(epoch: Column, fmt: str, default: str) -> Column:
    known = F.coalesce(epoch, F.lit(0)) != 0
    return F.when(known, F.date_format(F.timestamp_seconds(epoch), fmt)).otherwise(default)


def _contest(rows: DataFrame, keys: list[str], **cols: Column) -> DataFrame:
    fixed = {"eligibility": F.lit("Open to all"), "mode": F.lit("Online"), "fee": F.lit("Free"), "status": F.lit("open"), "category": F.lit("competitions")}
    return _shape(rows, keys, {**fixed, **cols})


def _shape(rows: DataFrame, keys: list[str], cols: dict[str, Column]) -> DataFrame:
    named = rows.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("pos").alias("_pos"), *[c.alias(n) for n, c in cols.items()])
    wide = conform(named)
    names = wide.columns
    return named.select(*[F.col(f"_{k}").alias(k) for k in keys], F.col("_pos").alias("pos"),
                        *[(F.col(n) if n in cols else F.lit(None)).cast(wide.schema[n].dataType).alias(n) for n in names if n != "seq" and n not in keys])


_MINUTE = "yyyy-MM-dd HH:mm 'UTC'"


def epoch_contests(raw: DataFrame, *keys: str, limit: int | None = None) -> DataFrame:
    """Contests that have not started, all or the first ``limit`` in answer order."""
    schema = "status string, result array<struct<id:bigint,name:string,type:string,phase:string,startTimeSeconds:bigint,durationSeconds:bigint>>"
    doc = F.from_json("body", schema)
    items = head(F.filter(F.when(doc["status"] == "OK", doc["result"]), lambda c: c["phase"] == "BEFORE"), limit)
    rows, x = _rows(raw, list(keys), items), (lambda f: F.col(f"x.{f}"))
    secs = x("durationSeconds")
    took = F.when(F.coalesce(secs, F.lit(0)) != 0, F.concat(F.floor(secs / 3600).cast("string"), F.lit("h "), F.floor(secs % 3600 / 60).cast("string"), F.lit("m"))).otherwise("")
    kind = F.initcap(F.lower(F.replace(text(x("type")), F.lit("_"), F.lit(" "))))
    link = F.concat(F.lit("https://codeforces.com/contest/"), text(x("id").cast("string")))
    return _contest(rows, list(keys), name=F.coalesce(x("name"), F.lit("Codeforces Contest")), organizer=F.lit("Codeforces"),
                    description=F.concat(F.lit("Codeforces "), kind, F.lit(" contest. Duration: "), took), prize=F.lit("Rating change + prizes for top performers"),
                    deadline=_utc(x("startTimeSeconds"), "yyyy-MM-dd", "Check page"), event_date=_utc(x("startTimeSeconds"), _MINUTE, ""),
                    application_link=link, website=link, tags=_tags("codeforces", "competitive-programming", "contest"), source=F.lit("codeforces-api"))


def _next(items: Column, start: str, now: int, n: int | None) -> Column:
    """The next items by start time, all or n; the sort is stable in answer order."""
    ahead = F.filter(items, lambda c: c[start] > now)
    keyed = F.transform(ahead, lambda c, i: F.struct(c[start].alias("t"), i.alias("i"), c.alias("c")))
    return F.transform(head(F.array_sort(keyed), n), lambda k: k["c"])


def query_contests(raw: DataFrame, now: int, *keys: str, limit: int | None = None) -> DataFrame:
    """The contests to come of an answer with title slugs, by start; all or the next ``limit``."""
    doc = F.from_json("body", "data struct<allContests:array<struct<title:string,titleSlug:string,startTime:bigint,duration:bigint>>>")
    rows, x = _rows(raw, list(keys), _next(doc["data"]["allContests"], "startTime", now, limit)), (lambda f: F.col(f"x.{f}"))
    took = F.when(F.coalesce(x("duration"), F.lit(0)) != 0, F.concat(F.floor(x("duration") / 60).cast("string"), F.lit(" minutes"))).otherwise("")
    slug = text(x("titleSlug"))
    link = F.concat(F.lit("https://leetcode.com/contest/"), F.when(slug != "", F.concat(slug, F.lit("/"))).otherwise(""))
    return _contest(rows, list(keys), name=F.coalesce(x("title"), F.lit("LeetCode Contest")), organizer=F.lit("LeetCode"),
                    description=F.concat(F.lit("LeetCode competitive programming contest. Duration: "), took), eligibility=F.lit("Open to all — free LeetCode account"),
                    prize=F.lit("Rating change + badges"), deadline=_utc(x("startTime"), "yyyy-MM-dd", "Check page"), event_date=_utc(x("startTime"), _MINUTE, ""),
                    application_link=link, website=link, tags=_tags("leetcode", "competitive-programming", "contest"), source=F.lit("leetcode-api"))


def _bare(rows: DataFrame, keys: list[str], **cols: Column) -> DataFrame:
    return _shape(rows, keys, {"category": F.lit("competitions"), "location": F.lit("Online"), **cols})


def list_contests(raw: DataFrame, *keys: str) -> DataFrame:
    """Future, then present contests; the end date is the deadline."""
    one = "array<struct<contest_name:string,contest_code:string,contest_start_date:string,contest_end_date:string>>"
    doc = F.from_json("body", f"future_contests {one}, present_contests {one}")
    none = F.array().cast(one)
    items = F.concat(F.coalesce(doc["future_contests"], none), F.coalesce(doc["present_contests"], none))
    rows, x = _rows(raw, list(keys), items), (lambda f: F.col(f"x.{f}"))
    return _bare(rows, list(keys), name=F.concat(F.lit("CodeChef: "), text(x("contest_name"))), url=F.concat(F.lit("https://www.codechef.com/"), text(x("contest_code"))),
                 prize=F.lit("Rating Points & Prizes"), deadline=first_nonblank(x("contest_end_date"), x("contest_start_date"), F.lit("Check CodeChef")),
                 tags=_tags("CodeChef", "Competitive Programming", "Kontests"), source=F.lit("CodeChef (Kontests)"))


def archive_contests(raw: DataFrame, now: int, *keys: str, limit: int | None = None) -> DataFrame:
    """The next 10 contests of a plain list."""
    doc = F.from_json("body", "array<struct<id:string,title:string,start_epoch_second:bigint>>")
    rows, x = _rows(raw, list(keys), _next(doc, "start_epoch_second", now, limit)), (lambda f: F.col(f"x.{f}"))
    return _bare(rows, list(keys), name=F.concat(F.lit("AtCoder: "), F.coalesce(x("title"), F.lit("AtCoder Contest"))),
                 url=F.concat(F.lit("https://atcoder.jp/contests/"), text(x("id"))), prize=F.lit("Rating Points"),
                 deadline=_utc(x("start_epoch_second"), _MINUTE, "TBA"), tags=_tags("AtCoder", "Competitive Programming", "Kontests"), source=F.lit("AtCoder (Kontests)"))


def hackathons(raw: DataFrame, *keys: str) -> DataFrame:
    """Hackathon listing: prize without markup, themes, mode and state."""
    doc = F.from_json("body", "hackathons array<struct<title:string,url:string,submission_period_dates:string,prize_amount:string,"
                              "themes:array<struct<name:string>>,displayed_location:struct<location:string>,open_state:string>>")
    items = F.filter(doc["hackathons"], lambda h: strip(text(h["title"])) != "")
    rows, x = _rows(raw, list(keys), items), (lambda f: F.col(f"x.{f}"))
    themes = F.filter(F.transform(F.coalesce(x("themes"), F.array().cast("array<struct<name:string>>")), lambda t: t["name"]), lambda n: text(n) != "")
    place = F.coalesce(x("displayed_location.location"), F.lit("Online"))
    low = F.lower(place)
    mode = F.when(contains_any(low, ["in-person", "onsite"]), "In-Person").when((place != "") & (low != "online"), place).otherwise("Online")
    state = F.coalesce(x("open_state"), F.lit("open"))
    prize = strip(F.regexp_replace(text(x("prize_amount")), "<[^>]+>", ""))
    dates, link = strip(text(x("submission_period_dates"))), first_nonblank(F.trim(x("url")), F.lit("https://devpost.com/hackathons"))
    return _shape(rows, list(keys), {
        "name": strip(x("title")), "organizer": F.lit("Via Devpost"), "category": F.lit("hackathons"),
        "description": F.concat(F.lit("Live Hackathon on Devpost. Themes: "), F.when(F.size(themes) > 0, F.array_join(themes, ", ")).otherwise("General"), F.lit(".")),
        "eligibility": F.lit("Open to all developers & students (check listing)"), "mode": mode, "fee": F.lit("Free"),
        "prize": first_nonblank(prize, F.lit("Check listing page")), "deadline": first_nonblank(dates, F.lit("Check event page")), "event_date": dates,
        "application_link": link, "website": link, "tags": F.concat(_tags("devpost", "hackathon"), F.transform(themes, F.lower)),
        "status": F.when(state == "open", "open").when(state == "upcoming", "coming-soon").otherwise("closed"), "source": F.lit("devpost-live-api")})


def jobs(raw: DataFrame, *keys: str) -> DataFrame:
    """Job feed: technical titles; internships by the word in the title."""
    doc = F.from_json("body", "jobs array<struct<title:string,companyName:string,applicationLink:string,url:string,minSalary:string,maxSalary:string,location:string>>")
    items = F.filter(doc["jobs"], lambda j: contains_any(F.lower(text(j["title"])), V.JOB_TITLE_TERMS))
    rows, x = _rows(raw, list(keys), items), (lambda f: F.col(f"x.{f}"))
    paid = ~text(x("minSalary")).isin("", "0")
    return _shape(rows, list(keys), {
        "name": F.concat(F.coalesce(x("companyName"), F.lit("Tech Company")), F.lit(": "), text(x("title"))),
        "url": F.coalesce(x("applicationLink"), x("url"), F.lit("https://himalayas.app")), "source": F.lit("Himalayas Tech (JobSpy)"),
        "category": F.when(F.lower(text(x("title"))).contains("intern"), "internships").otherwise("jobs"),
        "prize": F.when(paid, F.concat(F.lit("$"), x("minSalary"), F.lit(" - $"), text(x("maxSalary")), F.lit(" / yr"))).otherwise("Competitive Remote Pay"),
        "location": F.coalesce(x("location"), F.lit("Remote")), "deadline": F.lit("Rolling / Open"), "tags": _tags("Remote", "SWE", "JobSpy", "Verified")})


def programs(raw: DataFrame, *keys: str) -> DataFrame:
    """A single program object."""
    site = F.lit("https://summerofcode.withgoogle.com")
    rows = raw.select(*keys, F.lit(0).alias("pos"), F.from_json("body", "name string").alias("x"))
    return _shape(rows, list(keys), {
        "name": F.coalesce("x.name", F.lit("Google Summer of Code")), "organizer": F.lit("Google"), "category": F.lit("open-source-programs"),
        "description": F.lit("Google Summer of Code — contribute to open source projects with mentorship and a stipend."),
        "eligibility": F.lit("Open to anyone 18+ (students and non-students)"), "mode": F.lit("Online / Remote"), "fee": F.lit("Free"),
        "stipend": F.lit("Varies by country ($1500-$6600)"), "deadline": F.lit("Check timeline at summerofcode.withgoogle.com"),
        "application_link": site, "website": site, "tags": _tags("gsoc", "google", "open-source", "stipend"), "status": F.lit("open"), "source": F.lit("gsoc-api")})


def posts(raw: DataFrame, *keys: str) -> DataFrame:
    """Posts of a search answer, flat or nested one level."""
    fields = "title:string,selftext:string,url:string,permalink:string,score:bigint"
    flat = F.from_json("body", f"data array<struct<{fields}>>")["data"]
    nested = F.from_json("body", f"data struct<children:array<struct<data:struct<{fields}>>>>")["data"]["children"]
    is_flat = F.get_json_object("body", "$.data").startswith("[")
    items = F.when(is_flat, flat).otherwise(F.transform(nested, lambda c: c["data"]))
    rows = raw.select(*keys, F.posexplode(items).alias("pos", "x"))
    return rows.select(*keys, "pos", text("x.title").alias("title"), text("x.selftext").alias("body"), text("x.url").alias("url"),
                       F.concat(F.lit("https://reddit.com"), text("x.permalink")).alias("permalink"), F.coalesce("x.score", F.lit(0)).alias("score"))
