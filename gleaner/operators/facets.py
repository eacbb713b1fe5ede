"""Faceted search, ordering, paging, matching and feature tables.

Filters are predicates, so any combination is one scan; an ordered page is a
top-n and never a full sort.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vocab as V
from ..functions.text import contains_any, first_nonblank, found_terms, text
from .ranking import numbered


def _hay(*cols: str) -> Column:
    return F.lower(F.concat_ws(" ", *[text(c) for c in cols]))


def _tags() -> Column:
    return F.lower(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))


def _with_tags(*cols: str) -> Column:
    return F.concat_ws(" ", _hay(*cols), _tags())


def matches_search(q: str) -> Column:
    return _with_tags("name", "organizer", "description", "location").contains(q.lower().strip())


def matches_status(status: str) -> Column:
    return F.lit(True) if status == "all" else text("status") == status


def matches_domain(domain: str) -> Column:
    return F.lit(True) if domain == "all" else contains_any(_with_tags("name", "description"), V.DOMAINS.get(domain, []))


def matches_location(target: str) -> Column:
    """Structured fields decide; records without them fall back to words."""
    mode, country = text("location_mode"), F.upper(text("country"))
    structured = {"remote": mode == "remote", "india": country == "IN", "usa": country == "US", "canada": country == "CA",
                  "europe": country.isin(V.EUROPE), "international": (country != "") & (country != "IN")}
    hints = V.LOCATION_HINTS.get(target)
    legacy = contains_any(_hay("location", "mode", "location_label"), hints) if hints else F.lit(True)
    return F.when((mode != "") | (country != ""), structured.get(target, F.lit(True))).otherwise(legacy)


def matches_level(level: str) -> Column:
    """A level without a rule (off-season) keeps all rows."""
    terms = V.LEVELS.get(level)
    return contains_any(_with_tags("name", "eligibility", "description"), terms) if terms else F.lit(True)


def matches_compensation(value: str) -> Column:
    hay = _hay("stipend", "prize", "fee")
    if value == "paid":
        return contains_any(hay, V.PAID_MARKS)
    return ~(hay.contains("fee") & ~hay.contains("free")) if value == "free" else F.lit(True)


def matches_work_mode(target: str) -> Column:
    modes = {"online": ["remote", "remote_geo"], "in-person": ["onsite"], "hybrid": ["hybrid"]}
    if target not in modes:
        return F.lit(True)
    mode = text("location_mode")
    return F.when(mode != "", mode.isin(modes[target])).otherwise(contains_any(_hay("location", "mode", "location_label"), V.MODE_HINTS[target]))


def matches_chips(chips: list[str]) -> Column:
    hay = _with_tags("name", "description", "location", "stipend", "prize")
    tests = [text("status") == "open" if c == "open" else contains_any(hay, V.CHIPS[c]) for c in chips]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


@dataclass
class FacetSpec:
    """One faceted query; the defaults keep everything."""
    category: str = "all"
    search: str = ""
    status: str = "all"
    domain: str = "all"
    location: str = "all"
    level: str = "all"
    compensation: str = "all"
    mode: str = "all"
    chips: list[str] = field(default_factory=list)
    sort: str = "default"
    pages: int = 1


def facet_filter(df: DataFrame, spec: FacetSpec) -> DataFrame:
    tests = [matches_status(spec.status), matches_domain(spec.domain), matches_level(spec.level),
             matches_compensation(spec.compensation), matches_chips(spec.chips)]
    if spec.category != "all":
        tests.append(F.col("category") == spec.category)
    if spec.search.strip():
        tests.append(matches_search(spec.search))
    if spec.location != "all":
        tests.append(matches_location(spec.location))
    if spec.mode != "all":
        tests.append(matches_work_mode(spec.mode))
    return df.where(reduce(lambda a, b: a & b, tests))


def sort_keys(df: DataFrame, how: str) -> list[Column]:
    """Order of the result list; arrival order breaks ties."""
    scored = "score" in df.columns
    name = F.collate(text("name"), "UNICODE")
    keys = {"ai-match": [F.desc("score")] if scored else [], "company-asc": [name.asc()], "company-desc": [name.desc()],
            "deadline": [F.collate(first_nonblank("deadline", F.lit("9999")), "UNICODE").asc()]}
    fallback = [F.desc("score")] if scored else [(text("status") != "open").asc()]
    return keys.get(how, fallback) + [F.col("seq").asc()]


def order_by(df: DataFrame, how: str = "default") -> DataFrame:
    return df.orderBy(*sort_keys(df, how))


def page(df: DataFrame, how: str = "default", pages: int = 1) -> DataFrame:
    """The first pages in order, with position and the total number of rows."""
    keys = sort_keys(df, how)
    total = df.agg(F.count("*").alias("n")).scalar()
    top = df.orderBy(*keys).limit(V.PAGE_SIZE * pages)
    return (top.withColumn("position", F.row_number().over(Window.orderBy(*keys)))   # at most a few pages of rows
            .withColumn("total", total))


def faceted_query(df: DataFrame, spec: FacetSpec) -> DataFrame:
    return page(facet_filter(df, spec), spec.sort, spec.pages)


# ---- resume matching -----------------------------------------------------

def resume_keywords(resume: str) -> list[str]:
    """Distinct words of over two letters; the word class is ASCII."""
    words = re.split(r"\s+", re.sub(r"[^A-Za-z0-9_\s+#.-]", " ", resume.lower()))
    return sorted({w for w in words if len(w) > 2 and w not in V.RESUME_STOP})


def match_score(df: DataFrame, resume: str) -> DataFrame:
    """Add ``score``, 50 to 99, from the resume words found in a record."""
    kws = resume_keywords(resume)
    if not kws:
        return df.withColumn("score", F.lit(50).cast("bigint"))
    hay = _with_tags("name", "description", "location")
    hay = F.concat_ws(" ", hay, _hay("eligibility", "organizer"))
    df = df.withColumn("_hits", found_terms(hay, kws))
    tech = F.size(F.filter("_hits", lambda k: k.isin(V.RESUME_TECH))) * 1.5
    hits = F.size("_hits")
    raw = F.floor(hits / min(len(kws), 15) * 65 + tech * 5 + 45 + 0.5)
    return df.withColumn("score", F.when(hits > 0, F.least(F.lit(99), F.greatest(F.lit(50), raw))).otherwise(50).cast("bigint")).drop("_hits")


# ---- selection -----------------------------------------------------------

def item_key() -> Column:
    return first_nonblank("id", "name")


def selected_items(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Records whose id, or else name, is in ``chosen.key``."""
    return df.withColumn("_key", item_key()).join(chosen.select(F.col("key").alias("_key")), "_key", "left_semi").drop("_key")


def _category_rank() -> Column:
    return reduce(lambda acc, kv: F.when(F.col("category") == kv[1], kv[0]).otherwise(acc), enumerate(V.CATEGORIES), F.lit(len(V.CATEGORIES)))


def application_packet(selected: DataFrame) -> DataFrame:
    """The numbered list of an application packet, one row per record."""
    rows = numbered(selected, "number", _category_rank(), "seq")
    title = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), text("name"), F.lit(" ("), first_nonblank("organizer", F.lit("Company")), F.lit(")"))
    return rows.select("seq", "number", title.alias("title"), first_nonblank("application_link", "website", F.lit("N/A")).alias("target"),
                       first_nonblank("deadline", F.lit("Check listing")).alias("due"))


def packet_profile(profile: dict[str, str]) -> list[tuple[str, str]]:
    """The head of the packet with defaults for missing fields."""
    fields = {"name": "Applicant", "email": "N/A", "phone": "N/A", "linkedIn": "N/A", "github": "N/A", "portfolio": "N/A", "resume": "N/A",
              "college": "N/A", "branch": "Tech", "gradYear": "N/A", "skills": "Python, React, Machine Learning, Cloud"}
    return [(k, profile.get(k) or d) for k, d in fields.items()]


# ---- feature tables ------------------------------------------------------

def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("status").isin("open", "coming-soon"))


# category: four cells, each a list of fields and a default (fixed values)
_CELLS = {
    "hackathons": [(["organizer"], ""), (["mode"], ""), (["prize", "fee"], "Free"), (["deadline"], "Check page")],
    "internships": [(["location", "mode"], "Check listing"), (["eligibility"], ""), (["stipend"], "Competitive / Check listing"), (["deadline"], "Apply ASAP")],
    "jobs": [(["location", "mode"], "Check listing"), (["eligibility"], ""), (["stipend"], "Competitive / Check listing"), (["deadline"], "Apply ASAP")],
    "competitions": [(["organizer"], ""), (["mode"], ""), (["prize"], "Rating + Prizes"), (["event_date", "deadline"], "Weekly")],
    "open-source-programs": [(["organizer"], ""), (["stipend"], "Stipend Provided"), (["duration"], "10-12 weeks"), (["deadline"], "Annual")],
    "fellowships": [(["organizer"], ""), (["eligibility"], "Students / Graduates"), (["stipend"], "Stipend + Mentorship"), (["deadline"], "Check Portal")],
}


def cell(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("-"))


def feature_tables(df: DataFrame) -> DataFrame:
    """First active records of every category with the cells of its table."""
    w = Window.partitionBy("category").orderBy("seq")
    top = active(df).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(V.FEATURE_LIMITS.values()))
    size = reduce(lambda acc, kv: F.when(F.col("category") == kv[0], kv[1]).otherwise(acc), V.FEATURE_LIMITS.items(), F.lit(0))
    cells = [reduce(lambda acc, kv: F.when(F.col("category") == kv[0], first_nonblank(*kv[1][i][0], F.lit(kv[1][i][1]))).otherwise(acc),
                    _CELLS.items(), F.lit("")) for i in range(4)]
    mark = F.when(F.col("status") == "coming-soon", "🟡 Soon").otherwise("🟢 Open")
    return top.where(F.col("rank") <= size).select(
        "category", "rank", cell(text("name")).alias("name"), *[cell(c).alias(f"cell{i + 1}") for i, c in enumerate(cells)],
        mark.alias("status"), first_nonblank("application_link", "website", F.lit("#")).alias("link"))


def cash_prizes(df: DataFrame) -> DataFrame:
    return active(df).where(F.col("category").isin("hackathons", "competitions") & F.trim(text("prize")).rlike(V.CASH_PATTERN))


def stipends(df: DataFrame) -> DataFrame:
    return active(df).where(F.col("category").isin("open-source-programs", "fellowships") & F.trim(text("stipend")).rlike(V.STIPEND_PATTERN))


def job_tracks(df: DataFrame) -> DataFrame:
    """Active internships at listed employers; all active ones when none is."""
    open_ones = active(df).where(F.col("category") == "internships")
    named = contains_any(F.lower(text("name")), V.FEATURED_EMPLOYERS)
    n = open_ones.agg(F.count_if(named).alias("n")).scalar()
    return open_ones.where(named | (n == 0))


def reward_tables(df: DataFrame, n: int = 10) -> DataFrame:
    """The first ten cash prizes, stipends and job tracks."""
    def first(rows: DataFrame, kind: str, *cells: Column) -> DataFrame:
        top = rows.withColumn("_major", _category_rank()).orderBy("_major", "seq").limit(n)
        w = Window.orderBy("_major", "seq")   # ten rows
        return top.select(F.lit(kind).alias("kind"), F.row_number().over(w).alias("rank"), cell(text("name")).alias("name"),
                          *[cell(c).alias(f"cell{i + 1}") for i, c in enumerate(cells)], first_nonblank("application_link", "website", F.lit("#")).alias("link"))

    label = F.when(F.array_contains("tags", "hackathon"), "🏆 Hackathon").otherwise("⚔️ Contest")
    pick = lambda d, *c: first_nonblank(*c, F.lit(d))
    return (first(cash_prizes(df), "cash", label, pick("Cash Prize", "prize"), pick("Online", "mode"), pick("Check page", "deadline"))
            .unionByName(first(stipends(df), "stipend", pick("Open Source", "organizer"), pick("Stipend Provided", "stipend"), pick("10-12 weeks", "duration"), pick("Students & Developers", "eligibility")))
            .unionByName(first(job_tracks(df), "job", pick("Various", "location", "mode"), pick("Students / New Grads", "eligibility"), pick("Competitive", "stipend"), F.lit(""))))
