"""Defaults for landed card records of listing sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import contains_any, first_nonblank, strip, text
from ..schema import OPPORTUNITY
from ..functions.urls import absolute

# Per site: shortest name, site root, list page, category and default texts (fixed values).
SITES: dict[str, dict[str, str | int]] = {
    "devfolio": {"least": 4, "root": "https://devfolio.co", "home": "", "category": "hackathons", "organizer": "Via Devfolio", "description": "Hackathon listed on Devfolio",
                 "eligibility": "Check hackathon page for details", "mode": "Check hackathon page", "fee": "Check hackathon page", "prize": "Check hackathon page",
                 "deadline": "Check hackathon page", "source": "devfolio-scraper", "tags": "devfolio,hackathon"},
    "unstop": {"least": 3, "root": "https://unstop.com", "home": "https://unstop.com/hackathons", "category": "hackathons", "organizer": "Via Unstop", "description": "Hackathons on Unstop",
               "eligibility": "Check listing page for details", "mode": "Check listing page", "fee": "Check listing page", "prize": "Check listing page",
               "deadline": "Check listing page", "source": "unstop-scraper", "tags": "unstop,hackathons"},
    "unstop-competitions": {"least": 3, "root": "https://unstop.com", "home": "https://unstop.com/competitions", "category": "competitions", "organizer": "Via Unstop",
                            "description": "Competitions on Unstop", "eligibility": "Check listing page for details", "mode": "Check listing page", "fee": "Check listing page",
                            "prize": "Check listing page", "deadline": "Check listing page", "source": "unstop-scraper", "tags": "unstop,competitions"},
    "hackerearth": {"least": 3, "root": "https://www.hackerearth.com", "home": "https://www.hackerearth.com/challenges/", "category": "hackathons", "organizer": "Via HackerEarth",
                    "description": "Challenge on HackerEarth", "eligibility": "Open — check listing page", "mode": "Online", "fee": "Free", "prize": "Check listing page",
                    "deadline": "Check page", "source": "hackerearth-scraper", "tags": "hackerearth"},
    "internshala": {"least": 3, "root": "https://internshala.com", "home": "https://internshala.com/internships/computer-science-internship/", "category": "internships",
                    "organizer": "Via Internshala", "description": "Internship at company via Internshala", "eligibility": "Check listing page for details", "mode": "Check listing",
                    "fee": "Free", "stipend": "Check listing page", "duration": "Check listing page", "deadline": "Apply ASAP — rolling", "source": "internshala-scraper",
                    "tags": "internshala,internship,india"},
    "mlh": {"least": 3, "root": "", "home": "https://mlh.io/events", "category": "hackathons", "organizer": "Major League Hacking (MLH)",
            "description": "Official MLH Member Hackathon. Location: Global.", "eligibility": "Students worldwide (High School & University 18+)", "mode": "Online", "fee": "Free",
            "prize": "Prizes, Swag, Hardware Labs, Mentorship", "deadline": "Check event page", "source": "mlh-live-events", "tags": "mlh,hackathon,student,global"},
    "linkedin": {"least": 1, "root": "", "home": "", "category": "jobs", "organizer": "Tech Company", "prize": "Competitive Stipend / Salary", "location": "Remote",
                 "deadline": "Rolling Applications", "source": "LinkedIn (JobSpy)", "tags": "JobSpy,LinkedIn,SWE,Verified"},
}
MLH_HEADINGS = ["mlh", "major league hacking", "menu", "events"]


def defaults_table(spark: SparkSession) -> DataFrame:
    names = ["site", "least", "root", "home", "category", "organizer", "description", "eligibility", "mode", "fee", "prize", "stipend", "duration", "deadline", "location", "source", "tags"]
    rows = [tuple([site] + [d.get(n) for n in names[1:]]) for site, d in SITES.items()]
    return spark.createDataFrame(rows, "site string, least int, " + ", ".join(f"{n} string" for n in names[2:]))


def apply_source_defaults(landed: DataFrame, defaults: DataFrame) -> DataFrame:
    """Fill what a card does not say from its site's defaults.

    Landed columns: site, name, link and any of organizer, description, prize,
    stipend, duration, deadline, location.  ``defaults`` has one row per site.
    """
    has = lambda c: text(c) if c in landed.columns else F.lit("")
    d = lambda c: text(f"d.{c}")
    rows = landed.alias("l").join(F.broadcast(defaults.alias("d")), F.col("l.site") == F.col("d.site"))   # seven sites
    name = strip(text("l.name"))
    rows = rows.where((F.length(name) >= F.col("d.least")) & ~((F.col("l.site") == "mlh") & F.lower(name).isin(MLH_HEADINGS)))
    link = text("l.link")
    full = F.when((link != "") & ~link.startswith("http") & (d("root") != ""), F.concat(d("root"), link)).when(link.startswith("http"), link).otherwise("")
    full = first_nonblank(full, d("home"))
    fill = lambda c: first_nonblank(has(c) if c not in defaults.columns else text(f"l.{c}") if c in landed.columns else F.lit(""), d(c))
    place = F.lower(text("l.location")) if "location" in landed.columns else F.lit("")
    site, low = F.col("l.site"), F.lower(name)
    linkedin = site == "linkedin"   # its cards say nothing but the page's address
    mode = (F.when((site == "internshala") & contains_any(place, ["work from home", "remote"]), "Remote / Work From Home")
            .when((site == "internshala") & (place != ""), F.col("l.location") if "location" in landed.columns else F.lit("")).otherwise(d("mode")))
    kind = F.when(contains_any(low, ["hackathon", "hack", "buildathon"]), "hackathon").otherwise("competition")
    tags = F.split("d.tags", ",")
    category = F.when((site == "linkedin") & low.contains("intern"), "internships").otherwise(F.col("d.category"))
    keep = [F.col(f"l.{c}") for c in landed.columns if c not in OPPORTUNITY.names + ["site"]]
    return rows.select(
        *keep, site.alias("site"), F.when(site == "linkedin", F.concat(fill("organizer"), F.lit(": "), name)).otherwise(name).alias("name"), category.alias("category"),
        *[fill(c).alias(c) for c in ("organizer", "description", "prize", "stipend", "duration", "deadline")],
        F.when(site == "linkedin", fill("location")).otherwise("").alias("location"), d("eligibility").alias("eligibility"), mode.alias("mode"), d("fee").alias("fee"),
        F.when(~linkedin, full).alias("application_link"), F.when(~linkedin, full).alias("website"), F.when(linkedin, F.substring_index(link, "?", 1)).alias("url"), F.when(site == "hackerearth", F.concat(tags, F.array(kind))).otherwise(tags).alias("tags"),
        F.when(~linkedin, "open").alias("status"), d("source").alias("source"))
