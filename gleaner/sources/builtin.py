"""The built-in sources over landed captures.

Captures are rows (capture_id, source, url, body): ``source`` is a name of
:data:`registry.ORDER`, ``body`` the landed answer.  Sites whose pages were read
card by card land a JSON list of cards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import apis, cards, social
from .registry import register_source, route
from .seed import seed_records

# Name, address, parser, category, limit, filter, enabled.
CATALOGUE = [
    ("SimplifyJobs-Internships", "https://raw.githubusercontent.com/SimplifyJobs/Summer2025-Internships/dev/README.md", "html_table", "internships", None, None, True),
    ("SimplifyJobs-NewGrad", "https://raw.githubusercontent.com/SimplifyJobs/New-Grad-Positions/dev/README.md", "html_table", "jobs", None, None, True),
    ("Deepanshu-OSPrograms", "https://raw.githubusercontent.com/deepanshu1422/List-Of-Open-Source-Internships-Programs/master/README.md", "markdown_table", "open-source-programs", None, None, True),
    ("Ayush-EveryOSS", "https://raw.githubusercontent.com/ayush-sleeping/Every-Open-Source-Programs/main/README.md", "markdown_table", "open-source-programs", None, None, True),
    ("OpenSauced-OSS", "https://raw.githubusercontent.com/open-sauced/awesome-oss-programs/main/README.md", "markdown_list", "open-source-programs", None, None, True),
    ("Dipakkr-StudentResources", "https://raw.githubusercontent.com/dipakkr/A-to-Z-Resources-for-Students/master/README.md", "sections", "multi", None, None, True),
]
FEEDS = [
    ("reach:news:google-developers", "https://blog.google/technology/developers/rss/", "feed", "hackathons", 30, "keywords", True),
    ("reach:news:google-devblog", "https://developers.googleblog.com/feeds/posts/default", "feed", "hackathons", 30, "keywords", True),
    ("reach:news:github-blog", "https://github.blog/feed/", "feed", "open-source-programs", 20, "keywords", True),
    ("reach:web:unstop", "https://unstop.com/hackathons", "listing", "hackathons", None, None, False),
    ("reach:web:devfolio", "https://devfolio.co/hackathons", "listing", "hackathons", None, None, False),
]
_CARD = "array<struct<name:string,link:string,organizer:string,description:string,prize:string,stipend:string,duration:string,deadline:string,location:string>>"
CARD_SITES = ["devfolio", "unstop-hackathons", "unstop-competitions", "mlh", "hackerearth", "internshala"]


def catalogue(spark: SparkSession, entries: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(CATALOGUE + FEEDS if entries is None else entries,
                                 "name string, url string, parser string, category string, limit int, filter string, enabled boolean")


def card_records(captures: DataFrame, site: str) -> DataFrame:
    """Records of landed cards of one site."""
    landed = (captures.select("capture_id", F.posexplode(F.from_json("body", _CARD)).alias("pos", "c"))
              .select("capture_id", "pos", F.lit(site).alias("site"), "c.*"))
    return cards.apply_source_defaults(landed, cards.defaults_table(captures.sparkSession))


def _posts(captures: DataFrame) -> DataFrame:
    channel = F.coalesce("channel", F.lit("")) if "channel" in captures.columns else F.lit("")
    found = apis.posts(captures.withColumn("channel", channel), "capture_id", "channel")
    return social.post_records(social.relevant_posts(found), "capture_id", "pos")


def builtin(now: int) -> dict[str, tuple[str | None, Callable[[DataFrame], DataFrame]]]:
    """Name -> (fixed category, captures to records); ``now`` in seconds decides which contests lie ahead."""
    def own(name: str, fn: Callable[[DataFrame], DataFrame], category: str | None = None):
        return category, lambda captures: fn(captures.where(F.col("source") == name))

    def contests(c: DataFrame) -> DataFrame:
        both = apis.list_contests(c, "capture_id"), apis.archive_contests(c, now, "capture_id")
        return both[0].unionByName(both[1], allowMissingColumns=True)

    sources = {
        "github": own("github", lambda c: route(c, catalogue(c.sparkSession, CATALOGUE))),
        "codeforces": own("codeforces", lambda c: apis.epoch_contests(c, "capture_id"), "competitions"),
        "leetcode": own("leetcode", lambda c: apis.query_contests(c, now, "capture_id"), "competitions"),
        "gsoc": own("gsoc", lambda c: apis.programs(c, "capture_id"), "open-source-programs"),
        "company": ("hackathons", lambda captures: seed_records(captures.sparkSession)),
        "jobspy": own("jobspy", lambda c: apis.jobs(c, "capture_id")),
        "kontests": own("kontests", contests, "competitions"),
        "reach": own("reach", lambda c: route(c, catalogue(c.sparkSession, FEEDS))),
        "devpost": own("devpost", lambda c: apis.hackathons(c, "capture_id"), "hackathons"),
        "social": own("social", _posts)}
    for name in CARD_SITES:
        site = "unstop" if name == "unstop-hackathons" else name
        sources[name] = own(name, lambda c, site=site: card_records(c, site), cards.SITES[site]["category"])
    return sources


def register_builtin(now: int) -> None:
    """Register all built-in sources."""
    for name, (category, fn) in builtin(now).items():
        register_source(name, fn, category)
