"""Layer 1: weighted plausibility of a record, with vetoes.

Pages are captures that have landed, so all records are probed and page texts
are searched whole; a cap per category is an argument.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vocab as V
from ..functions.dates import RANGE, as_date, lenient_date, latest_year, range_end
from ..functions.text import WORD, contains_any, first_nonblank, let, lits, normalize_title, strip, text
from ..functions.urls import canonical_url
from .joins import lookup
from .titles import title_matches

_LINK = ("application_link", "url", "website")


def _field(df: DataFrame, name: str) -> Column:
    return text(name) if name in df.columns else F.lit("")


def schema_score(df: DataFrame) -> Column:
    """Required name, preferred link/deadline/source, bonus fields."""
    score = F.when(F.length(strip(_field(df, "name"))) >= 3, F.lit(0.4)).otherwise(F.lit(0.0))
    for n in ("application_link", "deadline", "source"):
        score = score + F.when(F.length(strip(_field(df, n))) >= 3, F.lit(0.15)).otherwise(F.lit(0.0))
    for n in ("prize", "organizer", "description"):
        score = score + F.when(F.length(strip(_field(df, n))) >= 2, F.lit(0.025)).otherwise(F.lit(0.0))
    if "tags" in df.columns:
        score = score + F.when(F.size("tags") > 0, F.lit(0.025)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), score)


def _probe_url(df: DataFrame) -> Column:
    return first_nonblank(*[_field(df, n) for n in _LINK])


def probe_cap(df: DataFrame, n: int | None = V.PROBE_CAP) -> DataFrame:
    """Add ``probe_rank``: 1..n for the first n rows with a URL per category, else null; without n, 1 for all with a URL.

    The first rows are taken per salt before they meet, so a large category is many tasks.
    """
    has_url = _probe_url(df).startswith("http")
    if n is None:
        return df.withColumn("probe_rank", F.when(has_url, 1))
    first = df.where(has_url).select("category", "seq", F.pmod(F.xxhash64("seq"), F.lit(64)).alias("salt"))
    for part in (["category", "salt"], ["category"]):
        first = first.withColumn("probe_rank", F.row_number().over(Window.partitionBy(*part).orderBy("seq"))).where(F.col("probe_rank") <= n)
    return df.join(F.broadcast(first.select("seq", "probe_rank")), "seq", "left")  # at most n rows per category


def probe_pages(df: DataFrame, captures: DataFrame) -> DataFrame:
    """Add p_status, p_again, p_n and p_body of the landed page to the probed rows.

    Of several captures of an address the first by tier and capture_id gives
    status and body, the last one the second answer.
    """
    order = F.struct(*[c for c in ("tier", "capture_id") if c in captures.columns], "url", "status", F.xxhash64("body").alias("b"))
    pages = captures.select(canonical_url("url").alias("_key"), order.alias("o"), "status", "body").groupBy("_key").agg(
        F.min_by(F.struct("status", "body"), "o").alias("first"), F.max_by(F.struct("status"), "o").alias("last"), F.count("*").alias("p_n"))
    pages = pages.select("_key", F.col("first.status").alias("p_status"), F.col("last.status").alias("p_again"), "p_n", F.col("first.body").alias("p_body"))
    asked = df.withColumn("_key", F.when(F.col("probe_rank").isNotNull(), canonical_url(_probe_url(df))))
    return lookup(asked, pages, ["_key"]).drop("_key")


def url_score(df: DataFrame) -> tuple[Column, Column]:
    st, again = F.col("p_status"), F.when(F.col("p_n") > 1, F.col("p_again"))
    code = st.cast("string")
    score = (F.when(~_probe_url(df).startswith("http"), 0.3).when(F.col("probe_rank").isNull(), 0.7)
             .when(st < 400, 1.0).when(st.isin(401, 403), 0.7)
             .when(st == 405, F.when(again < 400, 1.0).when(again >= 400, 0.2).otherwise(0.4)).otherwise(0.2))
    reason = (F.when(~_probe_url(df).startswith("http"), "no valid URL").when(F.col("probe_rank").isNull() | (st < 400) | st.isin(401, 403), None)
              .when((st == 405) & again.isNull(), "URL reachable but returned error").when((st == 405) & (again < 400), None)
              .when(st.isNull(), "URL unreachable").otherwise(F.concat(F.lit("URL returned HTTP "), code)))
    return score, reason


def date_score(c: Column | str, as_of: str) -> tuple[Column, Column]:
    """Score of the deadline and the reason when it is bad."""
    now = as_date(as_of)

    def judge(s: Column) -> Column:
        due = lenient_date(range_end(s), as_of)
        year = latest_year(s, r"\b(20[0-9]{2})\b")
        days = F.datediff(due, F.lit(now))
        code = (F.when(s == "", "none").when(contains_any(F.lower(s), V.L1_SOFT_DATES), "soft")
                .when(days < 0, "past").when(days > 730, "far").when(days.isNotNull(), "ok")
                .when(year < now.year, "old").otherwise("none"))
        return F.struct(code.alias("code"), F.date_format(due, "yyyy-MM-dd").alias("due"), year.alias("year"))

    j = let(text(c), judge)
    points = {"none": 0.5, "soft": 0.8, "past": 0.0, "far": 0.3, "ok": 1.0, "old": 0.1}
    score = reduce(lambda acc, kv: F.when(j["code"] == kv[0], F.lit(kv[1])).otherwise(acc), points.items(), F.lit(0.5))
    reason = (F.when(j["code"] == "past", F.concat(F.lit("deadline is in the past ("), j["due"], F.lit(")")))
              .when(j["code"] == "far", F.concat(F.lit("deadline is >2 years out ("), j["due"], F.lit(")")))
              .when(j["code"] == "old", F.concat(F.lit("deadline mentions past year ("), j["year"].cast("string"), F.lit(")"))))
    return score, reason


def content_words(name: Column) -> Column:
    found = F.regexp_extract_all(F.lower(name), F.lit(rf"(?<![{WORD}])([a-z]{{4,}})(?![{WORD}])"), F.lit(1))
    return F.array_except(found, lits(V.CONTENT_GENERIC))


def content_score(df: DataFrame, url_points: Column, cap: int | None = None) -> tuple[Column, Column]:
    """Whether the target page mentions a word of the title; rows from the cap on are not read."""
    url, name = first_nonblank(_field(df, "application_link"), _field(df, "url")), _field(df, "name")
    words = content_words(name)
    capped = F.col("probe_rank").isNull() | (F.col("probe_rank") >= cap if cap is not None else F.lit(False))
    read = F.col("p_status") < 400
    hit = let(F.lower(F.col("p_body")), lambda page: F.exists(words, lambda w: F.contains(page, w)))
    code = (F.when(url_points < 0.5, "neutral").when(~url.startswith("http") | (name == ""), "neutral").when(capped, "capped")
            .when(F.size(words) < 2, "thin").when(~F.coalesce(read, F.lit(False)), "neutral").when(hit, "hit").otherwise("miss"))
    score = (F.when(code == "capped", 0.7).when(code == "thin", 0.6).when(code == "hit", 1.0).when(code == "miss", 0.3).otherwise(0.5))
    return score, F.when(code == "miss", "target page doesn't mention key terms from title")


def spam_score(df: DataFrame) -> tuple[Column, Column]:
    name = _field(df, "name")
    hay = F.lower(F.concat_ws(" ", name, _field(df, "description"), _field(df, "prize")))
    soft = reduce(lambda a, b: a + b, [F.when(hay.contains(t), 1).otherwise(0) for t in V.SOFT_SPAM])
    base = F.greatest(F.lit(0.0), 1.0 - soft * 0.15)
    base = F.when((name == F.upper(name)) & (F.length(name) > 10), base - 0.2).otherwise(base)
    base = F.when((name != "") & (F.length(strip(name)) < 5), base - 0.3).otherwise(base)
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base))
    hard = contains_any(hay, V.HARD_SPAM)
    return (F.when(hard, 0.0).otherwise(base),
            F.when(hard, "spam/scam pattern detected").when(base < 0.7, "soft spam signals"))


def _composite(fuzzy: Column) -> Column:
    total = reduce(lambda a, b: a + b, [F.col(f"s_{k}") * w for k, w in V.L1_WEIGHTS.items() if k != "fuzzy"]) + fuzzy * V.L1_WEIGHTS["fuzzy"]
    total = F.when(F.col("s_spam") == 0, F.least(total, F.lit(0.15))).otherwise(total)
    total = F.when(fuzzy == 0, F.least(total, F.lit(0.10))).otherwise(total)
    return F.when(F.col("s_date") == 0, F.least(total, F.lit(0.20))).otherwise(total)


def record_scores(df: DataFrame, captures: DataFrame, as_of: str, cap: int | None = None) -> DataFrame:
    """All scores that need no other record: s_schema, s_url, s_date, s_content, s_spam and reasons r_*.

    Captures have landed already, so every record is looked up unless ``cap`` limits the probes per category.
    """
    wide = probe_pages(probe_cap(df, cap), captures)
    url, url_why = url_score(wide)
    date, date_why = date_score(_field(wide, "deadline"), as_of)
    spam, spam_why = spam_score(wide)
    wide = wide.withColumns({
        "s_schema": schema_score(wide), "r_schema": F.when(F.length(strip(_field(wide, "name"))) < 3, "missing required fields: ['name']"),
        "s_url": url, "r_url": url_why, "s_date": date, "r_date": date_why, "s_spam": spam, "r_spam": spam_why})
    content, content_why = content_score(wide, F.col("s_url"), cap)
    return (wide.withColumns({"s_content": content, "r_content": content_why})
            .drop("p_status", "p_again", "p_n", "p_body", "probe_rank"))


def verify(df: DataFrame, existing: DataFrame | None, captures: DataFrame, as_of: str) -> DataFrame:
    """Add score, outcome (accept, warn, reject) and reasons to every record."""
    from ..session import materialize
    scored = record_scores(df, captures, as_of)
    short = F.length(normalize_title("name")) < 5
    alone = F.when(short, F.lit(0.5)).otherwise(F.lit(1.0))
    scored = materialize(scored.withColumn("eligible", _composite(alone) >= V.L1_REJECT).withColumn("s_alone", alone), "l1-scores")
    copies = title_matches(existing, scored.select("seq", "category", "name", "eligible"))
    out = scored.join(copies.select("seq", F.lit(0.0).alias("s_copy")), "seq", "left")
    out = out.withColumn("s_fuzzy", F.coalesce("s_copy", "s_alone"))
    out = out.withColumn("raw_score", _composite(F.col("s_fuzzy")))
    outcome = F.when(F.col("raw_score") < V.L1_REJECT, "reject").when(F.col("raw_score") < V.L1_WARN, "warn").otherwise("accept")
    reasons = F.array_compact(F.array("r_schema", "r_url", "r_date", "r_content", "r_spam",
                                      F.when(F.col("s_fuzzy") == 0, "fuzzy duplicate of existing item")))
    return (out.withColumn("outcome", outcome).withColumn("score", F.round("raw_score", 3)).withColumn("reasons", reasons)
            .drop("s_copy", "s_alone", "eligible", *[f"r_{k}" for k in ("schema", "url", "date", "content", "spam")]))


def l1_stats(verified: DataFrame) -> DataFrame:
    return verified.groupBy("category").agg(
        F.count("*").alias("total"), F.count_if(F.col("outcome") != "reject").alias("accepted"),
        F.count_if(F.col("outcome") == "warn").alias("warned"), F.count_if(F.col("outcome") == "reject").alias("rejected"))
