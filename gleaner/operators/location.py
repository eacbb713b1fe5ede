"""Location classification and geographic policy.

Places are recognised by looking the 1-3 word runs of the location text up in
constant hash sets, so a row is classified where it is read: no join and no
shuffle.  Country comes from the location text only; the working mode also
from mode, eligibility, description and name.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocab as V
from ..functions.text import SPACE, WORD, collapse, contains_any, first_nonblank, has_word, let, lits, quoted, strip, text

_MAX_WORDS = 3
_EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_OPEN, _CLOSE = r"(?:^|[(\[|,\-–—/]\s*|\s)", r"(?=$|[)\]|,\-–—/]|\s|" + _EDGE + ")"


def clean_location(c: Column | str) -> Column:
    """Separators to spaces; runs such as 'FranciscoNew' are split."""
    s = F.regexp_replace(text(c), r"([A-Z])(?<=[a-z][A-Z])", " $1")
    # a plain space that stands alone is what it would become
    sep = rf"{SPACE}–—→↳>|/\\"
    return F.trim(F.regexp_replace(s, rf"[{sep}&&[^ ]][{sep}]*| [{sep}]+", " "))


def word_runs(c: Column) -> Column:
    """All runs of one to three words; punctuation marks are words of their own."""
    def runs(w: Column) -> Column:
        def of(n: int) -> Column:
            starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

        return F.concat(w, *[of(n) for n in range(2, _MAX_WORDS + 1)])

    return let(F.filter(F.split(F.regexp_replace(c, rf"([^{WORD} ])", " $1 "), " "), lambda x: x != ""), runs)


def _longest(runs: str, terms: list[str]) -> Column:
    return F.expr(f"array_min(transform(filter({runs}, g -> g in ({quoted(terms)})), g -> named_struct('n', -length(g), 'g', g))).g")


def home_place(runs: str) -> Column:
    """Home-country name, city or region among the word runs, '' when none."""
    name = F.expr(f"get(filter(array({quoted(V.HOME_NAMES)}), n -> array_contains({runs}, n)), 0)")
    return F.coalesce(name, _longest(runs, V.HOME_CITIES), _longest(runs, V.HOME_REGIONS), F.lit(""))


def city_state_us(raw: str) -> Column:
    """'City, ST' names a US state; IN is Indiana unless the city is a home city."""
    codes = F.regexp_extract_all(raw, F.lit(rf",\s*([A-Z]{{2}})(?![{WORD}])"), F.lit(1))
    city = F.expr(f"trim(substring_index(lower({raw}), ',', 1))")
    home = F.array_contains(lits(V.HOME_CITIES), city) | contains_any(city, V.HOME_NAMES)
    return F.arrays_overlap(codes, lits([c for c in V.US_STATE_CODES if c != "IN"])) | (F.array_contains(codes, "IN") & ~home)


def bare_country_code(raw: Column) -> Column:
    """Upper-case country code in a delimited position, '' when none."""
    names = {**V.BARE_CODE_ALIASES, **{c: c for c in V.BARE_CODES_SAME}}
    body = "|".join(re.escape(c) for c in sorted(names, key=len, reverse=True))
    code = F.regexp_extract(raw, f"{_OPEN}({body}){_CLOSE}", 1)
    for alias, country in V.BARE_CODE_ALIASES.items():
        if alias != country:
            code = F.when(code == alias, F.lit(country)).otherwise(code)
    return code


def listed_country(runs: str, geo: str) -> Column:
    """First listed country one of whose words occurs, '' when none."""
    rank = {t: i for i, terms in enumerate(V.COUNTRY_TERMS.values()) for t in terms}
    by_word = ", ".join(f"{quoted([t])}, {i}" for t, i in rank.items())
    best = F.expr(f"array_min(transform(filter({runs}, g -> g in ({quoted(rank)})), g -> map({by_word})[g]))")
    dotted = rf"(?<![{WORD}])u\.s\.(?=[{WORD}])|(?<![{WORD}])u\.s\.a(?![{WORD}])"
    best = F.when(F.col(geo).rlike(dotted), F.lit(0)).otherwise(best)
    return F.coalesce(F.get(lits(V.COUNTRY_TERMS), best), F.lit(""))


def auth_restriction(c: Column) -> Column:
    out = F.lit("")
    for country, phrases in reversed(V.AUTH_PHRASES.items()):
        out = F.when(contains_any(c, phrases), F.lit(country)).otherwise(out)
    return out


def _mode_terms(c: Column) -> tuple[Column, Column, Column]:
    spaced = [t for t in V.REMOTE_TERMS if " " in t]
    single = [t for t in V.REMOTE_TERMS if " " not in t]
    return (contains_any(c, V.HYBRID_TERMS), contains_any(c, spaced) | has_word(c, single), contains_any(c, V.ONSITE_TERMS))


def location_label(mode: Column, country: Column) -> Column:
    pretty = reduce(lambda acc, kv: F.when(mode == kv[0], F.lit(kv[1])).otherwise(acc), V.MODE_LABELS.items(), F.lit("Unspecified"))
    return F.when(country != "", F.concat(pretty, F.lit(" · "), country)).otherwise(pretty)


def classify_text(df: DataFrame, raw: Column, extra: Column) -> DataFrame:
    """Add ``loc``: raw, mode, country, city, is_home, is_global, label, signals."""
    df = df.withColumn("_raw", raw).withColumn("_geo", F.lower("_raw"))
    df = df.withColumn("_hay", F.trim(F.lower(F.concat_ws(" ", "_raw", extra)))).withColumn("_runs", word_runs(F.col("_geo")))
    geo, hay, rawc = F.col("_geo"), F.col("_hay"), F.col("_raw")
    us = city_state_us("_raw") | F.expr(f"exists(_runs, g -> g in ({quoted([*V.US_STATE_NAMES, *V.US_CITIES])}))")
    listed = listed_country("_runs", "_geo")
    hybrid, remote, onsite = _mode_terms(hay)
    df = df.select("*", home_place("_runs").alias("_city"),
                   F.when(us, "US").when(listed != "", listed).otherwise(bare_country_code(rawc)).alias("_other"),
                   contains_any(geo, V.GLOBAL_TERMS).alias("_global"), hybrid.alias("_hybrid"),
                   (remote & ~onsite).alias("_remote"), onsite.alias("_onsite"), auth_restriction(hay).alias("_auth"))
    home, other, auth = F.col("_city") != "", F.col("_other"), F.col("_auth")
    place = F.when(home, F.lit(V.HOME_COUNTRY)).otherwise(other)
    tied = F.when(auth != "", auth).when(~home, other).otherwise("")
    mode = (F.when(hay == "", "unknown").when(F.col("_hybrid"), "hybrid")
            .when(F.col("_remote") & (F.col("_global") | (tied == "")), "remote").when(F.col("_remote"), "remote_geo")
            .when(F.col("_onsite") | (place != ""), "onsite").when(auth != "", "remote_geo").otherwise("unknown"))
    df = df.withColumn("_mode", mode)
    country = F.when(place != "", place).when((F.col("_mode") == "remote_geo"), F.when(F.col("_remote"), tied).otherwise(auth)).otherwise("")
    signals = F.array_compact(F.array(
        F.when(F.col("_global"), "global"),
        F.when(home, F.concat(F.lit("india:"), F.col("_city"))).when(other != "", F.concat(F.lit("country:"), other)),
        F.when(F.col("_mode") == "hybrid", "hybrid"),
        F.when(F.col("_remote") & (F.col("_mode") == "remote_geo"), F.concat(F.lit("remote_restricted:"), tied)),
        F.when(F.col("_mode") == "onsite", "onsite").when(F.col("_remote") & F.col("_mode").startswith("remote"), "remote")
        .when(F.col("_mode") == "remote_geo", F.concat(F.lit("auth:"), auth))))
    loc = F.struct(rawc.alias("raw"), F.col("_mode").alias("mode"), country.alias("country"), F.col("_city").alias("city"),
                   home.alias("is_home"), F.col("_global").alias("is_global"),
                   location_label(F.col("_mode"), country).alias("label"), signals.alias("signals"))
    return df.withColumn("loc", loc).drop("_raw", "_geo", "_hay", "_runs", "_city", "_other", "_global", "_hybrid", "_remote", "_onsite", "_auth", "_mode")


def classify_location(df: DataFrame) -> DataFrame:
    """Classify records; missing columns count as empty."""
    def field(name: str) -> Column:
        return text(name) if name in df.columns else F.lit("")

    where = [strip(field(n)) for n in ("location", "city", "mode")]
    extra = clean_location(F.concat_ws(" ", *[field(n) for n in ("mode", "eligibility", "description", "name")]))
    return classify_text(df, clean_location(first_nonblank(*where)), extra)


def annotate(df: DataFrame) -> DataFrame:
    """Write location_mode, location_label, location and country onto records."""
    out = classify_location(df).withColumns({
        "location_mode": F.col("loc.mode"), "location_label": F.col("loc.label"),
        "location": F.when(F.col("loc.raw") != "", F.col("loc.raw")).otherwise(F.col("location")),
        "country": F.when(F.col("loc.country") != "", F.col("loc.country")).otherwise(
            F.col("country") if "country" in df.columns else F.lit(None).cast("string"))})
    return out


def geo_policy(df: DataFrame, policy: dict[str, str] | None = None, home: str = V.HOME_COUNTRY,
               categories: list[str] | None = None) -> DataFrame:
    """Add ``keep`` and ``reason``; rows of other categories are always kept.

    ``policy`` maps a mode to any, home, keep or drop.
    """
    policy = policy or V.GEO_POLICY
    mode, country = F.col("loc.mode"), F.col("loc.country")
    rule = reduce(lambda acc, kv: F.when(mode == kv[0], F.lit(kv[1])).otherwise(acc), policy.items(), F.lit("keep"))
    df = df.withColumn("_rule", rule)
    home_ok = F.col("loc.is_global") | (country == "") | (country == home)
    named = F.col("category").isin(categories if categories is not None else V.GEO_CATEGORIES)
    keep = (F.col("_rule") != "drop") & ((F.col("_rule") != "home") | home_ok)
    reason = (F.when(F.col("_rule") == "keep", F.concat(mode, F.lit(": kept by policy")))
              .when(F.col("_rule") == "drop", F.concat(mode, F.lit(": dropped by policy")))
              .when(F.col("_rule") == "any", F.concat(mode, F.lit(": no geographic restriction")))
              .when(F.col("loc.is_global"), F.concat(mode, F.lit(": explicitly worldwide")))
              .when(country == "", F.concat(mode, F.lit(": country unknown, kept")))
              .when(country == home, F.concat(mode, F.lit(f": in {home}")))
              .otherwise(F.concat(mode, F.lit(" in "), country, F.lit(f", outside {home}"))))
    return (df.withColumn("keep", F.when(named, keep).otherwise(True))
            .withColumn("reason", F.when(named, reason).otherwise("category is not filtered")).drop("_rule"))


def location_summary(df: DataFrame) -> DataFrame:
    """Counts by category and mode, and by category and country of dropped rows."""
    # one pass over the records; the facets are parted when a few hundred rows are left
    both = df.groupBy("category", F.col("loc.mode").alias("mode"), F.col("loc.country").alias("country")).agg(
        F.count("*").alias("n"), F.count_if(~F.col("keep")).alias("dropped"))
    facets = F.array(F.struct(F.lit("mode").alias("facet"), F.col("mode").alias("value")),
                     F.struct(F.lit("country").alias("facet"), F.when(F.col("country") != "", F.col("country")).otherwise("(unknown)").alias("value")))
    return (both.select("category", F.explode(facets).alias("f"), "n", "dropped").groupBy("category", "f.facet", "f.value")
            .agg(F.sum("n").alias("n"), F.sum("dropped").alias("dropped")))


def top_countries(summary: DataFrame, n: int = 5, by: str = "n") -> DataFrame:
    """The n most frequent countries of each category (a few hundred rows at most)."""
    from pyspark.sql import Window
    w = Window.partitionBy("category").orderBy(F.desc(by), "value")
    return (summary.where((F.col("facet") == "country") & (F.col(by) > 0))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n))


def backfill(df: DataFrame, purge: bool = False, categories: list[str] | None = None) -> DataFrame:
    """Annotate all categories; with ``purge`` leave out disallowed rows of the chosen ones.

    ``drop_eligible`` marks what the policy would remove, whatever the category.
    """
    every = geo_policy(annotate(df), categories=V.CATEGORIES).withColumn("drop_eligible", ~F.col("keep"))
    if purge:
        chosen = categories if categories is not None else V.GEO_CATEGORIES
        every = every.where(~(F.col("drop_eligible") & F.col("category").isin(chosen)))
    return every.drop("keep", "reason")
