"""URL filters by path templates.

Per host, a path is a sequence of segments.  A segment value that is frequent
on its host, after segments of the same shapes, stays literal; any other
becomes a wildcard of its shape, so a variable position is one branch.
Branches that differ in one literal and whose labelled outcomes do not differ
significantly are merged into its wildcard.  A template is rejected if the
share of bad labels among its pages, smoothed towards its host and all hosts,
reaches the limit.  Everything is DataFrame and SQL expressions; what is
gathered per host is bounded by the literals that can be frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import lower_ascii

DEPTH = 6  # segments looked at one by one; the rest of a path is one last segment
SHARE = 32  # a literal must stand in at least one of so many rows of its host
LEAST = 5  # and in so many rows
SMOOTH = 4.0  # weight of the host's rate in a template's purity, and of the overall rate in the host's
Z = 1.96  # branches closer than so many standard errors to their siblings are merged
REJECT = 0.5
# fixed values: curated rules, host and path beginning
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest curated rule that fits, null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, start in reversed(ordered):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _shape(segment: Column) -> Column:
    """Shape of a segment: its kind, and its file ending if it has one."""
    stem = F.regexp_replace(segment, r"\.[a-z]{2,5}$", "")
    kind = (F.when(stem.rlike("^[0-9]+$"), "<num>").when(stem.rlike("^[0-9a-fA-F-]{8,}$"), "<hex>").when(stem.rlike("^[a-zA-Z]+$"), "<word>")
            .when(stem.rlike("^[a-zA-Z0-9]+$"), "<mixed>").when(stem == "", "<none>").otherwise("<text>"))
    return F.concat(kind, F.regexp_extract(segment, r"(\.[a-z]{2,5})$", 1))


def _segments(path: Column) -> Column:
    """The first DEPTH segments, and the rest as one."""
    return F.split(F.regexp_replace(path, "^/", ""), "/", DEPTH + 1)


def _places(rows: DataFrame) -> DataFrame:
    """``rows`` with ``places``: per segment its literal and the place, a hash of depth and the shapes before it."""
    shapes = F.transform(F.col("segments"), _shape)
    rows = rows.withColumn("shapes", shapes)
    place = lambda s, i: F.struct(s.alias("literal"), F.xxhash64(i, F.slice("shapes", F.lit(1), i)).alias("place"))
    return rows.withColumn("places", F.transform(F.col("segments"), place))


def _literals(rows: DataFrame) -> DataFrame:
    """(host, literals): hashes of (place, literal) that stay literal; at most SHARE per depth of a host."""
    each = rows.select("host", F.explode("places").alias("p")).select("host", F.xxhash64("p.place", "p.literal").alias("term"))
    counts = each.groupBy("host", "term").agg(F.count("*").alias("n"))
    totals = rows.groupBy("host").agg(F.count("*").alias("rows"))
    return (counts.filter(F.col("n") >= LEAST).join(totals, "host").filter(F.col("n") * SHARE >= F.col("rows"))
            .groupBy("host").agg(F.collect_list("term").alias("literals")))


def _merged(stats: DataFrame, level: int) -> DataFrame:
    """(host, template, wild): templates that join their siblings by giving up the literal at ``level``.

    ``stats`` has a row per host and template with ``good`` and ``bad`` labels.
    """
    at = F.col("segments")[level]
    literal = (F.size("segments") > level) & ~at.startswith("<")
    wild = F.expr(f"transform(segments, (s, i) -> if(i = {level}, shapes[i], s))")
    branches = stats.filter(literal).withColumn("wild", wild).withColumn("n", F.col("good") + F.col("bad"))
    family = branches.groupBy("host", "wild").agg(F.sum("n").alias("all"), F.sum("bad").alias("all_bad"), F.count("*").alias("siblings"))
    pooled = (F.col("all_bad") + 0.5) / (F.col("all") + 1.0)
    error = F.sqrt(pooled * (1 - pooled) / F.greatest("n", F.lit(1)))
    # without labels nothing tells a branch from its siblings
    alike = (F.col("n") == 0) | (F.abs(F.col("bad") / F.greatest("n", F.lit(1)) - pooled) <= Z * error)
    return branches.join(family, ["host", "wild"]).filter((F.col("siblings") > 1) & alike).select("host", "segments", "wild").dropDuplicates(["host", "segments"])


def templates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree of rows (host, path, bad): (host, literals) and (host, segments, template, n, labelled, purity, verdict).

    ``bad`` is 1 or 0 for labelled rows, else null.  ``purity`` is the smoothed
    share of bad labels.
    """
    placed = _places(rows.withColumn("segments", _segments(F.col("path"))))
    literals = materialize(_literals(placed), "literals")
    stats = (templated(placed, literals).groupBy("host", "segments", "shapes")
             .agg(F.count("*").alias("n"), F.count_if(F.col("bad") == 0).alias("good"), F.count_if(F.col("bad") == 1).alias("bad")))
    stats = stats.withColumn("origin", F.col("segments"))
    for level in reversed(range(DEPTH + 1)):  # from the leaves up: a merged branch is a sibling one level higher
        current = stats.groupBy("host", "segments", "shapes").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        joins = _merged(current, level)
        stats = (stats.join(joins, ["host", "segments"], "left").withColumn("segments", F.coalesce("wild", "segments")).drop("wild"))
        stats = materialize(stats, "templates")
    total = stats.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum(F.col("good") + F.col("bad")), F.lit(0)) + 1.0)).first()[0]
    hosts = stats.groupBy("host").agg(((F.sum("bad") + SMOOTH * total) / (F.sum(F.col("good") + F.col("bad")) + SMOOTH)).alias("host_rate"))
    named = stats.groupBy("host", "segments").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).join(hosts, "host")
    purity = (F.col("bad") + SMOOTH * F.col("host_rate")) / (F.col("good") + F.col("bad") + SMOOTH)
    judged = named.select("host", "segments", F.concat(F.lit("/"), F.array_join("segments", "/")).alias("template"), "n",
                          (F.col("good") + F.col("bad")).alias("labelled"), purity.alias("purity"))
    judged = judged.withColumn("verdict", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    by_origin = stats.select("host", "origin", "segments").distinct().join(judged, ["host", "segments"])
    return literals, materialize(by_origin, "judged")


def templated(placed: DataFrame, literals: DataFrame) -> DataFrame:
    """``placed`` with variable segments replaced by their shapes."""
    known = placed.join(literals, "host", "left")
    keep = F.expr("transform(places, (p, i) -> if(literals is not null and array_contains(literals, xxhash64(p.place, p.literal)), p.literal, shapes[i]))")
    return known.withColumn("segments", keep).drop("places", "literals")


def judge(pages: DataFrame, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
          rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row.

    A curated rule decides where one fits, the longest winning; the template
    tree decides the rest.  The labels are the curated verdicts, and also
    ``labelled`` (url, bad) if given.  A null url, or one without ``://``, has
    an empty host and path, which form a host of their own.  Repeated rows
    stay; an empty table gives an empty table.
    """
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    found = base.withColumn("r", ruled(F.col("host"), F.col("path"), rules))
    found = materialize(found.select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("curated")), "pages")
    learned = found.select("host", "path", F.when(F.col("curated") == "block", 1).when(F.col("curated") == "allow", 0).alias("bad"))
    if labelled is not None:
        learned = learned.unionByName(labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("bad").cast("int").alias("bad")))
    literals, judged = templates(learned)
    rows = templated(_places(found.withColumn("segments", _segments(F.col("path")))), literals)
    out = rows.join(judged.select("host", F.col("origin").alias("segments"), "template", "purity", "verdict"), ["host", "segments"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("curated", "verdict").alias("verdict"), "template", "purity")
