"""Source registry, routing of captures and the union of all sources."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.text import text
from ..operators.dedup import feed_dedup
from ..operators.ranking import numbered
from ..schema import OPPORTUNITY, conform
from ..session import materialize
from . import documents

# Order of the reliability tiers (fixed values); later sources rank lower.
ORDER = ["github", "codeforces", "leetcode", "gsoc", "company", "jobspy", "kontests", "reach", "devfolio",
         "unstop-hackathons", "unstop-competitions", "mlh", "devpost", "hackerearth", "internshala", "social"]
_SOURCES: dict[str, tuple[str | None, Callable[[DataFrame], DataFrame]]] = {}


def register_source(name: str, fn: Callable[[DataFrame], DataFrame], category: str | None = None) -> None:
    """Add a source: a function from captures to records, and its category if fixed."""
    _SOURCES[name] = (category, fn)


def registered() -> dict[str, tuple[str | None, Callable[[DataFrame], DataFrame]]]:
    return dict(sorted(_SOURCES.items(), key=lambda kv: ORDER.index(kv[0]) if kv[0] in ORDER else len(ORDER)))


def union_sources(captures: DataFrame, sources: dict[str, tuple[str | None, Callable[[DataFrame], DataFrame]]] | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """All records in registry order, and (source, error) of sources that failed to plan.

    A source's fixed category overrides what a record says.  ``seq``, or
    ``capture_id`` and ``pos``, order the records of a source; ``seq`` of the
    result numbers all records 1..n, source by source.
    """
    parts, errors = [], []
    for rank, (name, (category, fn)) in enumerate((sources or registered()).items()):
        try:
            rows = fn(captures)
            if "seq" in rows.columns:
                place = [F.lit(0).cast("bigint"), F.col("seq").cast("bigint")]
            elif {"capture_id", "pos"} <= set(rows.columns):
                place = [F.col("capture_id").cast("bigint"), F.col("pos").cast("bigint")]
            else:
                raise ValueError("a source must give its records an order (seq, or capture_id and pos)")
            if category:
                rows = rows.withColumn("category", F.lit(category))
            rows = rows.select(*rows.columns, place[0].alias("_capture"), place[1].alias("_pos"))
            shaped = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in OPPORTUNITY.fields if f.name != "seq"]
            rows = rows.select(*shaped, F.lit(name).alias("origin"), F.lit(rank).alias("_rank"), "_capture", "_pos")
            # each source is written on its own, so one that fails while it runs does not stop the others either
            parts.append(materialize(rows, f"source-{name}"))
        except Exception as e:  # one broken source must not stop the others
            errors.append((name, str(e)))
    if not parts:
        return conform(captures.limit(0)).withColumn("origin", F.lit("")), errors
    out = reduce(DataFrame.unionByName, parts)
    return numbered(out, "seq", "_rank", "_capture", "_pos", "name").select(*OPPORTUNITY.names, "origin"), errors


def source_report(records: DataFrame, errors: list[tuple[str, str]] = ()) -> DataFrame:
    """Rows per source and category; failed sources with their error."""
    counts = records.groupBy("origin", "category").agg(F.count("*").alias("n")).withColumn("error", F.lit(""))
    if not errors:
        return counts
    failed = records.sparkSession.createDataFrame([(n, "", 0, e) for n, e in errors], "origin string, category string, n bigint, error string")
    return counts.unionByName(failed)


# parser name -> function; the parser of a source is a value of the catalogue
PARSERS: dict[str, Callable[..., DataFrame]] = {
    "html_table": documents.table_listings, "markdown_table": documents.markdown_programs, "markdown_list": documents.markdown_list,
    "sections": documents.markdown_sections}


def route(captures: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Parse captures (capture_id, url, body) as the catalogue says.

    Catalogue columns: name, url, parser, category, limit, filter, enabled.
    Disabled entries are skipped.  Results are deduplicated within a category.
    """
    live = captures.join(F.broadcast(catalogue.where("enabled").withColumnsRenamed({"category": "cat", "name": "origin"})), "url")   # a row per source
    live = materialize(live, "routed", "parser")   # each parser reads its own captures
    keys = ("capture_id", "origin", "cat")
    parts = []
    for parser, fn in PARSERS.items():
        rows = fn(live.where(F.col("parser") == parser), *keys)
        if parser == "sections":
            rows = rows.withColumn("_section", F.lit(True))
        else:
            rows = rows.withColumn("category", F.col("cat")).withColumn("source", F.concat(F.lit("github-"), F.col("origin")))
        parts.append(rows)
    feeds = live.where(F.col("parser") == "feed").withColumnRenamed("limit", "take")
    entries = documents.feed_entries(feeds, *keys, "filter", "take", limit=F.coalesce("take", F.lit(2 ** 31 - 1)))
    parts.append(documents.feed_records(entries.withColumn("source", F.col("origin")), *keys).withColumn("category", F.col("cat")))
    pages = live.where(F.col("parser") == "listing").withColumn("source", F.col("origin"))
    parts.append(documents.listing_links(pages, *keys).withColumn("category", F.col("cat")))

    def placed(df: DataFrame) -> DataFrame:
        """The opportunity columns with the arrival order: capture, then section, table and row inside it."""
        section = F.when(F.col("category") == "competitions", 1).when(F.col("category") == "fellowships", 2).otherwise(0) if "_section" in df.columns else F.lit(0)
        table = F.col("table") if "table" in df.columns else F.lit(0)
        columns = [(F.col(c) if c in df.columns else F.lit(None).cast(OPPORTUNITY[c].dataType)).alias(c) for c in ("origin", *OPPORTUNITY.names) if c not in ("seq", "origin")]
        return df.select("origin", *columns, F.col("capture_id").cast("bigint").alias("_capture"), section.cast("bigint").alias("_section"),
                         table.cast("bigint").alias("_table"), F.col("pos").cast("bigint").alias("_pos"))

    out = reduce(DataFrame.unionByName, [placed(p) for p in parts])
    order = ["_capture", "origin", "_section", "_table", "_pos"]
    out = materialize(out.where(text("name") != ""), "parsed")   # sorting by range reads its input twice
    out = numbered(out, "seq", *order).select("origin", *OPPORTUNITY.names)
    return feed_dedup(out)
