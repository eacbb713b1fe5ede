"""Dataset-wide invariants before publication.

All counts come from one aggregate per table; what is joined and collected has
one row per category.  A blocked category keeps its old snapshot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocab as V
from ..functions.text import normalize_title, strip, text
from ..functions.urls import gate_link
from ..session import materialize

G = V.GATE


def _linked(df: DataFrame) -> Column:
    cols = [c for c in ("application_link", "url", "website", "link") if c in df.columns]
    return reduce(lambda a, b: a | b, [strip(text(c)).startswith("http") for c in cols], F.lit(False))


def dup_counts(df: DataFrame) -> DataFrame:
    """Surplus rows per category that share a name (over 4 letters) or a link (over 10)."""
    name, link = normalize_title("name"), gate_link("application_link")
    keys = F.array(F.struct(F.lit("name").alias("kind"), F.when(F.length(name) > 4, name).alias("k")),
                   F.struct(F.lit("link").alias("kind"), F.when(F.length(link) > 10, link).alias("k")))
    each = df.select("category", F.explode(keys).alias("x")).select("category", "x.*").where(F.col("k").isNotNull())
    surplus = each.groupBy("category", "kind", "k").agg((F.count("*") - 1).alias("n"))
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).cast("bigint")
    return surplus.groupBy("category").agg(total("name").alias("dup_names"), total("link").alias("dup_links"))


def _unserializable(df: DataFrame) -> Column:
    """A number that JSON cannot hold: NaN or infinite."""
    numbers = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    return reduce(lambda a, b: a | b, [F.isnan(c) | (F.abs(c) == float("inf")) for c in numbers], F.lit(False))


def unknown_statuses(df: DataFrame, n: int = 5) -> DataFrame:
    """Count per category and status outside the allowed list."""
    bad = df.where(~text("status").isin(V.VALID_STATUSES))
    return bad.groupBy("category", "status").agg(F.count("*").alias("n"))


def leaked_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in V.INTERNAL_COLUMNS]


def public_columns(df: DataFrame) -> DataFrame:
    """Without bookkeeping columns."""
    return df.drop(*V.INTERNAL_COLUMNS)


def gate_metrics(before: DataFrame, after: DataFrame, added: DataFrame) -> DataFrame:
    """One row per category with every number the checks need."""
    leaks = reduce(lambda x, y: x + y, [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in leaked_columns(after)], F.lit(0))

    def tagged(df: DataFrame, side: str, **flags: Column) -> DataFrame:
        names = ("linked", "blank", "bad_status", "unserializable")
        return df.select("category", F.lit(side).alias("side"), *[F.coalesce(flags.get(n, F.lit(False)), F.lit(False)).alias(n) for n in names],
                         flags.get("leaked", F.lit(0)).alias("leaked"))

    rows = (tagged(before, "b", linked=_linked(before)).unionByName(tagged(added, "n")).unionByName(
        tagged(after, "a", linked=_linked(after), blank=strip(text("name")) == "", bad_status=~text("status").isin(V.VALID_STATUSES),
               unserializable=_unserializable(after), leaked=leaks)))
    on = lambda side, cond="true": F.count_if((F.col("side") == side) & F.expr(cond))
    counts = rows.groupBy("category").agg(
        on("a").alias("after"), on("a", "blank").alias("blank_names"), on("a", "not linked").alias("no_link"), on("a", "bad_status").alias("bad_status"),
        on("a", "unserializable").alias("unserializable"), F.sum("leaked").cast("bigint").alias("leaked"),
        on("b").alias("before"), on("b", "linked").alias("before_linked"), on("n").alias("added"))
    out = counts.join(F.broadcast(dup_counts(after)), "category", "left").fillna(0)   # one row per category
    return (out.withColumn("delta", F.col("after") - F.col("before")).withColumn("bootstrap", F.col("before") < G["bootstrap"])
            .withColumn("after_linked", F.col("after") - F.col("no_link")))


def gate_violations(metrics: DataFrame) -> DataFrame:
    """One row per broken rule: category, code, severity, detail."""
    c = F.col
    total = F.greatest(c("after"), F.lit(1))
    worst = F.greatest("dup_names", "dup_links")
    grown = ~c("bootstrap")
    limit = F.greatest(F.lit(G["surge_abs"]), F.floor(c("before") * G["surge_rel"]))
    floor = F.floor(c("before") * G["retention"])

    def say(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def rule(cond: Column, code: str, severity, detail: Column) -> Column:
        sev = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(cond, F.struct(F.lit(code).alias("code"), sev.alias("severity"), detail.alias("detail")))

    some = c("after") > 0
    missing = c("no_link") / total > G["missing_link"]
    flood = worst / total > G["duplicate"]
    rules = [
        rule(c("after") == 0, "empty_payload", "warn", F.lit("resulting dataset is empty")),
        rule(c("blank_names") > 0, "missing_name", F.when(c("blank_names") / total > G["blank_name"], "block").otherwise("warn"), say(c("blank_names"), "/", total, " records have no usable name")),
        rule(some & missing, "widespread_missing_links", "block", say(c("no_link"), "/", c("after"), " records have no http link")),
        rule(some & ~missing & (c("no_link") > 0), "some_missing_links", "warn", say(c("no_link"), " records have no http link")),
        rule(c("bad_status") > 0, "unknown_status", "warn", say(c("bad_status"), " records have an unexpected status")),
        rule(some & flood, "duplicate_flood", "block", say(c("dup_names"), " duplicate names / ", c("dup_links"), " duplicate links")),
        rule(some & ~flood & (worst > 0), "duplicates_present", "warn", say(c("dup_names"), " duplicate names, ", c("dup_links"), " duplicate links")),
        rule(c("leaked") > 0, "internal_metadata_leak", "warn", say(c("leaked"), " internal values in published records")),
        rule(c("unserializable") > 0, "not_serializable", "block", say(c("unserializable"), " records cannot be written as JSON")),
        rule(grown & (c("after") < floor), "mass_deletion", "block", say("would drop ", c("before") - c("after"), " of ", c("before"), " records")),
        rule(grown & (c("added") > limit), "insertion_surge", "block", say(c("added"), " new records exceed the limit of ", limit)),
        rule(grown & (c("before_linked") >= G["link_floor"]) & (c("after_linked") < c("before_linked") * G["link_keep"]), "link_coverage_collapse", "block",
             say("records with links fell from ", c("before_linked"), " to ", c("after_linked")))]
    return metrics.select("category", F.explode(F.array_compact(F.array(*rules))).alias("v")).select("category", "v.*")


def gate_decide(metrics: DataFrame) -> DataFrame:
    """Whether each category may be published, with its blockers and warnings; written once, a row per category."""
    metrics = materialize(metrics, "gate-metrics")
    v = gate_violations(metrics).groupBy("category").agg(F.count_if(F.col("severity") == "block").alias("blockers"),
                                                         F.count_if(F.col("severity") == "warn").alias("warnings"))
    out = metrics.join(F.broadcast(v), "category", "left").fillna(0, ["blockers", "warnings"])
    return materialize(out.withColumn("allowed", F.col("blockers") == 0), "gate-decision")


def gated_snapshot(before: DataFrame, after: DataFrame, decision: DataFrame) -> DataFrame:
    """New rows of allowed categories and old rows of blocked ones."""
    blocked = F.broadcast(decision.where(~F.col("allowed")).select("category"))   # one row per category
    return (public_columns(after).join(blocked, "category", "left_anti")
            .unionByName(public_columns(before).join(blocked, "category", "left_semi"), allowMissingColumns=True))
