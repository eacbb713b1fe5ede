"""Memory between runs: the verdict ledger and the quarantine.

Tables are rewritten by joins on the fingerprint.  Several decisions of one
fingerprint are folded first with mergeable aggregates, so a fingerprint that
owns a third of all decisions is reduced before the shuffle.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vocab as V
from ..functions.text import text
from ..functions.urls import fingerprint
from .joins import lookup

_OPTIONAL = {"evidence": "string", "evidence_hash": "string", "trust": "double", "corroboration": "bigint",
             "corrections": "map<string,string>", "permanent": "boolean", "reasons": "array<string>",
             "name": "string", "category": "string", "source": "string", "link": "string"}


def now_col(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def with_fingerprint(df: DataFrame) -> DataFrame:
    site = F.col("website") if "website" in df.columns else F.lit("")
    return df.withColumn("fp", fingerprint("name", "application_link", site))


def _complete(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in df.columns})


def _permanent() -> Column:
    rule = (F.col("decision") == "reject") & (F.col("layer") != "quarantine-expiry")
    return F.when(F.col("decision") == "reject", F.coalesce("permanent", rule)).otherwise(False)


def fold_decisions(decisions: DataFrame, now: str) -> DataFrame:
    """One row per fingerprint from decisions in ``seq`` order."""
    df = _complete(decisions)
    if "checked_at" not in df.columns:
        df = df.withColumn("checked_at", now_col(now))
    df = df.withColumn("permanent", _permanent())
    last = lambda c, cond=None: F.max_by(c, F.when(cond, F.col("seq")) if cond is not None else F.col("seq")).alias(c)
    first = lambda c: text(F.min_by(c, "seq")).alias(c)
    return df.groupBy("fp").agg(
        first("name"), F.min_by("category", "seq").alias("category"), first("source"), first("link"),
        F.min_by("checked_at", "seq").alias("first_seen"), F.max_by("checked_at", "seq").alias("last_checked"),
        F.count("*").alias("attempts"), last("decision"), last("layer"),
        F.coalesce(F.max_by("reasons", "seq"), F.array().cast("array<string>")).alias("reasons"),
        last("evidence", text("evidence") != ""), last("evidence_hash", text("evidence_hash") != ""),
        F.round(F.max_by("trust", F.when(F.col("trust").isNotNull(), F.col("seq"))), 2).alias("trust"),
        last("corroboration", F.col("corroboration").isNotNull()), last("corrections", F.size("corrections") > 0), last("permanent"))


def ledger_upsert(ledger: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """Ledger after a run: identity is kept from the first sight, verdict from the last."""
    new = fold_decisions(decisions, now)
    n, l = new.alias("n"), ledger.alias("l")
    known, seen = F.col("l.fp").isNotNull(), F.col("n.fp").isNotNull()
    keep = lambda c: F.when(known, F.col(f"l.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    take = lambda c: F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"l.{c}")).alias(c)
    fill = lambda c: F.coalesce(f"n.{c}", f"l.{c}").alias(c)
    return l.join(n, F.col("l.fp") == F.col("n.fp"), "full_outer").select(
        F.coalesce("l.fp", "n.fp").alias("fp"), *[keep(c) for c in ("name", "category", "source", "link", "first_seen")],
        take("last_checked"), (F.coalesce("l.attempts", F.lit(0)) + F.coalesce("n.attempts", F.lit(0))).cast("bigint").alias("attempts"),
        *[take(c) for c in ("decision", "layer", "reasons")],
        *[fill(c) for c in ("evidence", "evidence_hash", "trust", "corroboration", "corrections")], take("permanent"))


def ledger_prune(ledger: DataFrame, now: str, days: int = V.RETENTION_DAYS) -> DataFrame:
    """Drop rows not checked for ``days``; a missing time counts as now."""
    return ledger.where(F.coalesce("last_checked", now_col(now)) >= now_col(now) - timedelta(days=days))


def ledger_lookup(df: DataFrame, ledger: DataFrame) -> DataFrame:
    """Add decision and number of attempts known for each record."""
    side = ledger.select("fp", F.col("decision").alias("known_decision"), F.col("attempts").alias("known_attempts"))
    return (lookup(with_fingerprint(df), side, ["fp"])
            .withColumn("known_attempts", F.coalesce("known_attempts", F.lit(0)).cast("bigint")))


def suppress_retired(df: DataFrame, ledger: DataFrame) -> DataFrame:
    """Leave out records that were rejected for good."""
    retired = ledger.where((F.col("decision") == "reject") & F.col("permanent")).select("fp")
    return lookup(with_fingerprint(df), retired, ["fp"], how="left_anti")


def recheck_due(df: DataFrame, ledger: DataFrame, now: str, hours: int = V.RECHECK_HOURS) -> DataFrame:
    """Add ``due``: false while an acceptance is younger than ``hours``."""
    side = ledger.where(F.col("decision") == "accept").select("fp", "last_checked")
    fresh = F.col("last_checked") > now_col(now) - timedelta(hours=hours)
    return (lookup(with_fingerprint(df), side, ["fp"]).withColumn("due", ~F.coalesce(fresh, F.lit(False))).drop("last_checked"))


def ledger_stats(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("decision").agg(F.count("*").alias("n"), F.count_if("permanent").alias("retired"))


# ---- quarantine ----------------------------------------------------------

def quarantine_hold(queue: DataFrame, items: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Park unproven items; returns (queue, retired).

    Every hold adds one attempt; the fifth retires the item and empties its
    slot.  So after k holds on a known attempts the slot holds (a + k) mod 5
    attempts and the item was retired (a + k) div 5 times.
    """
    cycle = V.MAX_ATTEMPTS + 1
    held = items.groupBy("category", "fp").agg(
        F.count("*").alias("k"), F.coalesce(F.max_by("reasons", "seq"), F.array().cast("array<string>")).alias("reasons"),
        F.max_by("item", "seq").alias("item"))
    q, h = queue.alias("q"), held.alias("h")
    both = q.join(h, (F.col("q.category") == F.col("h.category")) & (F.col("q.fp") == F.col("h.fp")), "full_outer")
    seen = F.col("h.fp").isNotNull()
    total = F.coalesce("q.attempts", F.lit(0)) + F.coalesce("h.k", F.lit(0))
    rows = both.select(
        F.coalesce("q.category", "h.category").alias("category"), F.coalesce("q.fp", "h.fp").alias("fp"),
        (total % cycle).cast("bigint").alias("attempts"), F.floor(total / cycle).alias("times_retired"),
        F.when(total >= cycle, now_col(now)).otherwise(F.coalesce("q.first_held", now_col(now))).alias("first_held"),
        F.when(seen, now_col(now)).otherwise(F.col("q.last_seen")).alias("last_seen"),
        F.when(seen, F.col("h.reasons")).otherwise(F.col("q.reasons")).alias("reasons"),
        F.when(seen, F.col("h.item")).otherwise(F.col("q.item")).alias("item"))
    queue_out = rows.where(F.col("attempts") > 0).drop("times_retired")
    retired = rows.where(F.col("times_retired") > 0).select("category", "fp", F.lit(cycle).cast("bigint").alias("attempts"), "times_retired", "item")
    return queue_out, retired


def quarantine_pending(queue: DataFrame) -> DataFrame:
    """Held items as candidates again, with the attempts so far."""
    return queue.where(text("item.name") != "").select("item.*", F.col("attempts").alias("held_attempts"))


def quarantine_release(queue: DataFrame, accepted: DataFrame) -> DataFrame:
    return queue.join(accepted.select("category", "fp").distinct(), ["category", "fp"], "left_anti")


def quarantine_cap(queue: DataFrame, n: int = V.QUARANTINE_CAP) -> DataFrame:
    """The n newest entries per category, taken first per salt, so that a category is many tasks."""
    out = queue.withColumn("_salt", F.pmod(F.xxhash64("fp"), F.lit(64)))
    for part in (["category", "_salt"], ["category"]):
        w = Window.partitionBy(*part).orderBy(F.desc("last_seen"), "fp")
        out = out.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    return out.drop("_rank", "_salt")


def quarantine_stats(queue: DataFrame) -> DataFrame:
    return queue.rollup("category").agg(F.count("*").alias("n")).withColumn("category", F.coalesce("category", F.lit("(all)")))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows added, removed and kept per category, by fingerprint."""
    sides = [with_fingerprint(d).select("category", "fp").distinct().withColumn(n, F.lit(1)) for d, n in ((before, "b"), (after, "a"))]
    both = sides[0].join(sides[1], ["category", "fp"], "full_outer")
    return both.groupBy("category").agg(F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("removed"),
                                        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("kept"))
