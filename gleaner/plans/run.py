"""One run over all categories: candidates in, gated snapshot and new state out.

Everything is one lazy plan; it is cut where several consumers read the same
rows (location, layer 1, layer 2) and inside the two order-respecting dedups.
What only publication needs is made when the snapshot, gate or metrics are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import vocab as V
from ..operators import adjudication, dedup, evidence as ev, gate, location, plausibility, reminders, state
from ..schema import OPPORTUNITY, conform
from ..session import materialize

_HELD = 1 << 60   # held items come after all new ones


@dataclass
class RunResult:
    ledger: DataFrame
    queue: DataFrame
    decisions: DataFrame     # one row per candidate that reached a verdict
    publication: Callable[[], tuple[DataFrame, DataFrame, DataFrame]]   # snapshot, gate, metrics; the proposed table is written when one is first asked for

    @cached_property
    def _published(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.publication()

    @property
    def snapshot(self) -> DataFrame:
        """What may be published."""
        return self._published[0]

    @property
    def gate(self) -> DataFrame:
        """One row per category."""
        return self._published[1]

    @property
    def metrics(self) -> DataFrame:
        """Stage, category, n."""
        return self._published[2]


def _count(df: DataFrame, stage: str) -> DataFrame:
    return df.groupBy("category").agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), "category", "n")


def batch_run(existing: DataFrame, incoming: DataFrame, captures: DataFrame, ledger: DataFrame, queue: DataFrame,
              as_of: str, now: str, policy: dict[str, str] | None = None, queue_cap: int | None = None, index: dedup.KeyIndex | None = None) -> RunResult:
    """Dedup, location policy, suppression, layer 1, layer 2, memory, expiry, gate.

    ``seq`` is the arrival number of a record and never repeats over runs.
    ``queue.item`` has the opportunity columns.  With an ``index`` of the keys of
    ``existing``, the first dedup does not read those records.
    """
    existing, incoming = conform(existing), conform(incoming)
    held = conform(state.quarantine_pending(queue))
    held = held.withColumn("seq", F.pmod("seq", F.lit(_HELD)) + _HELD)
    fresh = dedup.merge_dedup(existing, incoming.unionByName(held), index)
    located = materialize(state.with_fingerprint(location.geo_policy(location.annotate(fresh), policy)), "located")
    allowed = located.where("keep")
    live = state.suppress_retired(allowed, ledger)

    judged = materialize(plausibility.verify(live.drop("keep", "reason", "loc"), existing, captures, as_of), "layer1")
    passed = judged.where("outcome <> 'reject'").drop("reasons")
    index = adjudication.corroboration_index(existing, incoming)
    facts = materialize(ev.build_evidence(captures, as_of), "evidence")
    settled = materialize(adjudication.adjudicate(passed, facts, index, as_of), "layer2")
    accepted, unproven = settled.where("verdict = 'accept'"), settled.where("verdict = 'quarantine'")

    items = unproven.select("seq", "category", "fp", F.col("l2_reasons").alias("reasons"),
                            F.struct(*[F.col(c) for c in OPPORTUNITY.names]).alias("item"))
    kept_queue, retired = state.quarantine_hold(queue, items, now)
    new_queue = state.quarantine_release(kept_queue, accepted)
    if queue_cap is not None:
        new_queue = state.quarantine_cap(new_queue, queue_cap)

    common = ["seq", "fp", "name", "category", "source", F.col("application_link").alias("link")]
    none = F.lit(None)
    layer1 = judged.where("outcome = 'reject'").select(
        *common, F.lit("reject").alias("decision"), F.lit("L1").alias("layer"), "reasons", none.cast("string").alias("evidence"), none.cast("string").alias("evidence_hash"),
        none.cast("double").alias("trust"), none.cast("bigint").alias("corroboration"), none.cast("map<string,string>").alias("corrections"), none.cast("boolean").alias("permanent"))
    spent = retired.select("category", "fp", F.col("attempts").alias("spent"))
    over, waits = F.col("spent").isNotNull(), F.col("verdict") == "quarantine"
    layer2 = settled.join(spent, ["category", "fp"], "left").select(
        *common, F.when(waits & over, "reject").otherwise(F.col("verdict")).alias("decision"),
        F.when(waits & over, "quarantine-expiry").otherwise("L2").alias("layer"),
        F.when(waits & over, F.concat(F.array(F.concat(F.lit("unproven after "), F.col("spent").cast("string"), F.lit(" attempts"))), F.col("l2_reasons")))
        .when(F.col("verdict") != "accept", F.col("l2_reasons")).alias("reasons"),
        F.when(~waits, F.col("evidence_kind")).alias("evidence"), F.when(~waits, F.col("evidence_hash")).alias("evidence_hash"),
        "trust", "corroboration", F.when(F.col("verdict") == "accept", F.col("corrections")).alias("corrections"),
        F.when(waits & over, F.lit(True)).alias("permanent"))
    decisions = layer1.unionByName(layer2)
    new_ledger = state.ledger_prune(state.ledger_upsert(ledger, decisions, now), now)

    def publication() -> tuple[DataFrame, DataFrame, DataFrame]:
        added = conform(accepted)
        proposed = materialize(reminders.expire_status(existing.unionByName(added), as_of), "proposed")
        verdicts = gate.gate_decide(gate.gate_metrics(existing, proposed.drop("expired"), added))
        snapshot = gate.gated_snapshot(existing, proposed.drop("expired"), verdicts)

        stages = [_count(incoming, "incoming"), _count(held, "requeued"), _count(located, "new"), _count(located.where("not keep"), "location_dropped"),
                  _count(allowed.join(live.select("seq"), "seq", "left_anti"), "suppressed"), _count(judged.where("outcome = 'reject'"), "l1_rejected"),
                  _count(judged.where("outcome = 'warn'"), "l1_warned"), _count(accepted, "l2_accepted"), _count(unproven, "l2_quarantined"),
                  _count(settled.where("verdict = 'reject'"), "l2_rejected"), _count(settled.where(F.size("corrections") > 0), "corrected"),
                  _count(retired, "retired"), _count(proposed.where("expired"), "expired"),
                  verdicts.where("not allowed").select(F.lit("blocked").alias("stage"), "category", F.col("blockers").alias("n"))]
        metrics = reduce(lambda a, b: a.unionByName(b), stages)
        return snapshot, verdicts, metrics

    return RunResult(new_ledger, new_queue, decisions, publication)


def empty_queue(spark) -> DataFrame:
    from ..schema import QUARANTINE
    return spark.createDataFrame([], QUARANTINE)


def empty_ledger(spark) -> DataFrame:
    from ..schema import LEDGER
    return spark.createDataFrame([], LEDGER)


CATEGORIES = V.CATEGORIES
