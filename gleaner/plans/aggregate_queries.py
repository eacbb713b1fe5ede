"""Aggregates, set operations and whole runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from . import duck as D
from .fixtures import AS_OF, NOW
from .registry import query


@query("category_counts", "select coalesce(category, '(all)') as category, count(*) as n from opp group by rollup (category)")
def _(t):
    return t.opp.rollup("category").agg(F.count("*").alias("n")).withColumn("category", F.coalesce("category", F.lit("(all)")))


@query("union_append", "select seq, name, 'incoming' as part from opp where batch <> 0 union all select seq, name, 'existing' from opp where batch = 0")
def _(t):
    opp = t.opp
    return (opp.where("batch = 0").select("seq", "name", F.lit("existing").alias("part"))
            .unionByName(opp.where("batch <> 0").select("seq", "name", F.lit("incoming").alias("part"))))


@query("source_counts", f"select {D.family('source')} as family, category, count(*) as n from opp group by all")
def _(t):
    from ..functions.text import source_family
    return t.opp.groupBy(source_family("source").alias("family"), "category").agg(F.count("*").alias("n"))


def _run(t):
    from .run import batch_run, empty_ledger, empty_queue
    pages = t.opp_pages
    return batch_run(pages.where("batch = 0"), pages.where("batch <> 0"), t.captures_all,
                     empty_ledger(t.spark), empty_queue(t.spark), AS_OF, NOW)


# The whole run has no single SQL text; its parts are checked one by one.
@query("run_metrics")
def _(t):
    return _run(t).metrics


@query("run_snapshot")
def _(t):
    return _run(t).snapshot.select("seq", "name", "category", "status", "deadline")


@query("run_ledger")
def _(t):
    return _run(t).ledger.select("fp", "decision", "layer", "attempts", "permanent")


_PERM = "case when arg_max(decision, seq) = 'reject' then arg_max(layer, seq) <> 'quarantine-expiry' else false end"


@query("state_stream", f"""select fp, arg_min(name, seq) as name, count(*) as attempts, arg_max(decision, seq) as decision, arg_max(layer, seq) as layer, {_PERM} as permanent,
  strftime(arg_min(checked_at, seq), '%Y-%m-%d %H:%M:%S') as first_seen, strftime(arg_max(checked_at, seq), '%Y-%m-%d %H:%M:%S') as last_checked from decisions group by fp""")
def _(t):
    from ..streaming.incremental import run_verdicts
    root = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    rows = t.decisions.withColumn("reasons", F.array("reason")).drop("reason")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    # three deliveries land one after the other, with a run after each
    cuts = ["timestamp_ntz'2024-01-08'", "timestamp_ntz'2024-01-18'"]
    for part in (f"checked_at < {cuts[0]}", f"checked_at >= {cuts[0]} and checked_at < {cuts[1]}", f"checked_at >= {cuts[1]}"):
        rows.where(part).write.mode("append").parquet(f"{root}/landing")
        ledger = run_verdicts(t.spark, f"{root}/landing", root, NOW, schema)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return ledger.select("fp", "name", "attempts", "decision", "layer", "permanent", stamp("first_seen"), stamp("last_checked"))
