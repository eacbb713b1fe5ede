"""Incremental runs: new files arrive, verdict state carries over.

A file stream hands over one micro-batch at a time; the batch functions do the
work.  State lives in keyed tables: a batch writes the rows it changed as a new
version that carries the batch's number, and a batch whose number is there is
skipped, so a replay after a crash changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.dedup import KeyIndex
from ..operators.state import ledger_upsert
from ..plans.run import batch_run
from ..schema import LEDGER, OPPORTUNITY, QUARANTINE
from ..session import scratch
from ..sources.keyed import KeyedTable, changes
from ..sources.tables import publish


STREAM = "stream"   # the writer's name in the tables


def _label(batch: int) -> str:
    return f"{batch:012d}"


def ledger_table(spark: SparkSession, root: str) -> KeyedTable:
    return KeyedTable(spark, f"{root}/ledger", LEDGER, ["fp"])


def queue_table(spark: SparkSession, root: str) -> KeyedTable:
    return KeyedTable(spark, f"{root}/queue", QUARANTINE, ["category", "fp"])


def snapshot_table(spark: SparkSession, root: str) -> KeyedTable:
    return KeyedTable(spark, f"{root}/snapshot", _ddl(), ["seq"])


def _drain(spark: SparkSession, landing: str, schema: str, checkpoint: str, step: Callable[[DataFrame, int], None], files: int | None) -> None:
    """Process everything that has landed, then stop."""
    reader = spark.readStream.schema(schema).option("latestFirst", "false")
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    query = (reader.parquet(landing).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def run_verdicts(spark: SparkSession, landing: str, root: str, now: str, schema: str, files: int | None = None) -> DataFrame:
    """Fold arriving decisions into the ledger; returns the ledger."""
    def step(batch: DataFrame, batch_id: int) -> None:
        table = ledger_table(batch.sparkSession, root)
        table.update(batch.select("fp"), lambda known: ledger_upsert(known, batch, now), STREAM, _label(batch_id))
        table.expire()

    _drain(spark, landing, schema, f"{root}/progress", step, files)
    return ledger_table(spark, root).read()


def run_incremental(spark: SparkSession, landing: str, captures: Callable[[SparkSession], DataFrame], root: str,
                    as_of: str, now: str, files: int | None = None) -> DataFrame:
    """Run the whole batch plan on arriving records; returns the published snapshot.

    The snapshot is committed last: its label marks a finished batch.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        tables = [f(session, root) for f in (ledger_table, queue_table, snapshot_table)]
        newest, label = tables[2].manifest(), _label(batch_id)
        finished = newest.done.get(STREAM)
        if finished is not None and finished >= label:
            return
        # a crash between the commits leaves newer ledger or queue versions; go back to the snapshot's
        bases = [t.at_label(STREAM, finished) for t in tables[:2]] + [newest]
        ledger, queue, before = (t.read(m) for t, m in zip(tables, bases))
        index = KeyIndex(session, f"{root}/keys")
        keys = index.table.at_label(STREAM, finished)
        with scratch(session):   # intermediate tables go once all versions are written
            out = batch_run(before, batch, captures(session), ledger, queue, as_of, now, index=index.at(keys))
            publish(out.metrics, f"{root}/metrics", label)
            for table, base, old, new in zip(tables, bases, (ledger, queue, before), (out.ledger, out.queue, out.snapshot)):
                changed, gone = changes(old, new, table.keys)
                if table is tables[2]:   # before the snapshot, whose label ends the batch; records only join it
                    index.add(new.join(old.select("seq"), "seq", "left_anti"), keys, STREAM, label)
                table.fold(table.commit(changed, gone, base, STREAM, label))
        for table in (*tables, index.table):
            table.expire()

    _drain(spark, landing, _ddl(), f"{root}/progress", step, files)
    return snapshot_table(spark, root).read()


def _ddl() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OPPORTUNITY.fields)
