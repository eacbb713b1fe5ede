"""Mixing sources to target weights with a low-discrepancy schedule.

Slot i of the schedule draws the source in whose part of the unit interval the
i-th golden-ratio point falls.  The r-th slot of a source takes the r-th block
of its shuffled word stream, starting over after the last block.  All running
sums go in two steps (per stretch, then over stretches), so no source is ever
ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD, word_count

GOLDEN = (math.sqrt(5) - 1) / 2
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 128  # words of a block
STRETCH = 1 << 12  # slots whose ranks one window orders
CHUNK = 1 << 12  # documents of a source that one window orders, about
GRID = 16  # binary digits of the number of cells that the sources are looked up in, at most
MOST = 3  # a source is used at most so many times


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, n_docs, source_size, weight, target) from rows (source, size); sources in code-point order, null last.

    Targets share the total by weight, stop at ``most`` times the size, and the
    excess is shared again by weight until none is above.  Work is one row per
    source; a round returns three numbers to the driver.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    ordered = totals.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(
        lambda x: (x[0][0], x[0][1], x[0][2], weights[x[1] % len(weights)]))
    now = materialize(spark.createDataFrame(ordered, "source string, n_docs long, source_size long, weight double"), "sources")
    now = now.withColumn("cap", (F.col("source_size") * most).cast("double"))
    total = float(now.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    # a source is capped once its share at the present level reaches its cap; the level only rises
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * level if capped >= 0 else F.lit(False)
        n, held, rest = now.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)),
                                F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not rest:
            break
        capped, level = n, (total - held) / rest
    return now.withColumn("target", F.least("cap", F.col("weight") * F.lit(level))).drop("cap")


def _nth_copy(rows: DataFrame) -> DataFrame:
    """Rows (row, key, ...) with ``nth``: how many rows of the same key come before, counted per input partition first."""
    part = rows.withColumn("part", F.shiftright("row", 33))
    counts = part.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = part.withColumn("local", F.row_number().over(Window.partitionBy("key", "part").orderBy("row")) - 1)
    return local.join(offsets, ["key", "part"]).withColumn("nth", F.col("offset") + F.col("local")).drop("part", "offset", "local")


def _place(key: str) -> Column:
    """The place of a content in its source's shuffled stream; equal places follow by key."""
    return F.xxhash64(key, F.lit(11))


def _stream(rows: DataFrame) -> DataFrame:
    """Rows (row, key, source, size) with ``start``: words of the source's shuffled stream before the row.

    The order is that of a hash of the content; copies of a row are neighbours.
    """
    keys = rows.groupBy("key", "source").agg(F.sum("size").alias("words"), F.count("*").alias("copies"))
    per = keys.groupBy("source").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    spread = (keys.join(per, keys.source.eqNullSafe(per.source)).drop(per.source).withColumn("h", _place("key"))
              .withColumn("chunk", F.floor((F.col("h") / F.lit(2.0 ** 64) + 0.5) * F.col("chunks"))))
    sums = spread.groupBy("source", "chunk").agg(F.sum("words").alias("words"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "chunk").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)
    local = spread.withColumn("local", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    begin = (local.join(offsets, local.source.eqNullSafe(offsets.s) & (local.chunk == offsets.c))
             .select("key", "copies", (F.col("offset") + F.col("local")).alias("begin")))
    begin = materialize(begin, "begins")
    single = rows.join(begin.filter("copies = 1"), "key").select("row", "source", "size", F.col("begin").alias("start"))
    copies = (_nth_copy(rows.join(begin.filter("copies > 1"), "key"))
              .select("row", "source", "size", (F.col("begin") + F.col("nth") * F.col("size")).alias("start")))
    return single.unionByName(copies)


def _cells(rows: DataFrame, n: int, total: float) -> tuple[DataFrame, int]:
    """Rows (source, target, ...) with their parts of the unit interval, low to high, one for each cell of a grid that they touch; and the grid's size.

    The grid turns the search for a point's interval into an equality join.  The
    cells are broadcast, so they are few for few sources.
    """
    # cumulative weights, in any fixed order of the sources
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cumulative = rows.select("*", (F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total).alias("high"))
    cumulative = cumulative.select("*", F.coalesce(F.lag("high").over(order), F.lit(0.0)).alias("low"), F.lead("high").over(order).alias("next"))
    grid = 1 << min(GRID, 6 + n.bit_length())   # a power of two, so that floor() is exact
    return cumulative.select("*", F.explode(F.sequence(F.floor(F.col("low") * grid), F.floor(F.least("high", F.lit(1 - 1e-12)) * grid))).alias("cell")), grid


def schedule(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source, rank, epoch, block, words): the order in which blocks are read.

    ``plan`` is the result of :func:`targets`.  The last block of a source is
    cut so that its words add up to the target.  The schedule is a little longer
    than the total: slots of a source that has reached its target are left out,
    and the few blocks that a source still lacks stand at the end.
    """
    spark = plan.sparkSession
    rows = plan.filter("target >= 0.5").select("source", "source_size", "target")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    if not total:
        return spark.createDataFrame([], "slot long, source string, rank long, epoch long, block long, words long")
    slots = math.ceil(total / block)
    slots += slots // 64 + 64
    cells, grid = _cells(rows, n, total)
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 0.5) * F.lit(GOLDEN) % 1).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * grid))
    drawn = points.join(cells, "cell").filter((F.col("point") >= F.col("low")) & ((F.col("point") < F.col("high")) | F.col("next").isNull()))
    drawn = materialize(drawn.select("slot", F.floor(F.col("slot") / STRETCH).alias("stretch"), "source", "source_size", "target"), "slots")
    counts = drawn.groupBy("source", "stretch").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias("s"), F.col("stretch").alias("t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = drawn.withColumn("local", F.row_number().over(Window.partitionBy("stretch", "source").orderBy("slot")) - 1)
    ranked = local.join(offsets, local.source.eqNullSafe(offsets.s) & (local.stretch == offsets.t)).withColumn("rank", F.col("offset") + F.col("local"))
    per = F.ceil(F.col("source_size") / block)
    goal = F.round("target").cast("long")
    need = F.floor(goal / F.col("source_size")) * per + F.ceil(goal % F.col("source_size") / block)
    have = counts.groupBy("source").agg(F.sum("n").alias("have")).withColumnRenamed("source", "s")
    lacking = (rows.join(have, rows.source.eqNullSafe(have.s), "left").withColumn("have", F.coalesce("have", F.lit(0)))
               .filter(F.col("have") < need).withColumn("rank", F.explode(F.sequence(F.col("have"), need - 1)))
               .select((F.monotonically_increasing_id() + slots).alias("slot"), "source", "source_size", "target", "rank"))
    ranked = ranked.select("slot", "source", "source_size", "target", "rank").unionByName(lacking)
    placed = ranked.withColumn("epoch", F.floor(F.col("rank") / per)).withColumn("block", F.col("rank") % per)
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    left = goal - F.col("epoch") * F.col("source_size") - F.col("block") * block
    return (placed.withColumn("words", F.least(length, left)).filter("words > 0")
            .select("slot", "source", "rank", "epoch", "block", "words"))


def blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, source, block, at, words): which words of a block a row holds; ``at`` counts from the block's start."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    cut = (_stream(rows).filter("size > 0")
           .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), last))))
    low, high = F.col("block") * block, (F.col("block") + 1) * block
    at = F.greatest("start", low) - low
    return cut.select("row", "source", "block", at.alias("at"),
                      (F.least(F.col("start") + F.col("size"), high) - low - at).alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(row, key, id, source, size, source_size, target, taken) per document.

    ``row`` numbers the input's rows and tells repeated ids apart, ``key`` is
    ``xxhash64(id, text, source)``; ``taken`` counts the words that the
    schedule draws from the document, repeats included, and is at most ``most``
    times its size.  A null or blank text has size 0 and is never drawn; the
    null source is a source.  The shuffle hashes the content, so reruns agree.
    An empty table gives an empty table.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                       word_count(F.col(text_col)).alias("size"), F.xxhash64(id_col, text_col, source_col).alias("key"))
    base = materialize(base, "sizes")
    plan = materialize(targets(base, weights, most), "targets")
    drawn = materialize(schedule(plan, block).groupBy("source", "block")
                        .agg(F.min("words").alias("short"), F.max("words").alias("long"), F.count("*").alias("times")), "drawn")
    parts = blocks(base, block)
    b = drawn.select(F.col("source").alias("s"), F.col("block").alias("b"), "long", "short", "times")
    used = parts.join(b, parts.source.eqNullSafe(b.s) & (parts.block == b.b))
    # every drawing of a block is whole, but for the source's last one, which may be cut short
    cut = F.when(F.col("short") < F.col("long"), 1).otherwise(0)
    reach = lambda words: F.greatest(F.lit(0), F.least("words", words - F.col("at")))
    used = used.select("row", ((F.col("times") - cut) * reach(F.col("long")) + cut * reach(F.col("short"))).alias("taken"))
    taken = used.groupBy("row").agg(F.sum("taken").alias("taken"))
    t = plan.select(F.col("source").alias("p"), "source_size", "target")
    out = base.join(taken, "row", "left")
    out = out.join(t, out.source.eqNullSafe(t.p), "left")
    return out.select("row", "key", "id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _uses(taken: DataFrame) -> DataFrame:
    """(source, epochs, h, key, each, n): of every source how often the mix takes its documents.

    The schedule reads a source's stream, which is ordered by (h, key), ``epochs``
    times and then up to some place.  The row names the last content taken more
    than ``epochs`` times, its rows and what each of them is taken; contents
    before it are taken once more, those behind it not.
    """
    epochs = F.floor(F.round("target").cast("long") / F.col("source_size"))
    per = (taken.filter("size > 0").groupBy("source", "key")
           .agg(F.first(epochs).alias("epochs"), (F.sum(F.col("taken") / F.col("size")) / F.count("*")).alias("each"), F.count("*").alias("n")))
    last = F.struct(_place("key").alias("h"), "key", "each", "n")
    return (per.groupBy("source").agg(F.first("epochs").alias("epochs"), F.max(F.when(F.col("each") > F.col("epochs"), last)).alias("last"))
            .select("source", "epochs", "last.*"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents as often as the mix takes them, columns unchanged: 0 to ``most`` copies, each a row.

    A document whose words are taken in part counts as taken if that is at
    least half of them; blank documents, which hold no words, are left out.
    Rows of equal id, text and source share their copies by a hash of their
    place, so none has to gather them.  What the mix takes is told by a row per
    source, so the texts are not shuffled.
    """
    plan = materialize(_uses(mix(docs, id_col, text_col, source_col, **options)), "uses").toDF("__s", "__epochs", "__h", "__key", "__each", "__n")
    key = F.xxhash64(id_col, text_col, source_col)
    chance = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(29)), F.lit(1 << 20)) / float(1 << 20)
    rows = docs.withColumns({"__chance": chance, "__k": key, "__own": F.col(source_col).cast("string")}).filter(F.col(text_col).rlike(WORD))
    rows = rows.join(plan, F.col("__own").eqNullSafe(F.col("__s")))
    before = F.struct(_place("__k").alias("h"), F.col("__k").alias("key")) < F.struct(F.col("__h").alias("h"), F.col("__key").alias("key"))
    part = F.when(F.col("__n") == 1, F.floor(F.col("__each") + 0.5)).otherwise(F.floor(F.col("__each") + F.col("__chance")))
    times = F.when(F.col("__k") == F.col("__key"), part).otherwise(F.col("__epochs") + F.when(F.col("__key").isNotNull() & before, 1).otherwise(0)).cast("int")
    return (rows.withColumn("__times", times).filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
