"""Shards within a byte limit, by extendible hashing.

A row's hash is 128 bits: the first word comes from its content, the second
from its position in the input, and is reached only by rows of equal content.
A directory cell is a prefix of that hash.  Bytes per cell are summed at a
depth a few bits below the expected one; a prefix over the limit splits on
another bit, any other is a shard.  Only cells still over the limit are summed
again, a few bits deeper, and only their rows are read for it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SPARE = 4  # bits summed below the expected depth, and bits added for what is still too large
DEPTH = 128


def _prefix(depth: int) -> Column:
    """The first ``depth`` bits of the row's hash as a text of 0 and 1."""
    return F.substring("bits", 1, depth)


def hashed(rows: DataFrame, size: Column, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` with ``bits`` (128 characters of 0 and 1) and ``n_bytes``.

    Equal content shares the first word only, so groups of copies of any size
    can be split.  The caller writes the result once, so a row keeps its place.
    """
    word = lambda c: F.lpad(F.bin(c), 64, "0")
    content = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    place = F.xxhash64(F.monotonically_increasing_id(), F.lit(1))
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.concat(word(content), word(place)).alias("bits"),
                       F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes"))


def _leaves(cells: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """(shard, n_bytes, n_docs, fits): the prefixes that stop splitting, and the cells still over the limit."""
    levels = (cells.select(F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("d"), "cell", "n_bytes", "n_docs")
              .select(F.substring(F.col("cell"), F.lit(1), F.col("d")).alias("shard"), "d", "n_bytes", "n_docs")
              .groupBy("d", "shard").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_docs").alias("n_docs")))
    split = levels.filter(F.col("n_bytes") > limit).select((F.col("d") + 1).alias("d"), F.col("shard").alias("parent"))
    born = levels.filter(F.col("d") > above).withColumn("parent", F.expr("substring(shard, 1, d - 1)"))
    leaves = levels.filter(F.col("d") == above).select("d", "shard", "n_bytes", "n_docs").unionByName(
        born.join(split, ["d", "parent"], "left_semi").select("d", "shard", "n_bytes", "n_docs"))
    return (leaves.filter((F.col("n_bytes") <= limit) | (F.col("d") == depth))
            .select("shard", "n_bytes", "n_docs", (F.col("n_bytes") <= limit).alias("fits")))


def directory(keys: DataFrame, limit: int) -> DataFrame:
    """(shard, n_bytes, n_docs) for a table with ``bits`` and ``n_bytes``.

    Shards are prefixes, none of which begins another.  A single row over the
    limit is a shard of its own, reached by splitting until it stands alone.
    """
    total = keys.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    depth = min(DEPTH, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE)
    above, todo, done = 0, keys, None
    while True:
        cells = todo.groupBy(_prefix(depth).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs"))
        leaves = materialize(_leaves(cells, above, depth, limit), "leaves")
        kept = leaves.filter("fits or n_docs = 1" if depth < DEPTH else "true").drop("fits")
        done = kept if done is None else done.unionByName(kept)
        large = leaves.filter("not fits and n_docs > 1")
        if depth == DEPTH or large.isEmpty():
            return done
        todo = todo.join(large.select(F.col("shard").alias("cell")), _prefix(depth) == F.col("cell"), "left_semi")
        above, depth = depth, min(DEPTH, depth + SPARE)


def shard(rows: DataFrame, limit: int, size: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """The chosen columns with ``n_bytes``, ``shard``, ``shard_bytes`` and ``shard_docs``.

    ``size`` defaults to the UTF-8 length of ``text``; null is 0 bytes.  Every
    row is kept, repeated rows too.  If all rows fit the limit the only shard
    is the empty prefix.  Columns of ``rows`` named like the new ones are
    replaced; an empty table gives an empty table.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    new = ["bits", "n_bytes", "shard", "shard_bytes", "shard_docs"]
    keep = [c for c in columns or rows.columns if c not in new]
    marked = materialize(hashed(rows, F.octet_length("text") if size is None else size, keep), "hashed")
    shards = directory(marked.select("bits", "n_bytes"), limit)
    depths = [r[0] for r in shards.select(F.length("shard")).distinct().collect()]  # at most 129 values
    # each row's prefixes at the depths in use; exactly one of them is a shard
    at = marked.withColumn("shard", F.explode(F.array(*[F.substring("bits", 1, d) for d in sorted(depths)]))) if depths else marked.withColumn("shard", F.lit(""))
    sized = shards.select("shard", F.col("n_bytes").alias("shard_bytes"), F.col("n_docs").alias("shard_docs"))
    return at.join(sized, "shard").select(*keep, "n_bytes", "shard", "shard_bytes", "shard_docs")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; rows meet by shard, which the limit bounds."""
    named = sharded.withColumn("shard", F.concat(F.lit("s"), "shard"))
    named.repartition("shard").write.partitionBy("shard").parquet(path)
