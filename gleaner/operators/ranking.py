"""Row numbers over whole tables without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize


def numbered(df: DataFrame, name: str = "number", *order: Column | str) -> DataFrame:
    """Number rows 1..n in the given order (by default ``seq``), which must not tie.

    The rows are range-partitioned and sorted once; a row's number is its place
    in its partition plus the sizes of the partitions before, of which there
    are as many as shuffle partitions.
    """
    ordered = df.orderBy(*(order or ("seq",))).withColumn("_place", F.monotonically_increasing_id())
    ordered = materialize(ordered, "numbered")
    part, local = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(name, (local + F.col("_offset") + 1).cast("bigint")).drop("_place", "_part", "_offset"))
