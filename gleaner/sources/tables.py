"""Reading and publishing tables and state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import JSON_NAMES, OPPORTUNITY


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _json_schema() -> T.StructType:
    return T.StructType([T.StructField(JSON_NAMES.get(f.name, f.name), f.dataType) for f in OPPORTUNITY.fields])


def read_category(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """Records of a JSON array file or a folder of JSON lines; absent or corrupt gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], OPPORTUNITY)
    raw = (spark.read.schema(_json_schema().add("_corrupt", "string")).option("multiLine", path.endswith(".json"))
           .option("columnNameOfCorruptRecord", "_corrupt").json(path))
    out = raw.where(F.col("_corrupt").isNull()).select([F.col(JSON_NAMES.get(f.name, f.name)).alias(f.name) for f in OPPORTUNITY.fields])
    return out.withColumn("category", F.lit(category)) if category else out


def write_category(df: DataFrame, path: str) -> None:
    """Replace the categories that occur in ``df`` and leave the others alone."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("category").parquet(path))


def publish(df: DataFrame, root: str, version: str) -> str:
    """Write a new version folder, then point to it.

    Readers follow the pointer, so a crash at any time leaves the previous
    version in place.  A version that exists is not written again.
    """
    spark = df.sparkSession
    target = f"{root}/v-{version}"
    if not exists(spark, f"{target}/_SUCCESS"):
        df.write.mode("overwrite").parquet(target)
    _point(spark, root, version)
    return target


def _point(spark: SparkSession, root: str, version: str) -> None:
    fs, _ = _fs(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    draft = path(f"{root}/.pointer-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    # one rename that overwrites: readers see the old pointer or the new one, never none
    jvm = spark._jvm
    option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    overwrite = spark.sparkContext._gateway.new_array(option, 1)
    overwrite[0] = option.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(draft), context.makeQualified(path(f"{root}/_CURRENT")), overwrite)


def current_version(spark: SparkSession, root: str) -> str | None:
    """Published version; without a pointer the newest complete one."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(path(f"{root}/_CURRENT")):
        stream = fs.open(path(f"{root}/_CURRENT"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
    done = [s.getPath().getName()[2:] for s in fs.listStatus(p)
            if s.getPath().getName().startswith("v-") and fs.exists(path(s.getPath(), "_SUCCESS"))]
    return max(done, default=None)


def read_state(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The published version, or an empty table to start fresh."""
    version = current_version(spark, root)
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{root}/v-{version}")


def state_meta(df: DataFrame, now: str) -> DataFrame:
    """What a saved state says about itself."""
    return df.agg(F.count("*").alias("record_count")).withColumn("version", F.lit(2)).withColumn("updated_at", F.lit(now))


# One code path serves both state tables.
write_state = publish
