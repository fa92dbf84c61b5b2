"""Run manifests (S9, S10): an append-only table of updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FILE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("original_path", T.StringType()),
        T.StructField("size", T.LongType()),
    ]
)
_TEXT_MAP = T.MapType(T.StringType(), T.StringType())
_STEP = T.StructType([T.StructField("method", T.StringType()), T.StructField("params", _TEXT_MAP)])

#: One row per update of a run.
RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("project_dir", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("daf_files", T.ArrayType(_FILE)),
        T.StructField("dimensionality_reduction", _STEP),
        T.StructField("clustering", _STEP),
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("population", T.StringType()),
    ]
)

#: Fixed value: update times keep their microseconds.
_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

#: Sections where the latest value counts, and those that keep their first one.
LATEST = ("project_dir", "daf_files", "dimensionality_reduction", "clustering")
FIRST = ("features", "population")


def append_updates(updates: DataFrame, path: str) -> None:
    """Add updates; sections not touched stay null."""
    updates.write.mode("append").option("timestampFormat", _TIME_FORMAT).json(path)


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).option("timestampFormat", _TIME_FORMAT).json(path)


def current_runs(updates: DataFrame) -> DataFrame:
    """State of every run after all its updates.

    Aggregates by time instead of sorting: a run's history is folded before
    the shuffle.
    """

    def at(name: str, pick) -> Column:
        return pick(name, F.when(F.col(name).isNotNull(), F.col("timestamp"))).alias(name)

    present = [c for c in updates.columns if c in LATEST]
    fixed = [c for c in updates.columns if c in FIRST]
    merged = updates.groupBy("run_id").agg(
        F.max("timestamp").alias("timestamp"),
        *[at(c, F.max_by) for c in present],
        *[at(c, F.min_by) for c in fixed],
    )
    if "features" in fixed:
        merged = merged.withColumn("features_count", F.coalesce(F.array_size("features"), F.lit(0)))
    if "daf_files" in present:
        merged = merged.withColumn("daf_files_count", F.coalesce(F.array_size("daf_files"), F.lit(0)))
    return merged


def run_catalogue(runs: DataFrame) -> DataFrame:
    """Run listing, newest name first, with defaults for what is absent."""
    return runs.select(
        "run_id",
        F.coalesce("dimensionality_reduction.method", F.lit("Unknown")).alias("method"),
        F.coalesce(F.array_size("daf_files"), F.lit(0)).alias("n_files"),
        F.when(F.col("clustering.method").isNotNull(), "Yes").otherwise("No").alias("clustering"),
        F.coalesce(F.date_format("timestamp", "yyyy-MM-dd"), F.lit("Unknown")).alias("date"),
    ).orderBy(F.desc("run_id"))


def read_manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """Manifests kept as one JSON document per run."""
    return spark.read.schema(RUN_SCHEMA).option("multiLine", True).json(pattern)
