"""Row filters and population gates (F rows)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    cluster_label,
    finite_or_null,
    is_filled,
    numeric_columns,
    q,
    require_columns,
)


def select_condition(df: DataFrame, column: str, value: object) -> DataFrame:
    """rows where ``column`` equals ``value``; both must exist."""
    if column not in df.columns:
        raise ValueError(f"Column '{column}' does not exist.")
    hit = df.filter(q(column) == F.lit(value))
    if hit.isEmpty():
        raise ValueError(f"Value '{value}' does not exist in column '{column}'.")
    return hit


def is_member(df: DataFrame, gate: str) -> Column:
    """True where a boolean gate is set or a numeric gate equals 1."""
    kind = df.schema[gate].dataType
    hit = q(gate) if isinstance(kind, T.BooleanType) else q(gate).cast("double") == 1.0
    return F.coalesce(hit, F.lit(False))


def population_gate(
    df: DataFrame, gate: str, file_has_gate: Column | None = None, sample: str = "sample_id"
) -> DataFrame:
    """keep gated events; files without the gate keep all their events.

    ``file_has_gate`` tells per row whether its file carries the column. Absent,
    a sample carries it if any of its events has a value there; a table without
    a ``sample`` column counts as one file that does.
    """
    if gate not in df.columns:
        return df
    keep = is_member(df, gate)
    if file_has_gate is not None:
        return df.filter(keep | ~file_has_gate)
    if sample not in df.columns:
        return df.filter(keep)
    has = df.groupBy(q(sample).alias("_gated")).agg(F.bool_or(q(gate).isNotNull()).alias("_has_gate"))
    joined = df.join(has, q(sample).eqNullSafe(F.col("_gated")))
    return joined.filter(keep | ~F.col("_has_gate")).select(*[q(c) for c in df.columns])


def gate_report(df: DataFrame, gate: str, file_has_gate: Column, sample: str = "sample_id"):
    """per sample, what the gate did to it."""
    counts = df.groupBy(q(sample)).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(is_member(df, gate) | ~file_has_gate).alias("n_kept"),
        F.bool_and(file_has_gate).alias("has_gate"),
    )
    note = (
        F.when(~F.col("has_gate"), "gate absent - all events kept")
        .when(F.col("n_kept") == 0, "skipped - no events after gate")
        .otherwise("gated")
    )
    return counts.withColumn("note", note)


def drop_events(df: DataFrame, first: int, last: int, index: str = "Index") -> DataFrame:
    """drop index values ``first``..``last``; both must exist."""
    seen = df.agg(
        F.count_if(q(index) == first).alias("first"), F.count_if(q(index) == last).alias("last")
    ).first()
    if not seen["first"]:
        raise ValueError(f"No event has the index {first} at which dropping starts.")
    if not seen["last"]:
        raise ValueError(f"No event has the index {last} at which dropping ends.")
    if first > last:
        raise ValueError(f"Events are dropped upwards, but {first} lies above {last}.")
    return df.filter(~q(index).between(first, last))


def missing_features(file_columns: DataFrame, features: Sequence[str]) -> DataFrame:
    """files that lack a wanted feature, with the missing names.

    ``file_columns(file, feature)`` has one row per file and column. Only the
    wanted names are gathered, so an array never exceeds the request.
    """
    wanted = F.array(*[F.lit(f) for f in features])
    present = file_columns.groupBy("file").agg(
        F.collect_set(F.when(q("feature").isin(list(features)), q("feature"))).alias("present")
    )
    return present.select(
        "file", F.array_sort(F.array_except(wanted, "present")).alias("missing")
    ).filter(F.size("missing") > 0)


def id_list(texts: DataFrame, column: str) -> DataFrame:
    """ids of texts such as ``"100, 200"`` or ``"1-10"``."""
    parts = texts.select(F.explode(F.split(q(column), ",")).alias("part"))
    pieces = parts.select(F.trim("part").alias("part")).filter("part <> ''")
    low = F.regexp_extract("part", r"^(\d+)(?:\s*-\s*(\d+))?$", 1).try_cast("long")
    high = F.regexp_extract("part", r"^(\d+)(?:\s*-\s*(\d+))?$", 2).try_cast("long")
    bounds = pieces.select(low.alias("low"), F.coalesce(high, low).alias("high"))
    ordered = bounds.filter("low is not null and low <= high")
    return ordered.select(F.explode(F.sequence("low", "high")).alias("id")).distinct()


def find_cells(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows with a listed id, and the ids without a row."""
    wanted = ids.select(q("id").alias(key)).distinct()
    return df.join(wanted, key, "left_semi"), wanted.join(df.select(q(key)), key, "left_anti")


def value_window(
    df: DataFrame,
    x: tuple[float | None, float | None] = (None, None),
    y: tuple[float | None, float | None] = (None, None),
    columns: tuple[str, str] = ("x", "y"),
) -> DataFrame:
    """optional inclusive bounds on both coordinates."""
    tests = []
    for name, (low, high) in zip(columns, (x, y)):
        if low is not None:
            tests.append(q(name) >= low)
        if high is not None:
            tests.append(q(name) <= high)
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def with_group(df: DataFrame, group: str = "group") -> DataFrame:
    """rows whose group is neither null nor blank."""
    return df.filter(F.trim(q(group).cast("string")) != "")


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F8: turn ±Inf and NaN of ``columns`` into null, then drop such rows."""
    require_columns(df, columns)
    chosen = set(columns)
    cleaned = df.select(
        *[finite_or_null(q(c).cast("double")).alias(c) if c in chosen else q(c) for c in df.columns]
    )
    return cleaned.filter(reduce(lambda a, b: a & b, [q(c).isNotNull() for c in columns]))


def with_validity(df: DataFrame, column: str, name: str = "is_valid") -> DataFrame:
    """mark filled values; null, blank and ``nan`` are not."""
    return df.withColumn(name, is_filled(q(column)))


def blank_sample_ids(df: DataFrame, column: str = "sample_id") -> DataFrame:
    """number of rows and of blank sample ids."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~is_filled(q(column))).alias("n_blank")
    )


def keep_clusters(df: DataFrame, clusters: Sequence[object], column: str = "cluster") -> DataFrame:
    """F11."""
    return df.filter(q(column).isin(list(clusters)))


def labelled(df: DataFrame, column: str = "cluster") -> DataFrame:
    """X3 in place."""
    return df.withColumn(column, cluster_label(q(column)))


#: The least rows, features and groups an analysis accepts.
LEAST_ROWS, LEAST_FEATURES, LEAST_GROUPS = 100, 2, 2


def guard_counts(
    df: DataFrame, features: Sequence[str] | None = None, group: str | None = None
) -> DataFrame:
    """the counts the guards look at, and whether they pass."""
    names = numeric_columns(df) if features is None else list(features)
    n_groups = F.count_distinct(q(group)) if group else F.lit(None).cast("long")
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), n_groups.alias("n_groups")).withColumn(
        "n_features", F.lit(len(names)).cast("long")
    )
    enough = (F.col("n_rows") >= LEAST_ROWS) & (F.col("n_features") >= LEAST_FEATURES)
    if group:
        enough &= F.col("n_groups") >= LEAST_GROUPS
    return counts.withColumn("passes", enough)


def require_counts(
    df: DataFrame, features: Sequence[str] | None = None, group: str | None = None
) -> DataFrame:
    """raise unless there are enough rows, features and groups."""
    found = guard_counts(df, features, group).first()
    if not found["passes"]:
        raise ValueError(f"Not enough data: {found.asDict()}")
    return df
