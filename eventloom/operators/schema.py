"""Projections and column-level operators (P rows) and the union."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_header, numeric_columns, q, require_columns
from .ordering import with_position

#: A feature whose name contains one of these is left out at first.
EXCLUDED_NAME_PARTS = (
    "intensity",
    "Intensity",
    "saturation",
    "Saturation",
    "Raw pixel",
    "Bkgd",
    "All",
    "Mean Pixel",
    "Max Pixel",
    "Median Pixel",
    "Raw",
    "Time",
    "Object Number",
    "Flow Speed",
)


def normalise_header(df: DataFrame) -> DataFrame:
    """Trimmed names with blanks, ``&``, ``+`` and ``-`` spelled out."""
    names = [clean_header(c) for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"Header names collide after normalising: {clash}")
    return df.toDF(*names)


def rename_variables(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename all given columns, or none when one is missing."""
    missing = [c for c in mapping if c not in df.columns]
    if missing:
        print(f"The following columns do not exist: {missing}")
        return df
    return df.select(*[q(c).alias(mapping.get(c, c)) for c in df.columns])


def drop_variables(df: DataFrame, *labels: str) -> DataFrame:
    """P3."""
    require_columns(df, labels)
    return df.select(*[q(c) for c in df.columns if c not in labels])


def save_feature(df: DataFrame, *features: str) -> DataFrame:
    """P4."""
    require_columns(df, features)
    return df.select(*[q(c) for c in features])


def add_metadata(df: DataFrame, label: str, value: object) -> DataFrame:
    """P5: one constant for every row. A per-row list is a table: see
    :func:`add_metadata_rows`."""
    if not df.columns or df.isEmpty():
        raise ValueError("Dataframe is empty.")
    return df.withColumn(label, value if isinstance(value, Column) else F.lit(value))


def add_metadata_rows(
    df: DataFrame, values: DataFrame, key: Sequence[str], label: str
) -> DataFrame:
    """P5 with one value per row, matched on the row key."""
    if not df.columns or df.isEmpty():
        raise ValueError("Dataframe is empty.")
    return df.join(values.select(*[q(k) for k in key], q(label)), list(key), "left")


def weighted_features(df: DataFrame, features: Sequence[str], weight: float) -> DataFrame:
    """P7."""
    require_columns(df, features)
    chosen = set(features)
    return df.select(*[(q(c) * weight).alias(c) if c in chosen else q(c) for c in df.columns])


def add_index(df: DataFrame, order: Sequence[str], name: str = "Index") -> DataFrame:
    """0..n-1 over the whole table in the given order."""
    return with_position(df, [], order, name)


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` by table position."""
    if first not in df.columns:
        raise ValueError(f"First column '{first}' does not exist.")
    if last not in df.columns:
        raise ValueError(f"Last column '{last}' does not exist.")
    lo, hi = df.columns.index(first), df.columns.index(last)
    if lo > hi:
        raise ValueError(f"First column '{first}' is after last column '{last}'.")
    return df.columns[lo : hi + 1]


def chosen_columns(
    df: DataFrame, first: str | None, last: str | None, numeric_only: bool
) -> list[str]:
    """Columns a scaler works on: a range, or the default when a bound is absent."""
    if first is not None and last is not None:
        return column_range(df, first, last)
    return numeric_columns(df) if numeric_only else list(df.columns)


def feature_catalogue(columns: DataFrame, populations: DataFrame) -> DataFrame:
    """Features over all files with the number of files that carry each.

    ``columns(file, feature)`` and ``populations(population)`` describe the
    files; gate columns and ``sample_id`` are not features.
    """
    kept = columns.filter(q("feature") != "sample_id").join(
        populations.select(q("population").alias("feature")).distinct(), "feature", "left_anti"
    )
    files = columns.agg(F.count_distinct("file").alias("n")).scalar()
    counted = kept.groupBy("feature").agg(F.count_distinct("file").alias("n_files"))
    return counted.withColumn("in_all_files", F.col("n_files") == files)


def excluded_by_default(name: Column) -> Column:
    """P10: predicate on feature names."""
    return reduce(lambda a, b: a | b, [F.contains(name, F.lit(p)) for p in EXCLUDED_NAME_PARTS])


def excluded_by_channel(name: Column, channels: Sequence[str]) -> Column:
    """Features that belong to a switched-off channel or its mask."""
    if not channels:
        return F.lit(False)
    parts = [p for ch in channels for p in (ch, "M" + ch.removeprefix("Ch"))]
    any_part = "|".join(re.escape(p) for p in parts)
    return name.rlike(rf"[_(]({any_part})|({any_part})$")


def feature_selection(
    catalogue: DataFrame, channels: Sequence[str] = (), column: str = "feature"
) -> DataFrame:
    """P10 + P11 on a catalogue table: add ``included``."""
    off = excluded_by_default(q(column)) | excluded_by_channel(q(column), channels)
    return catalogue.withColumn("included", ~off)


def import_feature_list(sheet: DataFrame, catalogue: DataFrame, column: str) -> DataFrame:
    """Read a list of feature names and mark those that are available.

    A header is matched in any case. A sheet of one row holds the list in one
    cell, separated by commas or line breaks; otherwise each row is a name.
    """
    found = [c for c in sheet.columns if c.lower() == column.lower()]
    if not found:
        raise ValueError(f"Column '{column}' does not exist.")
    cell = q(found[0]).cast("string")
    single = sheet.agg((F.count(F.lit(1)) == 1).alias("one")).scalar()
    parts = F.when(single, F.split(cell, r"[,\n]")).otherwise(F.array(cell))
    names = (
        sheet.filter(cell.isNotNull())
        .select(F.explode(parts).alias("feature"))
        .select(F.trim("feature").alias("feature"))
        .filter("feature <> ''")
        .distinct()
    )
    known = catalogue.select("feature").distinct().withColumn("_known", F.lit(True))
    return names.join(known, "feature", "left").select(
        "feature", F.coalesce("_known", F.lit(False)).alias("available")
    )


def accepted_features(imported: DataFrame) -> DataFrame:
    """The available names; an error when there is none."""
    good = imported.filter("available").select("feature")
    if good.isEmpty():
        raise ValueError("None of the listed features is available.")
    return good


def concat_df(
    *frames: DataFrame,
    join: str = "inner",
    index_order: Sequence[str] | None = None,
    index_name: str = "Index",
) -> DataFrame:
    """Stack tables on their common columns, or on all of them."""
    if join not in ("inner", "outer"):
        raise ValueError("join must be 'inner' or 'outer'")
    if join == "inner":
        common = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
        frames = tuple(f.select(*[q(c) for c in common]) for f in frames)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return with_position(out, [], index_order, index_name) if index_order else out


def stack_importance(by_x: DataFrame, by_y: DataFrame) -> DataFrame:
    """U4: importance of both coordinates in one table."""
    return by_x.withColumn("dimension", F.lit("X")).unionByName(
        by_y.withColumn("dimension", F.lit("Y"))
    )
