"""Joins between events, sample sheet, labels and features (J and X rows).

No side is broadcast by hint. Catalyst broadcasts a side only when its known
size is under ``spark.sql.autoBroadcastJoinThreshold``; beyond it the join is
sort-merge, where AQE splits a sample that holds a large share of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import file_stem, is_filled, q, require_columns
from ..session import pin


def first_sheet_rows(sheet: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One sheet row per key (Q6): the first in ``order``."""
    ranked = Window.partitionBy(q(key)).orderBy(*[q(c) for c in order])
    return (
        sheet.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")
    )


def duplicate_sheet_rows(sheet: DataFrame, key: str = "file_name") -> DataFrame:
    """Q6: sheet keys (after :func:`file_stem`) that occur more than once."""
    stems = sheet.groupBy(file_stem(q(key)).alias(key)).agg(F.count(F.lit(1)).alias("n_rows"))
    return stems.filter("n_rows > 1")


def attach_sheet(events: DataFrame, sheet: DataFrame, key: str = "sample_id") -> DataFrame:
    """Left join on the sample id; where no sample matches at all, on the
    file name without its ending.

    On a name conflict the sheet's column wins, but the sample id stays.
    """
    require_columns(sheet, ["file_name"])
    stem = file_stem(q("file_name"))
    own_id = q(key).cast("string") if key in sheet.columns else stem
    prepared = sheet.select(
        own_id.alias("_id"),
        stem.alias("_stem"),
        *[(stem if c == "file_name" else q(c)).alias(c) for c in sheet.columns if c != key],
    )
    ids = events.select(q(key).cast("string").alias("_id")).distinct()
    matched = ids.join(prepared.select("_id"), "_id", "left_semi").agg(
        (F.count(F.lit(1)) > 0).alias("any")
    )
    link = F.when(F.col("_by_id"), F.col("_id")).otherwise(F.col("_stem"))
    linked = prepared.withColumn("_by_id", matched.scalar()).withColumn("_link", link)
    lookup = first_sheet_rows(linked, "_link", ["_stem", "_id"]).drop("_id", "_stem", "_by_id")
    taken = set(lookup.columns)
    kept = [c for c in events.columns if c == key or c not in taken]
    left = events.select(*[q(c) for c in kept], q(key).cast("string").alias("_link"))
    return left.join(lookup, "_link", "left").drop("_link")


def reattach_sheet(events: DataFrame, sheet: DataFrame, key: str = "file_name") -> DataFrame:
    """Left join of a saved table on the file name; the table's own columns
    win. File endings are ignored on both sides (Q13)."""
    taken = set(events.columns)
    side = sheet.select(
        file_stem(q(key)).alias("_link"), *[q(c) for c in sheet.columns if c not in taken]
    )
    side = first_sheet_rows(side, "_link", [c for c in side.columns if c != "_link"])
    left = events.withColumn("_link", file_stem(q(key)))
    return left.join(side, "_link", "left").drop("_link")


def lookup_features(
    events: DataFrame, features: DataFrame, key: Sequence[str], how: str = "left"
) -> DataFrame:
    """J3/J12 (left) and J4 (inner): features of each event by its row key."""
    taken = set(events.columns)
    side = features.select(
        *[q(k) for k in key], *[q(c) for c in features.columns if c not in taken]
    )
    return events.join(side, list(key), how)


def attach_labels(
    events: DataFrame, labels: DataFrame, key: Sequence[str], column: str = "cluster"
) -> DataFrame:
    """Cluster labels by row key."""
    return events.drop(column).join(
        labels.select(*[q(k) for k in key], q(column)), list(key), "left"
    )


def concat_variables(key: Sequence[str], *frames: DataFrame) -> DataFrame:
    """Columns of several tables side by side, matched on the row key."""
    names = [c for f in frames for c in f.columns if c not in key]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"Column(s) {clash} occur in more than one table.")
    return reduce(lambda a, b: a.join(b, list(key), "full_outer"), frames)


def pair_by_order(
    features: DataFrame,
    coordinates: DataFrame,
    group: str,
    feature_order: Sequence[str],
    coordinate_order: Sequence[str],
    seed: int = 42,
) -> DataFrame:
    """Pair each event with a coordinate of its sample by drawn position;
    when coordinates run short the last one repeats.

    Kept for comparison only: it breaks the link between event and coordinate.
    """
    from ..functions.columns import draw_order
    from .ordering import with_position

    def drawn(df: DataFrame, order: Sequence[str], seed: int, keep: Sequence[str]) -> DataFrame:
        # Half the text's bytes, in the same order.
        draw = F.unhex(draw_order(order, seed))
        return with_position(df.withColumn("_draw", draw), [group], ["_draw"], "_pos", keep=keep)

    left = drawn(features, feature_order, seed, features.columns)
    right = drawn(coordinates, coordinate_order, seed + 1, [group, "x", "y"])
    # Written, so that its size is known before the join.
    sizes = pin(right.groupBy(q(group)).agg(F.max("_pos").alias("_last")), "sizes")
    placed = left.join(sizes, group).withColumn("_pos", F.least("_pos", "_last")).drop("_last")
    return placed.join(right, [group, "_pos"]).drop("_pos")


def check_sheet(sheet: DataFrame, files: DataFrame, key: str = "file_name") -> DataFrame:
    """Every file stem with ``matched``, ``only in sheet`` or ``only in data``."""
    left = sheet.select(file_stem(q(key)).alias("stem"), F.lit(True).alias("_s")).distinct()
    right = files.select(file_stem(q(key)).alias("stem"), F.lit(True).alias("_f")).distinct()
    status = (
        F.when(F.col("_s").isNull(), "only in data")
        .when(F.col("_f").isNull(), "only in sheet")
        .otherwise("matched")
    )
    return left.join(right, "stem", "full_outer").select("stem", status.alias("status"))


def sample_groups(
    samples: DataFrame, sheet: DataFrame, group: str = "group", order: Sequence[str] = ()
) -> DataFrame:
    """Group of each sample from the first sheet row with its file name."""
    side = sheet.select(
        file_stem(q("file_name")).alias("sample_id"),
        F.trim(q(group).cast("string")).alias(group),
        *[q(c).alias(f"_o{i}") for i, c in enumerate(order)],
    )
    rank_by = [f"_o{i}" for i in range(len(order))] or [group]
    first = first_sheet_rows(side, "sample_id", rank_by).select("sample_id", group)
    return samples.join(first.filter(is_filled(q(group))), "sample_id")


def new_files(files: DataFrame, sheet: DataFrame, key: str = "file_name") -> DataFrame:
    """Stems of files that have no sheet row yet."""
    have = sheet.select(file_stem(q(key)).alias(key)).distinct()
    return files.select(file_stem(q(key)).alias(key)).distinct().join(have, key, "left_anti")


def auto_sample_rows(sheet: DataFrame, files: DataFrame, key: str = "file_name") -> DataFrame:
    """Sheet rows for new files, numbered on from the largest ``sample_<n>``.

    Nothing is added once any group has been filled in. The table of new files
    has one row per file.
    """
    from .ordering import with_position

    state = sheet.agg(
        F.struct(
            F.coalesce(
                F.max(F.regexp_extract("sample_id", r"^sample_(\d+)$", 1).try_cast("long")),
                F.lit(0),
            ).alias("top"),
            F.coalesce(F.bool_and(~is_filled(q("group"))), F.lit(True)).alias("auto"),
        ).alias("s")
    )
    fresh = with_position(new_files(files, sheet, key), [], [key], "_pos")
    named = fresh.withColumn("_s", state.scalar()).filter("_s.auto")
    number = F.col("_s.top") + F.col("_pos") + 1
    return named.select(
        q(key),
        F.concat(F.lit("sample_"), number.cast("string")).alias("sample_id"),
        F.lit("").alias("group"),
        F.lit("").alias("replicate"),
    )


def fill_sample_id(sheet: DataFrame) -> DataFrame:
    """A blank sample id takes the file name."""
    filled = F.when(is_filled(q("sample_id")), q("sample_id")).otherwise(q("file_name"))
    return sheet.withColumn("sample_id", filled)


def replace_values(df: DataFrame, column: str, mapping: Mapping[object, str]) -> DataFrame:
    """Replace every occurrence inside the text, one pair after another."""
    require_columns(df, [column])
    text: Column = q(column).cast("string")
    for old, new in mapping.items():
        text = F.replace(text, F.lit(str(old)), F.lit(new))
    return df.withColumn(column, text)


def map_values(df: DataFrame, column: str, mapping: Mapping[object, str]) -> DataFrame:
    """X1 for whole values only."""
    require_columns(df, [column])
    text = q(column).cast("string")
    pairs = [F.lit(v) for k, n in mapping.items() for v in (str(k), n)]
    return df.withColumn(column, F.coalesce(F.create_map(*pairs)[text], text) if pairs else text)
