"""Positions, running totals and per-group samples that hold under skew.

A window over one sample would put that sample into one task. Positions are
therefore taken from a range-partitioned sort: rows are numbered inside their
partition, and a table with one row per (partition, group) supplies the offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import draw_order, q
from ..session import pin

_SLOT_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Give a small table one partition per core before work that is bound by
    the processor.

    Decided on Catalyst's size estimate, without running anything: a table that
    fills the cores with input splits keeps its partitions and is not shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df


def _range_sorted(
    df: DataFrame, group: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None
) -> DataFrame:
    # The arrival number splits runs of identical keys over several partitions.
    keyed = df.withColumn("_arrival", F.monotonically_increasing_id())
    keys = [q(c) for c in (*group, *order)] + [F.col("_arrival")]
    placed = (
        keyed.repartitionByRange(shuffle_width(df.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .drop("_arrival")
        .withColumn("_row", F.monotonically_increasing_id())
    )
    if keep is not None:
        placed = placed.select(*[q(c) for c in keep], "_row")
    # Range bounds differ between executions, so the order is written once.
    return pin(placed, "sorted").withColumn("_slot", F.shiftright("_row", _SLOT_BITS))


def _offsets(spans: DataFrame, group: Sequence[str], amount: str) -> DataFrame:
    """Total of ``amount`` in the group's earlier slots; at most one row per
    (slot, group), so the window stays small for any group.

    Written, so that Catalyst knows its size: planned blind, the join with it would
    shuffle all rows once more.
    """
    before = (
        Window.partitionBy(*[q(c) for c in group])
        .orderBy("_slot")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return pin(spans.withColumn("_before", F.coalesce(F.sum(amount).over(before), F.lit(0))).drop(amount), "offsets")


def with_position(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "cell_index",
    *, keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add a dense 0-based position per ``group`` in ``order``.

    An empty ``group`` numbers the whole table. ``keep`` names the columns to return, the
    group among them, where those that only order are not needed.
    """
    keep = df.columns if keep is None else list(keep)
    placed = _range_sorted(df, group, order, keep)
    spans = placed.groupBy("_slot", *[q(c) for c in group]).agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    offsets = _offsets(spans, group, "_n")
    joined = placed.join(offsets, ["_slot", *group])
    position = (F.col("_row") - F.col("_first") + F.col("_before")).cast("long")
    return joined.select(*[q(c) for c in keep], position.alias(name))


def with_running_total(
    df: DataFrame, group: Sequence[str], order: Sequence[str], amount: str, name: str
) -> DataFrame:
    """Add the total of ``amount`` over the rows before this one in its group."""
    placed = _range_sorted(df, group, order)
    inside = (
        Window.partitionBy("_slot", *[q(c) for c in group])
        .orderBy("_row")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = placed.withColumn("_local", F.coalesce(F.sum(q(amount)).over(inside), F.lit(0)))
    spans = placed.groupBy("_slot", *[q(c) for c in group]).agg(F.sum(q(amount)).alias("_n"))
    offsets = _offsets(spans, group, "_n")
    joined = local.join(offsets, ["_slot", *group])
    return joined.select(
        *[q(c) for c in df.columns], (F.col("_local") + F.col("_before")).alias(name)
    )


def first_n(
    df: DataFrame, group: Sequence[str], order: Column, n: int, *, wide: bool | None = None
) -> DataFrame:
    """The ``n`` rows of each group that come first in ``order``, exactly.

    Small ``n``: a salted cut (each map task and each salt keeps ``n`` rows)
    followed by the final cut. Large ``n``: positions from the range sort.
    """
    spark = df.sparkSession
    if wide is None:
        wide = n > int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    columns = [q(c) for c in df.columns]
    drawn = df.withColumn("_order", order)
    if wide:
        placed = with_position(drawn, group, ["_order"], "_position", keep=df.columns)
        return placed.filter(F.col("_position") < n).select(*columns)
    keys = [q(c) for c in group]
    salted = drawn.withColumn("_salt", F.pmod(F.xxhash64("_order"), F.lit(shuffle_width(spark))))
    per_salt = Window.partitionBy(*keys, "_salt").orderBy("_order")
    cut = salted.withColumn("_rank", F.row_number().over(per_salt)).filter(F.col("_rank") <= n)
    cut = cut.drop("_rank", "_salt")
    if not keys:
        return cut.orderBy("_order").limit(n).select(*columns)
    per_group = Window.partitionBy(*keys).orderBy("_order")
    return (
        cut.withColumn("_rank", F.row_number().over(per_group))
        .filter(F.col("_rank") <= n)
        .select(*columns)
    )


def select_events(df: DataFrame, n: int, keys: Sequence[str], seed: int = 1) -> DataFrame:
    """L1: exactly ``n`` rows without replacement, in key order."""
    total = df.count()
    if n > total:
        raise ValueError(
            f"Number of events '{n}' is larger than the number of rows ({total})."
        )
    return first_n(df, [], draw_order(keys, seed), n).orderBy(*[q(k) for k in keys])


def cap_per_group(
    df: DataFrame, group: Sequence[str], keys: Sequence[str], n: int, seed: int = 42
) -> DataFrame:
    """At most ``n`` rows per group; 0 keeps all."""
    if n <= 0:
        return df
    return first_n(df, group, draw_order(keys, seed), n)


def cap_report(df: DataFrame, group: str, n: int) -> DataFrame:
    """L2: groups that a cap of ``n`` shortens, with their full size."""
    sizes = df.groupBy(q(group)).agg(F.count(F.lit(1)).alias("n_before"))
    return sizes.filter(F.lit(n > 0) & (F.col("n_before") > n)).withColumn(
        "n_after", F.lit(n).cast("long")
    )


#: Fixed values of the adaptive cap: value budget, lower and upper bound.
VALUE_BUDGET = 10_000
CAP_LOWEST, CAP_HIGHEST = 50, 200


def adaptive_cap(n_features: int) -> int:
    """L3: rows per sample so that rows x features stays near the budget."""
    if n_features < 1:
        raise ValueError("At least one feature is needed.")
    return max(CAP_LOWEST, min(CAP_HIGHEST, VALUE_BUDGET // n_features))


def cap_total(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """L4: at most ``n`` rows of the whole table."""
    return first_n(df, [], draw_order(keys, seed), n)


def sorted_listing(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Distinct non-null values of a column, sorted."""
    values = df.select(q(column).alias(column)).filter(q(column).isNotNull()).distinct()
    return values.orderBy(q(column).desc() if descending else q(column).asc())
