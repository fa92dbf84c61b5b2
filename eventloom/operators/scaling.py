"""Feature scaling (N rows).

Statistics come from one aggregate over all columns. It enters the second pass
as a one-row scalar subquery, so a scaler stays lazy and never joins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import draw_order, finite_or_null, nan_to_null, q, quoted
from ..session import pin
from .ordering import first_n, spread, with_running_total
from .schema import chosen_columns

_STAT = "_stat"


def _number(name: str) -> Column:
    return nan_to_null(q(name).cast("double"))


def _with_stats(df: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    packed = df.agg(F.struct(*[a.alias(n) for n, a in aggregates.items()]).alias("s"))
    return df.withColumn(_STAT, packed.scalar())


def _rewritten(df: DataFrame, replaced: dict[str, Column], columns: Sequence[str]) -> DataFrame:
    return df.select(*[replaced[c].alias(c) if c in replaced else q(c) for c in columns])


def _stat(kind: str, i: int) -> Column:
    return F.col(f"{_STAT}.{kind}{i}")


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    aggregates = {}
    for i, c in enumerate(columns):
        aggregates[f"m{i}"] = F.avg(_number(c))
        aggregates[f"d{i}"] = F.stddev_pop(_number(c))
    wide = _with_stats(df, aggregates)
    scaled = {
        c: (_number(c) - _stat("m", i)) / F.when(_stat("d", i) > 0, _stat("d", i)).otherwise(1.0)
        for i, c in enumerate(columns)
    }
    return _rewritten(wide, scaled, df.columns)


def stand_scaler(df: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """N1 on a column range, by default on all numeric columns."""
    if not df.columns or df.isEmpty():
        raise ValueError("DataFrame is empty or not set.")
    columns = chosen_columns(df, first, last, numeric_only=True)
    if not columns:
        raise ValueError("No numeric data found to scale.")
    return standardise(df, columns)


def minmax_norm(df: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes null."""
    columns = chosen_columns(df, first, last, numeric_only=False)
    aggregates = {}
    for i, c in enumerate(columns):
        aggregates[f"lo{i}"] = F.min(_number(c))
        aggregates[f"hi{i}"] = F.max(_number(c))
    wide = _with_stats(df, aggregates)
    scaled = {
        c: F.try_divide(_number(c) - _stat("lo", i), _stat("hi", i) - _stat("lo", i))
        for i, c in enumerate(columns)
    }
    return _rewritten(wide, scaled, df.columns)


#: Fixed value: most landmarks a quantile map uses.
LANDMARKS = 1000


def quantile_landmarks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact quantiles per column, ``(feature, landmarks array)``.

    Values are counted first, so repeated values collapse before the sort.
    Each counted value reports the landmark ranks it covers; at most
    ``LANDMARKS`` pairs per feature remain.
    """
    long = df.select(*[_number(c).alias(c) for c in columns]).unpivot(
        [], [quoted(c) for c in columns], "feature", "value"
    )
    counts = (
        long.filter(q("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = with_running_total(counts, ["feature"], ["value"], "n", "start")
    totals = ranked.groupBy("feature").agg(F.sum("n").alias("total"))
    placed = ranked.join(totals, "feature").withColumn(
        "last", F.least(F.col("total"), F.lit(LANDMARKS)) - 1
    )
    # Landmark j sits at j * (total - 1) / last: whole part and remainder.
    span = F.col("total") - 1
    end = F.col("start") + F.col("n")

    def first_at(rank: Column, ceil: bool) -> Column:
        """Smallest j whose lower (or upper) rank is at least ``rank``."""
        if ceil:
            return F.when(rank <= 0, F.lit(0)).otherwise(
                F.expr("0") + F.floor((rank - 1) * F.col("last") / F.greatest(span, F.lit(1))) + 1
            )
        return F.when(rank <= 0, F.lit(0)).otherwise(
            F.ceil(rank * F.col("last") / F.greatest(span, F.lit(1)))
        )

    # Float division may misplace a landmark by one, so candidates are widened
    # and checked with integer arithmetic.
    j_low = F.greatest(first_at(F.col("start"), True) - 2, F.lit(0)).cast("long")
    j_high = F.least(first_at(end, False) + 2, F.col("last")).cast("long")
    candidates = placed.filter(j_low <= j_high).select(
        "feature", "value", "start", end.alias("end"), "last", span.alias("span"),
        F.explode(F.sequence(j_low, j_high)).alias("j"),
    )
    product = F.col("j") * F.col("span")
    whole = F.when(F.col("last") > 0, F.expr("(j * span) div greatest(last, 1)")).otherwise(F.lit(0))
    rest = product - whole * F.col("last")
    checked = candidates.select(
        "feature", "value", "j", "last", whole.alias("lo"), rest.alias("rest"), "start", "end"
    ).withColumn("hi", F.col("lo") + F.when(F.col("rest") > 0, 1).otherwise(0))

    def covers(rank: str) -> Column:
        return (F.col("start") <= F.col(rank)) & (F.col(rank) < F.col("end"))

    ends = checked.groupBy("feature", "j").agg(
        F.max(F.when(covers("lo"), F.col("value"))).alias("low"),
        F.max(F.when(covers("hi"), F.col("value"))).alias("high"),
        F.max(F.col("rest") / F.greatest("last", F.lit(1))).alias("share"),
    )
    exact = ends.filter("low is not null").select(
        "feature",
        F.struct("j", (F.col("low") + F.col("share") * (F.col("high") - F.col("low"))).alias("v")).alias("p"),
    )
    return exact.groupBy("feature").agg(
        F.transform(F.array_sort(F.collect_list("p")), lambda p: p["v"]).alias("landmarks")
    )


def _value_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(``feature``, ``value``, ``rank``): the mean 0-based rank of each value over the
    number of values less one; 0 for the value of a column that has but one."""
    long = df.select(*[_number(c).alias(c) for c in columns]).unpivot([], [quoted(c) for c in columns], "feature", "value")
    counts = long.where(q("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = with_running_total(counts, ["feature"], ["value"], "n", "start")
    totals = ranked.groupBy("feature").agg(F.sum("n").alias("total"))
    middle = (2 * F.col("start") + F.col("n") - 1) / 2
    rank = F.coalesce(F.try_divide(middle, F.col("total") - 1), F.lit(0.0))
    return ranked.join(totals, "feature").select("feature", "value", rank.alias("rank"))


def _rank_scaled(df: DataFrame, source: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns replaced by the exact ranks of their values, joined back by value."""
    ranks = pin(_value_ranks(source, columns), "ranks")
    out = df
    for i, c in enumerate(columns):
        own = ranks.where(F.col("feature") == c).select(F.col("value").alias(f"_value{i}"), F.col("rank").alias(f"_rank{i}"))
        out = out.join(own, _number(c) == F.col(f"_value{i}"), "left")
    place = {c: i for i, c in enumerate(columns)}
    return out.select(*[F.col(f"_rank{place[c]}").alias(c) if c in place else q(c) for c in df.columns])


#: A sketched quantile is off by one in so many ranks at most.
SKETCH_ACCURACY = 10_000


def _sketched_landmarks(df: DataFrame, columns: Sequence[str]) -> dict[str, np.ndarray]:
    """Approximate quantiles of all columns from one aggregate of mergeable sketches, after one of counts."""
    counts = df.agg(*[F.count(_number(c)).alias(str(i)) for i, c in enumerate(columns)]).first()
    sketches = {}
    for i, c in enumerate(columns):
        last = min(counts[i], LANDMARKS) - 1
        shares = [j / last for j in range(last + 1)] if last > 0 else [0.0]
        sketches[c] = F.percentile_approx(_number(c), shares, SKETCH_ACCURACY).alias(str(i))
    found = df.agg(*sketches.values()).first()
    return {c: np.asarray(found[i], dtype=float) for i, c in enumerate(columns) if found[i]}


#: How the empirical quantiles of a column are found.
MODES = ("landmarks", "rank", "sketch")


def quant_scaler(
    df: DataFrame,
    first: str | None = None,
    last: str | None = None,
    subsample: int | None = None,
    keys: Sequence[str] = (),
    mode: str = "landmarks",
) -> DataFrame:
    """Map columns to [0, 1] by their empirical quantiles.

    ``mode``: ``landmarks`` interpolates between ``LANDMARKS`` exact quantiles, ``rank``
    takes the exact mean rank of each value, and ``sketch`` interpolates between quantiles
    that are off by a ``SKETCH_ACCURACY``-th of the rows at most, from one sketch for each
    column. ``subsample`` estimates the quantiles on that many reproducibly drawn rows
    (identified by ``keys``), except for ranks; by default all rows count. Values that are
    missing or not numbers become null.
    """
    if mode not in MODES:
        raise ValueError(f"Quantiles are found by one of {MODES}.")
    if mode == "rank" and subsample:
        raise ValueError("Ranks take all rows; a subsample lacks some of the values.")
    columns = chosen_columns(df, first, last, numeric_only=False)
    source = df
    if subsample:
        source = first_n(df, [], draw_order(keys, 0), subsample)
    if mode == "rank":
        return _rank_scaled(df, source, columns)
    # Bounded: columns x LANDMARKS numbers.
    if mode == "sketch":
        found = _sketched_landmarks(source, columns)
    else:
        found = {
            r["feature"]: np.asarray(r["landmarks"], dtype=float)
            for r in quantile_landmarks(source, columns).toLocalIterator()
        }

    def rescale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(batch.columns)
            for c in columns:
                at = batch.schema.get_field_index(c)
                x = out[at].to_numpy(zero_copy_only=False).astype(float)
                grid = found.get(c)
                if grid is None:
                    out[at] = pa.nulls(len(x), pa.float64())
                    continue
                refs = np.linspace(0.0, 1.0, len(grid)) if len(grid) > 1 else np.zeros(1)
                # Both directions, so that ties land in the middle of their range.
                up = np.interp(x, grid, refs)
                down = np.interp(-x, -grid[::-1], -refs[::-1])
                out[at] = pa.array(0.5 * (up - down), mask=np.isnan(x))
            yield pa.RecordBatch.from_arrays(out, names=batch.schema.names)

    types = [
        T.StructField(f.name, T.DoubleType() if f.name in set(columns) else f.dataType)
        for f in df.schema.fields
    ]
    return spread(df).mapInArrow(rescale, T.StructType(types))


def clip_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, width: float = 10.0
) -> DataFrame:
    """Limit float columns to mean ± ``width`` sample deviations."""
    floats = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in ("x", "y")
    ]
    columns = floats if columns is None else list(columns)
    aggregates = {}
    for i, c in enumerate(columns):
        aggregates[f"m{i}"] = F.avg(_number(c))
        aggregates[f"d{i}"] = F.stddev_samp(_number(c))
    wide = _with_stats(df, aggregates)
    clipped = {}
    for i, c in enumerate(columns):
        low = _stat("m", i) - width * _stat("d", i)
        high = _stat("m", i) + width * _stat("d", i)
        inside = F.greatest(F.least(q(c), high), low)
        clipped[c] = F.when((_stat("d", i) > 0) & q(c).isNotNull(), inside).otherwise(q(c))
    return _rewritten(wide, clipped, df.columns)


def infinite_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """N5 on the given (default: float) columns."""
    if columns is None:
        columns = [
            f.name
            for f in df.schema.fields
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        ]
    chosen = {c: finite_or_null(q(c)) for c in columns}
    return _rewritten(df, chosen, df.columns)


def rescale_importance(table: DataFrame, column: str = "importance") -> DataFrame:
    """Min-max over the features, then each feature's share in percent.

    The table has one row per feature.
    """
    low, high = F.min(column).alias("low"), F.max(column).alias("high")
    wide = table.withColumn(_STAT, table.agg(F.struct(low, high)).scalar())
    spread = F.col(f"{_STAT}.high") - F.col(f"{_STAT}.low")
    scaled = F.coalesce(F.try_divide(F.col(column) - F.col(f"{_STAT}.low"), spread), F.lit(0.0))
    normed = wide.withColumn("importance_normalized", scaled).drop(_STAT)
    total = normed.agg(F.sum("importance_normalized")).scalar()
    share = F.try_divide(F.col("importance_normalized") * 100.0, total)
    return normed.withColumn("percentage_importance", share)
