"""Tables behind the figures (G rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cluster_label, q
from .clusters import limit_clusters
from .filters import find_cells
from .quality import factor_index


def categorical_scatter(
    df: DataFrame, column: str, factors: Sequence[str] | None = None
) -> DataFrame:
    """G1: points with the palette index of their factor; others get null."""
    if factors is None:
        palette = factor_index(df, column)
        return df.select("x", "y", q(column)).join(palette, column, "left").select("x", "y", q(column), "palette_index")
    pairs = F.create_map(*[F.lit(v) for i, f in enumerate(factors) for v in (f, i)])
    return df.select("x", "y", q(column), pairs[q(column)].alias("palette_index"))


def linear_scatter(df: DataFrame, column: str) -> DataFrame:
    """Points with a value and its place between smallest and largest."""
    bounds = df.agg(
        F.struct(F.min(q(column)).alias("low"), F.max(q(column)).alias("high"))
    ).scalar()
    wide = df.select("x", "y", q(column).alias("value"), bounds.alias("_b"))
    scaled = F.try_divide(F.col("value") - F.col("_b.low"), F.col("_b.high") - F.col("_b.low"))
    return wide.withColumn("scaled", scaled).drop("_b")


def highlighted_cells(
    df: DataFrame, ids: DataFrame, key: str, top: int, cluster: str = "cluster"
) -> tuple[DataFrame, DataFrame]:
    """Listed cells with their collapsed cluster, and the unknown ids."""
    return find_cells(limit_clusters(df, top, cluster), ids, key)


def _bucket(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin; the upper edge belongs to the last bin."""
    place = F.try_divide((value - low) * bins, high - low)
    return F.least(F.lit(bins - 1), F.coalesce(F.floor(place), F.lit(0))).cast("int")


def density_raster(df: DataFrame, bins: int = 256, value: str | None = None) -> DataFrame:
    """Points per raster cell, with the mean of an optional value.

    Bins are at most ``bins`` x ``bins`` rows, whatever the number of points.
    """
    box = df.agg(
        F.struct(
            F.min("x").alias("x0"), F.max("x").alias("x1"),
            F.min("y").alias("y0"), F.max("y").alias("y1"),
        )
    ).scalar()
    placed = df.withColumn("_b", box).select(
        _bucket(F.col("x"), F.col("_b.x0"), F.col("_b.x1"), bins).alias("bin_x"),
        _bucket(F.col("y"), F.col("_b.y0"), F.col("_b.y1"), bins).alias("bin_y"),
        *([q(value).alias("_v")] if value else []),
    )
    aggregates = [F.count(F.lit(1)).alias("n")]
    if value:
        aggregates.append(F.avg("_v").alias("mean_value"))
    return placed.groupBy("bin_x", "bin_y").agg(*aggregates)


def cluster_scatter(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Points with their display label."""
    return df.select("x", "y", cluster_label(q(cluster)).alias("cluster"))
