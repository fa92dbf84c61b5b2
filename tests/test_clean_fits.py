"""Fits leave unusable rows out, refuse too few points and do not depend on partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import mixtures, passes


@pytest.fixture(scope="module")
def holed(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i // 100, *map(float, p)) for i, p in enumerate(rng.normal(size=(300, 2)) * 0.3 + np.repeat([[0, 0], [9, 0], [0, 9]], 100, axis=0))]
    rows += [(300, -1, None, 1.0), (301, -1, float("nan"), 1.0), (302, -1, 1.0, float("inf"))]
    return spark.createDataFrame(rows, "k long, truth int, x double, y double").repartition(3)


@pytest.mark.parametrize("fit", [lambda df: mixtures.kmeans(df, 3, n_init=3), lambda df: mixtures.gaussian_mixture(df, 3, n_init=2)])
def test_missing_coordinates_have_no_label(holed, fit):
    counts = {(r["truth"], r["cluster"]): r["count"] for r in fit(holed).groupBy("truth", "cluster").count().collect()}
    assert counts.pop((-1, None)) == 3
    assert sorted(t for t, _ in counts) == [0, 1, 2] and set(counts.values()) == {100}
    assert len({c for _, c in counts}) == 3


def test_starts_do_not_depend_on_partitions(holed):
    points = passes.point_table(holed, ["x", "y"])
    four, nine = (passes.starting_rows(points.repartition(n), 5, 3) for n in (4, 9))
    assert (four == nine).all() and len(four) == 300


def test_more_clusters_than_distinct_points_raise(spark):
    same = spark.range(50).select((F.col("id") % 4).cast("double").alias("x"), F.lit(1.0).alias("y"))
    with pytest.raises(ValueError, match="distinct"):
        mixtures.kmeans(same, 5)
