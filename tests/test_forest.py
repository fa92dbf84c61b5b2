"""Forests: passes and single tasks give the same trees; deep forests stay cheap."""

import numpy as np
import pandas as pd
import pytest

from eventloom.operators import forest, importance


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(7)
    a, b, c = rng.normal(size=3000), rng.integers(0, 9, 3000), (np.arange(3000) % 1000 == 5).astype(int)
    pdf = pd.DataFrame({"k": np.arange(3000), "a": a, "b": b, "c": c, "x": np.sin(3 * a) + 0.3 * b + 40 * c, "y": 0.0})
    return spark.createDataFrame(pdf).repartition(3)


def test_passes_and_tasks_grow_the_same_trees(noisy, monkeypatch):
    names = ["a", "b", "c"]
    cuts, mean, n = forest.cut_points(noisy, names, "x")
    rows, _ = forest.binned(noisy, names, "x", cuts, mean)
    whole, model = forest.fit_forest(rows, n, 3, range(3), 4, 8, 42, keep=True)
    monkeypatch.setattr(forest, "LOCAL", 200)
    parted, other = forest.fit_forest(rows, n, 3, range(3), 4, 8, 42, keep=True)
    assert np.allclose(whole, parted) and abs(whole.sum() - 1) < 1e-9
    assert len(other[0][0][0]) > 10 and not len(model[0][0][0]) > 1  # an upper part of its own, and none
    one, two = (forest.predictions(noisy, names, "x", cuts, mean, m).toPandas() for m in (model, other))
    assert np.allclose(one["prediction"], two["prediction"])
    # Three rows of 3000 differ in c, and still are told apart.
    assert whole[2] > 0.1


def test_rows_of_equal_bins_travel_as_one_and_trees_take_turns(noisy, monkeypatch):
    """What stands on the disks is bounded: one row for equal bins, and a bounded number of trees."""
    names = ["a", "b", "c"]
    cuts, mean, n = forest.cut_points(noisy, names, "x")
    rows, _ = forest.binned(noisy, names, "x", cuts, mean)
    packed, asked = [], []
    real = forest._rests

    def watched(table, arrays, small, *rest):
        asked.append(sorted(small))
        found = real(table, arrays, small, *rest)
        packed.append(rest[1])
        return found

    monkeypatch.setattr(forest, "_rests", watched)
    whole, _ = forest.fit_forest(rows, n, 3, range(3), 4, 8, 42)
    monkeypatch.setattr(forest, "STANDING", 1)
    turns, _ = forest.fit_forest(rows, n, 3, range(3), 4, 8, 42)
    assert asked == [[0, 1, 2, 3], [0], [1], [2], [3]] and set(packed) == {packed[0]}
    assert packed[0] <= 32 * 9 * 2 < n
    assert np.array_equal(whole, turns)


def test_grown_tree_follows_its_rows():
    rng = np.random.default_rng(1)
    codes, y = rng.integers(0, 32, (2, 500)).astype("u1"), rng.normal(size=500)
    tree, taken = forest.grown(codes, y, np.ones(500), 30)
    leaf = forest.place(tree, codes)
    for node in np.unique(leaf):  # a leaf holds equal rows only, and their mean
        own = leaf == node
        assert len(np.unique(codes[:, own], axis=1).T) == 1
        assert np.isclose(tree[3][node], y[own].mean())
    left = sum(np.square(y[leaf == v] - y[leaf == v].mean()).sum() for v in np.unique(leaf))
    assert np.isclose(taken.sum(), np.square(y - y.mean()).sum() - left)


def test_default_forest_runs_in_few_jobs(spark, noisy):
    """100 trees of depth 15: one job a pass and one for the rest, whatever the number of nodes."""
    tracker, group = spark.sparkContext.statusTracker(), "forest-jobs"
    spark.sparkContext.setJobGroup(group, group)
    table, r2 = importance.feature_importance(noisy, "x", "y", ["k"])
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup(group)) < 20
    assert r2 > 0.7 and {r["index1"] for r in table.collect()} == {"a", "b", "c"}


def test_missing_values_are_refused(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 3.0)], "k long, x double, f double").selectExpr("*", "0.0d as y")
    with pytest.raises(ValueError, match="missing"):
        importance.staged_importance(df, "x", ["f"])
