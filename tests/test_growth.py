"""What a step moves must not grow faster than its input."""

import numpy as np
import pandas as pd
import pytest

from eventloom.functions.columns import draw_order
from eventloom.operators import importance, joins, mixtures, ordering, passes
from eventloom.plans import source_queries
from eventloom.sources import fcs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sample_correlation_deals_no_rows_by_feature(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"sample_id": rng.integers(0, 5, 200).astype(str), "x": rng.normal(size=200), "y": rng.normal(size=200)})
    pdf["f"], pdf["g"] = pdf["x"] + rng.normal(size=200), rng.normal(size=200)
    pdf.loc[::7, "g"] = np.nan
    df = spark.createDataFrame(pdf)
    found = importance.sample_correlation(df, df.select("sample_id", "f", "g"), ["f", "g"])
    # Only the sums of samples meet by feature: a single feature would be a single task.
    assert plan(found).count("hashpartitioning(feature") <= 1
    for row in found.collect():
        pairs = pdf[["sample_id", "x"]].merge(pdf[["sample_id", row["feature"]]].dropna(), on="sample_id")
        assert np.isclose(row["x_correlation"], np.corrcoef(pairs["x"], pairs[row["feature"]])[0, 1])


def test_positions_move_rows_once(spark):
    df = spark.range(500).selectExpr("id % 7 as g", "id as k", "id * 2.0d as x", "-id * 1.0d as y", "concat('c', id) as c")
    placed = ordering.with_position(df, ["g"], ["k"], "at")
    # Rows were dealt when they were sorted; the offsets come to them.
    assert "hashpartitioning" not in plan(placed)
    paired = joins.pair_by_order(df.select("g", "c"), df.where("k % 3 = 0").select("g", "c", "x", "y"), "g", ["c"], ["c"])
    assert plan(paired).count("hashpartitioning") <= 2  # the pairing itself
    got = paired.toPandas()
    assert got.columns.tolist() == ["g", "c", "x", "y"] and len(got) == 500
    assert got.groupby("g")["x"].nunique().tolist() == df.where("k % 3 = 0").groupBy("g").count().orderBy("g").toPandas()["count"].tolist()


@pytest.mark.parametrize("samples", [2, 40])
def test_importance_draw_is_that_of_all_rows(spark, samples):
    """Two samples never fill the draw, so that every row is looked at; forty do at once."""
    df = spark.range(4000).selectExpr(
        f"concat('s', id % {samples}) as s", "concat('c', id) as c", "if(id % 5 = 0, null, id * 1.0d) as f", "1.0d as x", "id * 2.0d as y"
    )
    got = importance.importance_input(df, df.select("s", "c", "f"), ["f"], ["s", "c"], sample="s", cap=30, total=500)
    own = df.where("f is not null").withColumn("o", draw_order(["s", "c"], 42)).toPandas().sort_values("o")
    want = own.groupby("s").head(30).head(500)
    assert sorted(r["c"] for r in got.collect()) == sorted(want["c"])


def test_importance_draw_leaves_late_rows_where_they_are(spark, monkeypatch):
    df = spark.range(20000).selectExpr("concat('s', id % 50) as s", "concat('c', id) as c", "id * 1.0d as f", "1.0d as x", "2.0d as y")
    seen = []
    real = importance.lookup_features
    monkeypatch.setattr(importance, "lookup_features", lambda *a: seen.append(real(*a)) or seen[-1])
    importance.importance_input(df, df.select("s", "c", "f"), ["f"], ["s", "c"], sample="s", cap=30, total=100)
    assert [d.count() < 1000 for d in seen] == [True]


def test_written_files_are_bounded(spark, tmp_path):
    df = spark.range(3000).selectExpr("id * 1.0d as a", "id * 0.5d as b").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        source_queries._write_fcs(df, str(tmp_path), file_bytes=16 * 400)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = [f.stat().st_size for f in tmp_path.glob("*.fcs")]
    assert len(sizes) >= 6 and max(sizes) < 16 * 500 + 1000
    back = fcs.read_fcs(spark, str(tmp_path))
    assert back.select("sample_id", "cell_index").distinct().count() == 3000
    assert sorted(tuple(r) for r in back.select("a", "b").collect()) == [(float(i), i / 2) for i in range(3000)]


@pytest.mark.parametrize("dim", [1, 2, 5])
def test_blocks_give_the_sums_of_points(dim):
    rng = np.random.default_rng(dim)
    x = np.round(rng.normal(size=(5000, dim)) * 6) / 2  # ties, and no rounding
    order = passes.near_order(x)
    assert sorted(order) == list(range(5000))
    piece = passes.Piece(x[order])
    for k in (1, 2, 7):
        centres = x[rng.choice(5000, k, replace=False)]
        centres[-1] = centres[0]  # two of one place: the first takes all
        gaps = np.square(x[:, None] - centres).sum(axis=-1)
        nearest = gaps.argmin(axis=1)
        want = [gaps.min(axis=1).sum(), *np.bincount(nearest, minlength=k)]
        got = mixtures._cluster_sums(piece, centres)
        assert np.allclose(got[: 1 + k], want, rtol=1e-6)
        assert np.allclose(got[1 + k :], np.concatenate([np.bincount(nearest, x[:, i], k) for i in range(dim)]))


def test_few_points_meet_all_centres(monkeypatch):
    """In the plane most blocks lie with one centre."""
    x = np.random.default_rng(2).uniform(size=(50_000, 2))
    piece, met = passes.Piece(x[passes.near_order(x)]), []
    real = mixtures._assign
    monkeypatch.setattr(mixtures, "_assign", lambda p, c: met.append(len(p)) or real(p, c))
    mixtures._cluster_sums(piece, np.random.default_rng(3).uniform(size=(8, 2)))
    assert met[0] < 20_000
