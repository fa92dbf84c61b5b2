"""Invariants of the iterative operators on small point sets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventloom.operators import density, embed, graph, importance, mixtures, passes


def blobs(seed=42, sizes=(300, 300, 300), noise=45):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0], [8, 0], [0, 8]])
    label = np.repeat(np.arange(3), sizes)
    x = centres[label] + rng.normal(size=(len(label), 2)) * np.array([0.4, 0.6, 0.8])[label][:, None]
    if noise:
        x = np.vstack([x, rng.uniform(-5, 13, size=(noise, 2))])
        label = np.r_[label, [-1] * noise]
    return x, label


@pytest.fixture(scope="module")
def planar(spark):
    x, label = blobs()
    pdf = pd.DataFrame({"k": np.arange(len(x)), "x": x[:, 0], "y": x[:, 1], "truth": label})
    return spark.createDataFrame(pdf).repartition(4)


def exact_neighbours(x, k):
    d = np.sqrt(np.square(x[:, None] - x[None]).sum(axis=-1))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(d, order, 1)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_small_graph_is_exact(spark, metric):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(200), "vec": list(x)}))
    got = graph.nearest_neighbours(df, 7, metric=metric).toPandas().sort_values("src")
    if metric == "manhattan":
        d = np.abs(x[:, None] - x[None]).sum(axis=-1)
    elif metric == "cosine":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - u @ u.T
    else:
        d = np.sqrt(np.square(x[:, None] - x[None]).sum(axis=-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :7]
    have = np.array([[p["d"] for p in pairs] for pairs in got["pairs"]])
    np.testing.assert_allclose(have, want, atol=1e-9)
    assert all(row["src"] not in [p["dst"] for p in row["pairs"]] for _, row in got.iterrows())


def test_blocked_graph_recall_and_copies(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    x[:1000] = 0.5  # a third of all points are copies
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(3000), "vec": list(x)})).repartition(3)
    got = graph.nearest_neighbours(df, 5, orders=2, block=200).toPandas()
    assert len(got) == 3000 and got["pairs"].map(len).min() == 5
    have = {r.src: [p["d"] for p in r.pairs] for r in got.itertuples()}
    assert max(max(have[i]) for i in range(1000)) == 0.0
    _, want = exact_neighbours(x, 5)
    hits = np.mean([have[i][4] <= want[i, 4] + 1e-9 for i in range(1000, 3000)])
    assert hits > 0.9
    share = np.mean([np.mean([d <= want[i, 4] + 1e-9 for d in have[i]]) for i in range(3000)])
    assert got["recall"].nunique() == 1 and got["recall"][0] >= graph.RECALL
    assert abs(got["recall"][0] - share) < 0.03


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev"])
def test_all_pairs_are_compared_at_any_size(spark, metric, monkeypatch):
    monkeypatch.setattr(graph, "PIECE", 700)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(2600, 6)) * 3)  # many equal distances
    x[40:120] = x[40]
    df = spark.createDataFrame([(f"p{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<double>").repartition(3)
    got = {r["src"]: r for r in graph.nearest_neighbours(df, 6, metric=metric).collect()}
    assert len(got) == 2600 and {r["recall"] for r in got.values()} == {1.0}
    for i in range(0, 2600, 13):
        gap = x[i] - x
        d = np.abs(gap).max(axis=1) if metric == "chebyshev" else np.sqrt(np.square(gap).sum(axis=1))
        d[i] = np.inf
        order = np.lexsort((np.arange(2600), d))[:6]
        assert [p["dst"] for p in got[f"p{i:04d}"]["pairs"]] == [f"p{j:04d}" for j in order]
        assert [p["d"] for p in got[f"p{i:04d}"]["pairs"]] == pytest.approx(d[order].tolist())


def test_audit_of_all_points_collects_none(spark, monkeypatch):
    x = np.random.default_rng(9).normal(size=(300, 8))
    df = spark.createDataFrame(pd.DataFrame({"src": np.arange(300), "vec": list(x)}))
    near, dist = exact_neighbours(x, 4)
    rows = [(i, [(float(d), int(j)) for d, j in zip(dist[i], near[i])][: 4 - i % 2]) for i in range(300)]
    table = spark.createDataFrame(rows, "src long, pairs array<struct<d:double,dst:long>>")
    monkeypatch.setattr(type(df), "collect", lambda self: pytest.fail("points came to the driver"))
    found = graph.audit(df, table, 4, "euclidean", n=None)
    monkeypatch.undo()
    for r in found.collect():
        assert r["recall"] == (4 - r["src"] % 2) / 4 and r["reach"] == pytest.approx(dist[r["src"], 3])


def test_audit_counts_lost_neighbours(spark):
    x = np.random.default_rng(8).normal(size=(400, 3))
    df = spark.createDataFrame(pd.DataFrame({"src": np.arange(400), "vec": list(x)}))
    near, dist = exact_neighbours(x, 6)
    rows = [(i, [(float(d), int(j)) for d, j in zip(dist[i], near[i])][: 6 - i % 3]) for i in range(400)]
    table = spark.createDataFrame(rows, "src long, pairs array<struct<d:double,dst:long>>")
    got = {r["src"]: r for r in graph.audit(df, table, 6, "euclidean", n=100).collect()}
    assert len(got) == 100
    for i, row in got.items():
        assert row["recall"] == pytest.approx((6 - i % 3) / 6) and row["reach"] == pytest.approx(dist[i, 5])


def test_graphs_of_no_and_one_point(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0])], "id long, vec array<double>")
    assert graph.nearest_neighbours(df, 3).collect() == []
    assert graph.nearest_neighbours(df.limit(0), 3).collect() == []


def test_kmeans_and_elbow(spark, planar):
    out = mixtures.kmeans(planar.filter("truth >= 0"), 3, n_init=4).toPandas()
    assert pd.crosstab(out["truth"], out["cluster"]).max(axis=1).sum() > 0.99 * len(out)
    five = mixtures.kmeans(planar, 5, n_init=2)
    assert five.select("cluster").distinct().count() == 5
    cost = [r["inertia"] for r in mixtures.elbow(planar, ks=range(1, 7), n_init=5).orderBy("k").collect()]
    assert all(a >= b for a, b in zip(cost, cost[1:]))
    x = planar.select("x", "y").toPandas().to_numpy()
    assert cost[0] == pytest.approx(np.square(x - x.mean(axis=0)).sum())


@pytest.mark.parametrize("kind", mixtures.COVARIANCES)
def test_mixture(spark, planar, kind):
    points = passes.point_table(planar.filter("truth >= 0"), ["x", "y"])
    model, history = mixtures.fit_mixture(points, 3, kind, range(2), 30, 1e-6)
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:]))
    if kind == "tied":
        np.testing.assert_allclose(model.covs[0], model.covs[1])
    if kind == "spherical":
        np.testing.assert_allclose(model.covs[0], np.eye(2) * model.covs[0][0, 0])
    out = mixtures.gaussian_mixture(planar.filter("truth >= 0"), 3, covariance=kind, n_init=2).toPandas()
    assert pd.crosstab(out["truth"], out["cluster"]).max(axis=1).sum() > 0.97 * len(out)


def test_density_clusters(spark, planar):
    out = density.hdbscan(planar, min_cluster_size=40, min_samples=8).toPandas()
    table = pd.crosstab(out["truth"], out["cluster"])
    real = table.drop(columns=-1, errors="ignore")
    assert real.shape[1] == 3
    assert (real.loc[[0, 1, 2]].max(axis=1) > 0.85 * 300).all()
    from test_density import plain_labels

    exact = plain_labels(out[["x", "y"]].to_numpy(), 40, 8)
    assert table.loc[-1, -1] == (exact[out["truth"] == -1] == -1).sum()
    assert len(out) == 945 and out["k"].is_unique


def test_layouts_keep_neighbourhoods(spark):
    rng = np.random.default_rng(3)
    label = np.repeat([0, 1, 2], 60)
    x = (rng.normal(size=(3, 10)) * 5)[label] + rng.normal(size=(180, 10))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(180), "vec": list(x)}))
    neighbours = graph.pinned_graph(df, 30)
    for layout in (
        lambda: embed.umap_layout(df, 12, epochs=8, graph=graph.pinned_graph(df, 11)),
        lambda: embed.umap_layout(df, 12, epochs=8, dens_lambda=1.0, graph=graph.pinned_graph(df, 11)),
        lambda: embed.tsne_layout(df, 10, epochs=10, graph=neighbours),
    ):
        out = layout().toPandas().sort_values("id")
        assert list(out.columns) == ["id", "x", "y"] and len(out) == 180
        y = out[["x", "y"]].to_numpy()
        assert np.isfinite(y).all()
        near, _ = exact_neighbours(y, 5)
        assert (label[near] == label[:, None]).mean() > 0.95


def test_curve_parameters():
    # Published values for the default spacing.
    assert embed.curve_parameters(0.1) == pytest.approx((1.577, 0.895), abs=2e-3)


def test_library_form_adds_coordinates(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(10, 3)), columns=["c1", "c2", "c3"]))
    out = embed.umap(df, df.columns, 2, 0.5, "euclidean", epochs=3)
    assert out.columns == ["c1", "c2", "c3", "x", "y"] and out.filter("x is null").count() == 0
    with pytest.raises(ValueError, match="Unknown method"):
        embed.embed(df, ["c1"], "PCA")


def test_importance(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(500, 10))
    pdf = pd.DataFrame(data, columns=[f"c{i}" for i in range(10)])
    pdf["x"] = 3 * pdf["c2"] + pdf["c7"]
    pdf["y"] = rng.normal(size=500)
    pdf["k"] = np.arange(500)
    df = spark.createDataFrame(pdf)
    table, r2 = importance.feature_importance(df, "x", "y", ["k"], trees=10, depth=6)
    got = table.collect()
    assert len(got) == 10 and got[-1]["index1"] == "c2" and got[-2]["index1"] == "c7" and r2 > 0.6
    shares = [r["percentage_importance"] for r in got]
    assert shares == sorted(shares)
    staged = importance.staged_importance(df, "x", [f"c{i}" for i in range(10)], wide=2, trees=5, depth=4)
    zero = {r["index1"] for r in staged.filter("importance = 0").collect()}
    assert zero == {f"c{i}" for i in range(10)} - {"c2", "c7"}


def test_correlation_modes(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"sample_id": rng.choice(["a", "b", "c"], 90), "k": np.arange(90), "x": rng.normal(size=90)})
    pdf["y"] = -pdf["x"]
    pdf["f"] = pdf["x"] * 2 + 1
    pdf["flat"] = 1.0
    df = spark.createDataFrame(pdf)
    got = importance.correlation_importance(df, df.select("k", "f", "flat"), ["f", "flat"], ["k"]).collect()
    assert [(r["feature"], round(r["x_correlation"], 9), round(r["y_impact"], 9)) for r in got] == [("f", 1.0, 1.0)]
    joined = pdf[["sample_id", "x", "y"]].merge(pdf[["sample_id", "f"]], on="sample_id")
    one = importance.sample_correlation(df, df.select("sample_id", "f"), ["f"]).first()
    assert one["x_correlation"] == pytest.approx(joined["f"].corr(joined["x"]))


def test_components(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"sample_id": np.repeat([f"s{i}" for i in range(12)], 20)})
    for c in "abc":
        pdf[c] = rng.normal(size=240) + np.repeat(rng.normal(size=12), 20)
    groups = spark.createDataFrame([(f"s{i}", "g" if i else " ") for i in range(12)], "sample_id string, group string")
    out, shares = importance.sample_components(spark.createDataFrame(pdf), groups, list("abc"))
    means = pdf.groupby("sample_id").mean().drop("s0")
    z = (means - means.mean()) / means.std(ddof=0)
    want = np.linalg.eigvalsh(np.cov(z.T.to_numpy()))[::-1]
    assert out.count() == 11
    assert shares == pytest.approx(list(want[:2] / want.sum()))


def test_palette_of_many_values(spark):
    from eventloom.operators import plotdata, quality

    df = spark.range(200_000).selectExpr("cast(id * 7919 % 200000 as string) as f", "0D as x", "1D as y")
    got = quality.factor_index(df, "f")
    assert "collect_set" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted(str(i) for i in range(200_000))
    rows = got.where("palette_index % 20011 = 0").collect()
    assert got.count() == 200_000 and len(rows) == 10
    assert all(want[r["palette_index"]] == r["f"] for r in rows)
    few = spark.createDataFrame([(0.0, 1.0, "b"), (1.0, 1.0, None), (2.0, 1.0, "a"), (3.0, 0.0, "b")], "x double, y double, f string")
    assert sorted(r["palette_index"] for r in plotdata.categorical_scatter(few, "f").where("f is not null").collect()) == [0, 1, 1]
    assert plotdata.categorical_scatter(few, "f").count() == 4
