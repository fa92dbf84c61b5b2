"""Queries: neighbour graph, embeddings, clustering, importance, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density, embed, graph, importance, joins, mixtures
from ..session import tune
from .registry import query
from .shape_queries import rounded
from .tables import CELLS, DIRTY, FEATURES, KEY, SHEET, cells, dirty_cells, sheet, table


def vectors(spark, d):
    tune(spark)
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


def _brute_force(distance: str, k: int) -> str:
    """All distances."""
    return f"""with v as (select vec_id, cast(embedding as double[]) e from embeddings),
    p as (select a.vec_id src, b.vec_id dst, {distance}(a.e, b.e) d from v a join v b on a.vec_id <> b.vec_id),
    r as (select *, cast(row_number() over (partition by src order by d, dst) as integer) "rank" from p)
    select src, dst, round(d, 6) dist, "rank" from r where "rank" <= {k}"""


@query("M1_neighbours", _brute_force("list_distance", 10))
def m1(spark, d):
    edges = graph.neighbour_edges(graph.nearest_neighbours(vectors(spark, d), 10))
    return rounded(edges, "dist")


@query("M1_neighbours_cosine", _brute_force("list_cosine_distance", 5))
def m1_cosine(spark, d):
    edges = graph.neighbour_edges(graph.nearest_neighbours(vectors(spark, d), 5, metric="cosine"))
    return rounded(edges, "dist")


@query(
    "M1_audited_recall",
    """with v as (select vec_id, cast(embedding as double[]) e from embeddings),
    p as (select a.vec_id src, list_distance(a.e, b.e) d from v a join v b on a.vec_id <> b.vec_id)
    select src, round(max(d), 6) reach, true recalled from (
      select *, row_number() over (partition by src order by d) n from p) where n <= 10 group by src""",
)
def m1_recall(spark, d):
    """Blocks far smaller than the table and descent; every audited point's true reach, and
    whether the graph's recall is as promised."""
    points = vectors(spark, d)
    built = graph.nearest_neighbours(points, 10, block=80, orders=3)
    named = points.select(F.col("id").alias("src"), "vec")
    every = graph.audit(named, built, 10, "euclidean", n=None)
    return every.join(built.select("src", F.col("recall").alias("recall_")), "src").select(
        "src", F.round("reach", 6).alias("reach"), (F.col("recall_") >= graph.RECALL).alias("recalled")
    )


@query("M1_neighbours_2d")
def m1_flat(spark, d):
    """Every cell's neighbours in the plane."""
    points = graph.with_vector(graph.numbered(cells(spark, d).select("x", "y"), "id"), ["x", "y"])
    edges = graph.neighbour_edges(graph.nearest_neighbours(points, 5, orders=4))
    return edges.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dist"), 4).alias("mean_dist"))


def _counted(df, *by):
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


@query("M5_kmeans")
def m5(spark, d):
    labelled = mixtures.kmeans(cells(spark, d).select(*KEY, "x", "y"), 10)
    return _counted(labelled, "cluster")


@query("M6_elbow")
def m6(spark, d):
    return mixtures.elbow(cells(spark, d).select("x", "y"))


@query("M7_mixture_full")
def m7(spark, d):
    points = cells(spark, d).select(*KEY, "x", "y")
    return _counted(mixtures.gaussian_mixture(points, 4), "cluster")


def _restricted(kind):
    def run(spark, d):
        points = cells(spark, d).select(*KEY, "x", "y")
        found = mixtures.gaussian_mixture(points, 4, covariance=kind)
        return _counted(found, "cluster")

    return run


for _kind in ("tied", "diag", "spherical"):
    query(f"M7_mixture_{_kind}")(_restricted(_kind))


def _importance_rows(spark, d):
    base = cells(spark, d)
    return base.select(*KEY, *FEATURES, F.col("gate_o").cast("double").alias("gate_o"), "x", "y")


@query("M9_feature_importance")
def m9(spark, d):
    table_, _ = importance.feature_importance(_importance_rows(spark, d), "x", "y", KEY)
    return table_


@query("L6_top_importance")
def l6(spark, d):
    table_, _ = importance.feature_importance(
        _importance_rows(spark, d), "y", "x", KEY, top=3
    )
    return table_


@query("M10_staged_importance")
def m10(spark, d):
    names = [*FEATURES, "gate_o"]
    return importance.importance_of_coordinates(
        _importance_rows(spark, d), names, wide=3
    )


@query(
    "M11_importance_input",
    f"""with {DIRTY}, c as (select * from dirty where l_discount is not null and not isinf(l_tax)),
    s as (select * from c qualify row_number() over (partition by sample_id order by md5(concat_ws('|', sample_id, cell_id, '42'))) <= 200),
    t as (select * from s order by md5(concat_ws('|', sample_id, cell_id, '42')) limit 3000)
    select sample_id, cell_id, l_quantity, l_extendedprice, l_discount, l_tax, x, y from t""",
)
def m11(spark, d):
    base = dirty_cells(spark, d)
    return importance.importance_input(base, base.select(*KEY, *FEATURES), FEATURES, KEY, cap=None, total=3000)


@query(
    "M11_importance_input_all",
    f"""with {DIRTY} select sample_id, cell_id, l_quantity, l_extendedprice, l_discount, l_tax, x, y from dirty
    where l_discount is not null and not isinf(l_tax)""",
)
def m11_all(spark, d):
    base = dirty_cells(spark, d)
    return importance.importance_input(base, base.select(*KEY, *FEATURES), FEATURES, KEY)


@query("M12_sample_components")
def m12(spark, d):
    events = cells(spark, d)
    groups = joins.sample_groups(events.select("sample_id").distinct(), sheet(spark, d))
    points, _ = importance.sample_components(events, groups, FEATURES)
    return rounded(points, "pc1", "pc2")


@query(
    "M12_explained_variance",
    f"""with {CELLS}, {SHEET}, m as (select sample_id, avg(l_quantity) a, avg(l_discount) b from cells
    where sample_id in (select stem from sheet where trim("group") <> '') group by 1)
    select round((1 + abs(corr(a, b))) / 2, 6) pc1, round((1 - abs(corr(a, b))) / 2, 6) pc2 from m""",
)
def m12_shares(spark, d):
    """With two standardised features the shares follow from their correlation."""
    events = cells(spark, d)
    groups = joins.sample_groups(events.select("sample_id").distinct(), sheet(spark, d))
    _, shares = importance.sample_components(events, groups, ["l_quantity", "l_discount"])
    return spark.createDataFrame([(round(shares[0], 6), round(shares[1], 6))], "pc1 double, pc2 double")


# ---- embeddings and density clusters ---------------------------------------


@query("M2_umap")
def m2(spark, d):
    return embed.umap_layout(vectors(spark, d), 15, 0.1)


@query("M3_densmap")
def m3(spark, d):
    return embed.umap_layout(vectors(spark, d), 15, 0.1, dens_lambda=2.0)


@query("M4_tsne")
def m4(spark, d):
    return embed.tsne_layout(vectors(spark, d), 30.0)


@query("M8_hdbscan")
def m8(spark, d):
    points = cells(spark, d).select(*KEY, "x", "y")
    return _counted(density.hdbscan(points, min_cluster_size=100, min_samples=5), "cluster")


@query(
    "M13_prepared_features",
    f"""with {DIRTY}, k as (select sample_id, cell_id, l_quantity, l_discount,
      case when isinf(l_tax) then null else l_tax end l_tax from dirty where gate_r
      qualify row_number() over (partition by sample_id order by md5(concat_ws('|', sample_id, cell_id, '42'))) <= 100)
    select sample_id, cell_id, {", ".join(
        f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 6) {c}" for c in ("l_quantity", "l_discount", "l_tax"))} from k""",
)
def m13(spark, d):
    chosen = ["l_quantity", "l_discount", "l_tax"]
    ready = embed.prepare_features(
        dirty_cells(spark, d), chosen, key=KEY, population="gate_r", max_cells_per_sample=100
    )
    return rounded(ready, *chosen)


@query("M13_embedding")
def m13_embed(spark, d):
    return embed.embed(cells(spark, d), FEATURES, "UMAP", key=KEY, n_neighbors=10)


@query("M14_cluster_by_method")
def m14(spark, d):
    """The dispatcher with each of its methods; cluster sizes by method."""
    points = cells(spark, d).select(*KEY, "x", "y")
    calls = {
        "GMM": {"n_clusters": 5, "covariance_type": "diag"},
        "KMeans": {"n_clusters": 5},
        "HDBSCAN": {"min_cluster_size": 100, "min_samples": 5},
    }
    sizes = [
        _counted(density.cluster(points, method, **options), "cluster").withColumn("method", F.lit(method))
        for method, options in calls.items()
    ]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2]).select("method", "cluster", "n")
