"""Cluster composition, group statistics and cluster profiles (A rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null, q, quoted, stars
from ..functions.tdist import t_two_sided
from .filters import with_group

#: Names a group column may have, by preference.
GROUP_NAMES = ("group", "Group", "condition", "Condition", "treatment", "Treatment")


def group_column(df: DataFrame) -> str:
    found = [n for n in GROUP_NAMES if n in df.columns]
    if not found:
        raise ValueError("No group column found.")
    return found[0]


def _count(df: DataFrame, *names: str) -> DataFrame:
    return df.groupBy(*[q(n) for n in names]).agg(F.count(F.lit(1)).alias("n"))


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """A1: cells and percent per cluster, sorted by the label as text."""
    counts = _count(df, cluster)
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(
        q(cluster).cast("string").alias("cluster"), "n", (F.col("n") * 100.0 / total).alias("pct")
    ).orderBy("cluster")


def sample_summary(
    df: DataFrame, cluster: str = "cluster", sample: str = "sample_id", top: int = 3
) -> DataFrame:
    """A2: the largest samples of each cluster as text, with the number left out."""
    counts = _count(df, cluster, sample)
    by_size = Window.partitionBy(q(cluster)).orderBy(F.desc("n"), q(sample))
    ranked = counts.withColumn("_rank", F.row_number().over(by_size)).filter(F.col("_rank") <= top)
    text = F.concat(q(sample), F.lit(": "), F.col("n").cast("string"))
    heads = ranked.groupBy(q(cluster)).agg(
        F.array_sort(F.collect_list(F.struct("_rank", text.alias("t")))).alias("_parts")
    )
    totals = counts.groupBy(q(cluster)).agg(F.count(F.lit(1)).alias("_all"))
    more = F.when(
        F.col("_all") > top, F.concat(F.lit(" (+"), (F.col("_all") - top).cast("string"), F.lit(" more)"))
    ).otherwise("")
    joined = F.array_join(F.transform("_parts", lambda p: p["t"]), ", ")
    return heads.join(totals, cluster).select(
        q(cluster), F.concat(joined, more).alias("samples")
    )


def cluster_by_group(df: DataFrame, cluster: str = "cluster", group: str = "group") -> DataFrame:
    """Cells per cluster and group, percent of the cluster."""
    counts = _count(with_group(df, group), cluster, group)
    total = F.sum("n").over(Window.partitionBy(q(cluster)))
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def _values(df: DataFrame, column: str) -> Column:
    """Distinct labels of a counted table as one array; labels are few.

    Reading the counts too keeps the aggregate the same as the main plan's, so
    that its shuffle is reused instead of running twice.
    """
    return df.agg(F.array_sort(F.collect_set(F.when(q("n") > 0, q(column)))).alias("v")).scalar()


def cluster_group_grid(df: DataFrame, cluster: str = "cluster", group: str = "group") -> DataFrame:
    """A4: A3 for every cluster and group, 0 where there are no cells."""
    table = cluster_by_group(df, cluster, group)
    clusters = table.select(q(cluster)).distinct()
    grid = clusters.withColumn(group, F.explode(_values(table, group)))
    return grid.join(table, [cluster, group], "left").select(
        q(cluster),
        q(group),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("pct", F.lit(0.0)).alias("pct"),
    )


def sample_shares(
    df: DataFrame,
    cluster: str = "cluster",
    sample: str = "sample_id",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Percent of each sample's cells in each cluster, zeros included.

    Events are counted once per (sample, cluster). A sample's counts become one
    map with an entry per cluster, read for every cluster of the table.
    """
    counts = _count(df.filter(q(cluster).isNotNull()), sample, *carry, cluster)
    keys = [q(sample), *[q(c) for c in carry]]
    maps = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(q(cluster), "n"))).alias("_counts"),
        F.sum("n").alias("_total"),
    )
    grid = maps.withColumn(cluster, F.explode(_values(counts, cluster)))
    found = F.coalesce(F.try_element_at("_counts", q(cluster)), F.lit(0))
    return grid.select(*keys, q(cluster), (found * 100.0 / F.col("_total")).alias("pct"))


def group_statistics(
    table: DataFrame, value: str, by: Sequence[str], with_values: bool = True
) -> DataFrame:
    """Mean, standard error (0 for one value), n and sorted values.

    ``table`` holds one value per sample, not per event.
    """
    deviation = F.coalesce(F.stddev_samp(q(value)), F.lit(0.0))
    aggregates = [
        F.avg(q(value)).alias("mean"),
        (deviation / F.sqrt(F.count(q(value)))).alias("sem"),
        F.count(q(value)).alias("n"),
    ]
    if with_values:
        aggregates.append(F.array_sort(F.collect_list(q(value))).alias("values"))
    return table.groupBy(*[q(b) for b in by]).agg(*aggregates)


def group_tests(
    table: DataFrame,
    value: str,
    cluster: str = "cluster",
    group: str = "group",
    equal_variance: bool = True,
) -> DataFrame:
    """A13 (equal variance) and A15 (Welch): t tests of all group pairs.

    The pairs are formed between per-group moments, a table with one row per
    cluster and group. Equal means without spread give no t.
    """
    moments = (
        table.groupBy(q(cluster), q(group))
        .agg(
            F.avg(q(value)).alias("m"),
            F.var_samp(q(value)).alias("v"),
            F.count(q(value)).alias("n"),
        )
        .filter("n > 1")
    )
    one = moments.select(q(cluster), q(group).alias("group1"), *[F.col(c).alias(f"{c}1") for c in "mvn"])
    two = moments.select(q(cluster), q(group).alias("group2"), *[F.col(c).alias(f"{c}2") for c in "mvn"])
    pairs = one.join(two, cluster).filter("group1 < group2")
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    if equal_variance:
        dof = (n1 + n2 - 2).cast("double")
        pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / dof
        error = F.sqrt(pooled * (1.0 / n1 + 1.0 / n2))
    else:
        e1, e2 = v1 / n1, v2 / n2
        error = F.sqrt(e1 + e2)
        dof = F.try_divide((e1 + e2) * (e1 + e2), e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1))
    tested = pairs.select(
        q(cluster), "group1", "group2", "n1", "n2",
        F.try_divide(F.col("m1") - F.col("m2"), error).alias("t"), dof.alias("df"),
    )
    return tested


def with_p_value(tests: DataFrame) -> DataFrame:
    """Two-sided p of each test row."""
    return tests.withColumn("p", nan_to_null(t_two_sided(F.col("t"), F.col("df"))))


def with_adjusted_p(
    tests: DataFrame, by: Sequence[str] = (), method: str = "holm", p: str = "p"
) -> DataFrame:
    """Adjusted p over all tests, or over those of each ``by`` value.

    One row per tested pair; null p stays null and does not count.
    """
    keys = [q(b) for b in by] + [q(p).isNull()]
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy(q(p))
    m, r = F.count(q(p)).over(whole), F.row_number().over(ordered)
    if method == "none":
        return tests.withColumn("p_adj", q(p))
    if method == "bonferroni":
        return tests.withColumn("p_adj", F.least(F.lit(1.0), m * q(p)))
    if method == "holm":
        raw = tests.withColumn("_raw", F.least(F.lit(1.0), (m - r + 1) * q(p)))
        running = ordered.rowsBetween(Window.unboundedPreceding, 0)
        adjusted = F.max("_raw").over(running)
    elif method == "BH":
        raw = tests.withColumn("_raw", F.least(F.lit(1.0), m * q(p) / r))
        adjusted = F.min("_raw").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    else:
        raise ValueError(f"Unknown adjustment: {method}")
    return raw.withColumn("p_adj", F.when(q(p).isNotNull(), adjusted)).drop("_raw")


def with_significance(tests: DataFrame, p: str = "p", only_significant: bool = True) -> DataFrame:
    """Star marker; by default only rows below 0.05 remain."""
    marked = tests.withColumn("marker", stars(q(p)))
    return marked.filter("marker is not null") if only_significant else marked


def cluster_means(df: DataFrame, features: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """A5: mean of each feature per cluster, as (cluster, feature, mean)."""
    wide = df.groupBy(q(cluster)).agg(
        *[F.avg(nan_to_null(q(c).cast("double"))).alias(c) for c in features]
    )
    return wide.unpivot([quoted(cluster)], [quoted(c) for c in features], "feature", "mean")


def sample_means(
    df: DataFrame, features: Sequence[str], sample: str = "sample_id"
) -> DataFrame:
    """Mean of each feature per sample."""
    return df.groupBy(q(sample)).agg(
        *[F.avg(nan_to_null(q(c).cast("double"))).alias(c) for c in features]
    )


def sample_weighted_means(
    labels: DataFrame,
    events: DataFrame,
    features: Sequence[str],
    cluster: str = "cluster",
    sample: str = "sample_id",
) -> DataFrame:
    """Cluster mean as the average of whole-sample means, weighted by the
    cluster's cells per sample. Two small aggregates meet; events do not."""
    counts = _count(labels, cluster, sample)
    means = sample_means(events, features, sample).unpivot(
        [quoted(sample)], [quoted(c) for c in features], "feature", "m"
    )
    known = counts.join(means, sample).filter("m is not null")
    return known.groupBy(q(cluster), "feature").agg(
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean")
    )


def distinguishing_scores(profile: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Distance of a cluster's mean from the other clusters' means, in their
    population deviations.

    Each feature's cluster means are one short array (one entry per cluster).
    """
    rows = profile.filter("mean is not null").groupBy("feature").agg(
        F.collect_list(F.struct(q(cluster).alias("k"), F.col("mean").alias("m"))).alias("all")
    )
    each = rows.select("feature", "all", F.explode("all").alias("own"))
    others = F.transform(
        F.filter("all", lambda e: e["k"] != F.col("own.k")), lambda e: e["m"]
    )

    def total(values: Column) -> Column:
        return F.aggregate(F.array_sort(values), F.lit(0.0), lambda a, v: a + v)

    with_mean = each.select("feature", "own", others.alias("others")).withColumn(
        "mu", F.try_divide(total(F.col("others")), F.size("others").cast("double"))
    )
    squares = F.transform("others", lambda v: (v - F.col("mu")) * (v - F.col("mu")))
    spread = with_mean.withColumn(
        "sd",
        F.when(
            F.array_min("others") == F.array_max("others"), F.lit(0.0)
        ).otherwise(F.sqrt(F.try_divide(total(squares), F.size("others").cast("double")))),
    )
    v = F.col("own.m")
    score = (
        F.when(F.size("others") == 0, F.lit(0.0))
        .when(F.col("sd") > 0, F.abs((v - F.col("mu")) / F.col("sd")))
        .when(F.col("mu") != 0, F.abs(v - F.col("mu")))
        .otherwise(F.abs(v))
    )
    return spread.select(F.col("own.k").alias(cluster), "feature", score.alias("score"))


def top_features(
    scores: DataFrame, cluster: str = "cluster", n: int = 5, order: Sequence[str] | None = None
) -> DataFrame:
    """The ``n`` best features per cluster in wide columns of text.

    Ties keep the order of ``order`` (default: by name).
    """
    tie = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("feature")) if order else F.col("feature")
    best = Window.partitionBy(q(cluster)).orderBy(F.desc("score"), tie)
    ranked = scores.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= n)
    columns = []
    for i in range(1, n + 1):
        hit = F.col("_rank") == i
        text = F.format_string("%.4f", F.col("score"))
        columns.append(F.coalesce(F.max(F.when(hit, F.col("feature"))), F.lit("")).alias(f"Top{i}_Feature"))
        columns.append(F.coalesce(F.max(F.when(hit, text)), F.lit("")).alias(f"Top{i}_Score"))
    return ranked.groupBy(q(cluster).cast("string").alias("Cluster")).agg(*columns)


def profile_z(profile: DataFrame) -> DataFrame:
    """A10: z of each feature's mean across clusters; 0 without spread."""
    per_feature = Window.partitionBy("feature")
    mean, sd = F.avg("mean").over(per_feature), F.stddev_pop("mean").over(per_feature)
    flat = F.min("mean").over(per_feature) == F.max("mean").over(per_feature)
    z = F.when(flat, F.lit(0.0)).otherwise(F.try_divide(F.col("mean") - mean, sd))
    return profile.withColumn("z", F.coalesce(z, F.lit(0.0)))


def profile_matrix(
    profile: DataFrame, value: str = "mean", cluster: str = "cluster", clusters: Sequence | None = None
) -> DataFrame:
    """Features x clusters; features without any value are left out."""
    kept = profile.filter(q(value).isNotNull())
    wide = kept.groupBy("feature")
    wide = wide.pivot(cluster, list(clusters)) if clusters else wide.pivot(cluster)
    return wide.agg(F.first(q(value)))


def most_frequent(df: DataFrame, n: int, cluster: str = "cluster") -> DataFrame:
    """The ``n`` largest clusters (ties: smaller label first); null is none."""
    return _count(df.filter(q(cluster).isNotNull()), cluster).orderBy(F.desc("n"), q(cluster)).limit(n)


def limit_clusters(
    df: DataFrame, n: int, cluster: str = "cluster", name: str = "cluster_limited"
) -> DataFrame:
    """Keep the ``n`` largest clusters' labels, collapse the rest."""
    if cluster not in df.columns:
        raise ValueError(f"No labels to limit: '{cluster}' is not found among the columns.")
    numeric = isinstance(df.schema[cluster].dataType, T.NumericType)
    other = F.lit(-1 if numeric else "Other")
    kept = most_frequent(df, n, cluster).agg(F.collect_list(q(cluster)).alias("k")).scalar()
    return df.withColumn(name, F.when(F.array_contains(kept, q(cluster)), q(cluster)).otherwise(other))


def clusters_found(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Number of clusters, noise not counted."""
    label = q(cluster).cast("string")
    return df.agg(
        F.count_distinct(F.when(~label.isin("-1", "Noise"), label)).alias("n_clusters")
    )


def cluster_cells(
    df: DataFrame, keys: Sequence[str], n: int = 100, cluster: str = "cluster", seed: int = 42
) -> DataFrame:
    """Up to ``n`` cells of every cluster."""
    from .ordering import cap_per_group

    return cap_per_group(df, [cluster], keys, n, seed)


def cells_exported(cells: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Exported cells per cluster."""
    return _count(cells, cluster)
