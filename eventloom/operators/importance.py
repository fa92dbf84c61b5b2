"""Feature importance by correlation (A17) and by forests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite_or_null, q, quoted
from ..session import drop_scratch, pin, pin_at
from .joins import lookup_features

#: Fixed value: more valid rows than this are needed for a correlation.
LEAST_PAIRS = 10


def _impact(corr_x: Column, corr_y: Column) -> list[Column]:
    return [
        F.abs(corr_x).alias("x_impact"),
        F.abs(corr_y).alias("y_impact"),
        corr_x.alias("x_correlation"),
        corr_y.alias("y_correlation"),
    ]


def _pearson(cov: Column, var_a: Column, var_b: Column) -> Column:
    """Correlation from moments; null without spread instead of an error."""
    return F.try_divide(cov, F.sqrt(var_a * var_b))


def correlation_importance(
    points: DataFrame, features: DataFrame, names: Sequence[str], key: Sequence[str]
) -> DataFrame:
    """Correlation of each feature with x and y over matching events.

    One join on the row key and one aggregate for all features.
    """
    joined = lookup_features(points.select(*[q(k) for k in key], "x", "y"), features, key, "inner")
    x, y = finite_or_null(q("x").cast("double")), finite_or_null(q("y").cast("double"))
    packed = []
    for n in names:
        v = finite_or_null(q(n).cast("double"))
        ok = v.isNotNull() & x.isNotNull() & y.isNotNull()
        f, gx, gy = F.when(ok, v), F.when(ok, x), F.when(ok, y)
        packed.append(
            F.struct(
                F.lit(n).alias("feature"),
                F.count(f).alias("n"),
                F.covar_pop(f, gx).alias("cx"), F.covar_pop(f, gy).alias("cy"),
                F.var_pop(f).alias("vf"), F.var_pop(gx).alias("vx"), F.var_pop(gy).alias("vy"),
            )
        )
    rows = joined.agg(F.array(*packed).alias("a")).select(F.inline("a"))
    cx = _pearson(F.col("cx"), F.col("vf"), F.col("vx"))
    cy = _pearson(F.col("cy"), F.col("vf"), F.col("vy"))
    found = rows.filter(F.col("n") > LEAST_PAIRS).select("feature", *_impact(cx, cy))
    return found.filter("x_correlation is not null and y_correlation is not null")


def sample_correlation(
    points: DataFrame, features: DataFrame, names: Sequence[str], sample: str = "sample_id"
) -> DataFrame:
    """A17/J7 as in the sample-only join: every event of a sample pairs with
    every coordinate of that sample.

    The pairs are never formed: all sums over them are products of per-sample
    sums. Values are centred first, so that the sums do not cancel.
    """
    x, y = finite_or_null(q("x").cast("double")), finite_or_null(q("y").cast("double"))
    both = x.isNotNull() & y.isNotNull()
    good = points.filter(both).select(q(sample), x.alias("x"), y.alias("y"))
    middle = good.agg(F.struct(F.avg("x").alias("x"), F.avg("y").alias("y")).alias("c")).scalar()
    cx, cy = F.col("x") - F.col("_c.x"), F.col("y") - F.col("_c.y")
    left = (
        good.withColumn("_c", middle)
        .groupBy(q(sample))
        .agg(
            F.count(F.lit(1)).cast("double").alias("m"),
            F.sum(cx).alias("sx"), F.sum(cy).alias("sy"),
            F.sum(cx * cx).alias("sxx"), F.sum(cy * cy).alias("syy"),
        )
    )
    values = features.select(q(sample), *[finite_or_null(q(n).cast("double")).alias(f"v{i}") for i, n in enumerate(names)])
    mids = values.agg(F.struct(*[F.avg(f"v{i}").alias(f"m{i}") for i in range(len(names))]).alias("c")).scalar()
    each = []
    for i, n in enumerate(names):
        v = F.col(f"v{i}") - F.col(f"_c.m{i}")
        each.append(
            F.struct(
                F.lit(n).alias("feature"),
                F.count(v).cast("double").alias("n"), F.sum(v).alias("sf"), F.sum(v * v).alias("sff"),
            )
        )
    # One row a sample before the features stand below each other.
    right = (
        values.withColumn("_c", mids)
        .groupBy(q(sample))
        .agg(F.array(*each).alias("_each"))
        .select(q(sample), F.inline("_each"))
        .filter("n > 0")
    )
    c = F.col
    sums = left.join(right, sample).groupBy("feature").agg(
        F.sum(c("m") * c("n")).alias("w"),
        F.sum(c("m") * c("sf")).alias("f"), F.sum(c("m") * c("sff")).alias("ff"),
        F.sum(c("n") * c("sx")).alias("x"), F.sum(c("n") * c("sxx")).alias("xx"),
        F.sum(c("n") * c("sy")).alias("y"), F.sum(c("n") * c("syy")).alias("yy"),
        F.sum(c("sf") * c("sx")).alias("fx"), F.sum(c("sf") * c("sy")).alias("fy"),
    )

    def moment(product: str, a: str, b: str) -> Column:
        return c(product) / c("w") - c(a) / c("w") * c(b) / c("w")

    vf = moment("ff", "f", "f")
    corr_x = _pearson(moment("fx", "f", "x"), vf, moment("xx", "x", "x"))
    corr_y = _pearson(moment("fy", "f", "y"), vf, moment("yy", "y", "y"))
    found = sums.filter(c("w") > LEAST_PAIRS).select("feature", *_impact(corr_x, corr_y))
    return found.filter("x_correlation is not null and y_correlation is not null")


#: Size of the forests and the width above which a first, small
#: forest chooses the features.
TREES, FIRST_TREES, FIRST_DEPTH, WIDE = 100, 20, 10, 50
TOP = 10


def split_rows(
    df: DataFrame, key: Sequence[str], test_share: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key: the same for any partitioning."""
    from ..functions.columns import draw_order

    draw = F.conv(F.substring(draw_order(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    marked = df.withColumn("_draw", draw)
    return (
        marked.filter(F.col("_draw") >= test_share).drop("_draw"),
        marked.filter(F.col("_draw") < test_share).drop("_draw"),
    )


def feature_importance(
    df: DataFrame,
    dep: str,
    indep: str,
    key: Sequence[str],
    *,
    trees: int = TREES,
    depth: int = 15,
    top: int | None = TOP,
    seed: int = 42,
) -> tuple[DataFrame, float]:
    """M9: forest importance of the other columns for ``dep``; r² on held-out rows.

    ``indep`` (the other coordinate) and the key take no part. The table is
    ascending and holds the ``top`` features.
    """
    from pyspark.ml.evaluation import RegressionEvaluator

    from .forest import binned, cut_points, fit_forest, predictions
    from .scaling import rescale_importance

    names = [c for c in df.columns if c not in (dep, indep, *key)]
    train, test = split_rows(df, key, seed=seed)
    cuts, mean, n = cut_points(train, names, dep)
    rows, path = binned(train, names, dep, cuts, mean)
    try:
        shares, model = fit_forest(rows, n, len(names), range(len(names)), trees, depth, seed, keep=True)
    finally:
        drop_scratch(df.sparkSession, path)
    scored = predictions(test, names, dep, cuts, mean, model)
    r2 = RegressionEvaluator(labelCol="_y", predictionCol="prediction", metricName="r2").evaluate(scored)
    pairs = [(n, float(v)) for n, v in zip(names, shares)]
    table = df.sparkSession.createDataFrame(pairs, "index1 string, importance double")
    return top_importance(rescale_importance(table), top), r2


def top_importance(table: DataFrame, top: int | None = TOP) -> DataFrame:
    """The ``top`` features by share, listed in ascending order."""
    ranked = table.orderBy(F.desc("percentage_importance"), "index1")
    if top:
        ranked = ranked.limit(top)
    return ranked.orderBy("percentage_importance", F.desc("index1")).select(
        "index1", "importance_normalized", "percentage_importance"
    )


def staged_importance(
    df: DataFrame,
    dep: str,
    names: Sequence[str],
    *,
    wide: int = WIDE,
    trees: int = TREES,
    depth: int = 15,
    seed: int = 42,
) -> DataFrame:
    """With more than ``wide`` features a small forest picks ``wide`` of
    them for the full forest; the others get importance 0."""
    from .forest import binned, cut_points, fit_forest
    from .scaling import rescale_importance

    names = list(names)
    chosen = list(range(len(names)))
    cuts, mean, n = cut_points(df, names, dep)
    rows, path = binned(df, names, dep, cuts, mean)
    try:
        if len(names) > wide:
            first, _ = fit_forest(rows, n, len(names), chosen, FIRST_TREES, FIRST_DEPTH, seed)
            chosen = sorted(first.argsort()[::-1][:wide].tolist())
        shares, _ = fit_forest(rows, n, len(names), chosen, trees, depth, seed)
    finally:
        drop_scratch(df.sparkSession, path)
    found = {names[i]: float(v) for i, v in zip(chosen, shares)}
    pairs = [(n, found.get(n, 0.0)) for n in names]
    table = df.sparkSession.createDataFrame(pairs, "index1 string, importance double")
    return rescale_importance(table)


def importance_of_coordinates(df: DataFrame, names: Sequence[str], **options) -> DataFrame:
    """Importance for x and for y in one table."""
    from .schema import stack_importance

    return stack_importance(
        staged_importance(df, "x", names, **options), staged_importance(df, "y", names, **options)
    )


#: Fixed value: seed of the draws. The first attempt at a draw of ``total`` rows looks at about
#: this many times as many, each further one at this many times more.
DRAW_SEED, FIRST_DRAW, MORE_DRAWN = 42, 4, 32


def importance_input(
    points: DataFrame,
    features: DataFrame,
    names: Sequence[str],
    key: Sequence[str],
    *,
    sample: str = "sample_id",
    cap: int | None = 0,
    total: int = 0,
) -> DataFrame:
    """Features with coordinates, cleaned; capped per sample and in total if asked.

    Rows are cleaned before they are drawn (Q10), and features meet their own
    coordinates by key (Q3). By default every row is kept; ``cap=None`` takes the
    adaptive cap for this many features.
    """
    from ..functions.columns import draw_order
    from .filters import finite_rows
    from .ordering import adaptive_cap, cap_per_group, cap_total
    from .scaling import clip_outliers

    cap = adaptive_cap(len(names)) if cap is None else cap

    def rows(share: float) -> DataFrame:
        """The rows drawn first, up to a bound of the order that is the same for both limits."""
        sides = [points.select(*[q(k) for k in key], "x", "y"), features]
        if share < 1:
            early = draw_order(key, DRAW_SEED) < f"{int(share * (1 << 32)):08x}"
            sides = [side.filter(early) for side in sides]
        clean = finite_rows(lookup_features(*sides, key, "inner"), [*names, "x", "y"])
        drawn = cap_per_group(clean, [sample], key, cap, DRAW_SEED) if cap else clean
        return cap_total(drawn, key, total, DRAW_SEED) if total else drawn

    if not total:
        drawn = pin(rows(1.0), "drawn")
    else:
        # A row's place in its sample and in the whole depends on earlier rows alone. So the
        # earliest rows give the same draw as all of them, once they fill it.
        share = FIRST_DRAW * total / max(points.count(), 1)
        while True:
            # The draw feeds both the limits and the clipping: it is made once.
            drawn, path = pin_at(rows(share), "drawn")
            if share >= 1 or drawn.count() >= total:
                break
            drop_scratch(points.sparkSession, path)
            share *= MORE_DRAWN
    return clip_outliers(drawn, names).select(*[q(k) for k in key], *[q(n) for n in names], "x", "y")


def sample_components(
    events: DataFrame, sheet_groups: DataFrame, features: Sequence[str], group: str = "group"
) -> tuple[DataFrame, list[float]]:
    """Two principal components of the standardised per-sample means.

    Returns one row per sample with a group, and the explained variance shares.
    The largest loading of a component is made positive.
    """
    import numpy as np
    from pyspark.ml.feature import PCA, VectorAssembler

    from .clusters import sample_means
    from .filters import finite_rows, with_group
    from .scaling import standardise

    means = sample_means(events, features).join(sheet_groups, "sample_id")
    clean = finite_rows(with_group(means, group), features)
    scaled = standardise(clean, features)
    rows = VectorAssembler(inputCols=list(features), outputCol="_vector").transform(scaled)
    model = PCA(k=2, inputCol="_vector", outputCol="_pc").fit(rows)
    loadings = model.pc.toArray()
    sign = np.sign(loadings[np.abs(loadings).argmax(axis=0), [0, 1]])
    value = []
    for j in range(2):
        total = F.lit(0.0)
        for i, n in enumerate(features):
            total = total + q(n) * float(loadings[i, j] * sign[j])
        value.append(total.alias(f"pc{j + 1}"))
    out = scaled.select("sample_id", q(group), *value)
    return out, [float(v) for v in model.explainedVariance.toArray()]
