"""K-means, elbow and Gaussian mixtures (M5-M7).

All restarts (and, for the elbow, all numbers of clusters) advance together:
one pass over the data serves every one of them, instead of one pass each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.columns import q
from .passes import Piece, arranged, finite_point, pieces, point_table, spread_centres, starting_rows, summed

COVARIANCES = ("full", "tied", "diag", "spherical")


# ---- k-means ---------------------------------------------------------------


def _assign(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gaps = np.square(x).sum(axis=1)[:, None] - 2.0 * x @ centres.T + np.square(centres).sum(axis=1)
    nearest = gaps.argmin(axis=1)
    return nearest, np.maximum(gaps[np.arange(len(x)), nearest], 0.0)


def _cluster_sums(piece: Piece, centres: np.ndarray) -> np.ndarray:
    """Cost, then count and sums of each centre's points. Blocks that lie with one centre
    count as a whole; the points of the others are compared with every centre."""
    k, dim = centres.shape
    owner, whole = piece.owners(centres)
    own, sizes, mean = owner[whole], piece.sizes[whole], piece.mean[whole]
    cost = piece.spread[whole].sum() + (sizes * np.square(mean - centres[own]).sum(axis=1)).sum()
    rest = piece.x[~whole[piece.block]]
    nearest, gaps = _assign(rest, centres)
    counts = np.bincount(own, sizes, k) + np.bincount(nearest, minlength=k)
    sums = [np.bincount(own, sizes * mean[:, i], k) + np.bincount(nearest, rest[:, i], k) for i in range(dim)]
    return np.concatenate([[cost + gaps.sum()], counts, *sums])


def _lloyd(
    points: DataFrame, starts: list[np.ndarray], max_iter: int, tol: float
) -> tuple[list[np.ndarray], list[float]]:
    """Centres and costs of all ``starts``; each pass moves those still moving."""
    near = arranged(points).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _moved(points, near, starts, max_iter, tol)
    finally:
        near.unpersist()


def _moved(
    points: DataFrame, near: DataFrame, starts: list[np.ndarray], max_iter: int, tol: float
) -> tuple[list[np.ndarray], list[float]]:
    dim = len(points.columns)
    scale = sum(float(v or 0.0) for v in points.agg(*[F.var_pop(q(c)) for c in points.columns]).first()) / dim
    centres, costs = list(starts), [math.inf] * len(starts)
    active = list(range(len(starts)))
    for step in range(max_iter + 1):
        current = [(r, centres[r]) for r in active]
        sizes = [1 + len(c) * (1 + dim) for _, c in current]

        def add(piece: Piece) -> np.ndarray:
            return np.concatenate([_cluster_sums(piece, c) for _, c in current])

        total, at, still = summed(near, sum(sizes), add, pieces), 0, []
        for (r, c), size in zip(current, sizes):
            part, k = total[at : at + size], len(c)
            at += size
            costs[r] = float(part[0])
            counts, sums = part[1 : 1 + k], part[1 + k :].reshape(dim, k).T
            moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
            if step < max_iter and np.square(moved - c).sum() > tol * scale:
                centres[r] = moved
                still.append(r)
        active = still
        if not active:
            break
    return centres, costs


def _nearest_label(centres: np.ndarray, columns: Sequence[str]) -> Column:
    """Label expression with the centres as constants."""
    gaps = []
    for j, centre in enumerate(centres):
        total = F.lit(0.0)
        for c, m in zip(columns, centre):
            gap = q(c).cast("double") - float(m)
            total = total + gap * gap
        gaps.append(F.struct(total.alias("d"), F.lit(j).alias("j")))
    return F.array_min(F.array(*gaps))["j"] if len(gaps) > 1 else F.lit(0)


def kmeans(
    df: DataFrame,
    k: int,
    columns: Sequence[str] = ("x", "y"),
    *,
    seed: int = 42,
    n_init: int = 10,
    max_iter: int = 100,
    tol: float = 1e-4,
    name: str = "cluster",
) -> DataFrame:
    """M5: labels of the cheapest of ``n_init`` k-means runs.

    Rows with a missing or non-finite coordinate take no part; their label is null.
    """
    points = point_table(df, columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = starting_rows(points, seed, k)
        starts = [spread_centres(rows, k, seed + i) for i in range(n_init)]
        centres, costs = _lloyd(points, starts, max_iter, tol)
    finally:
        points.unpersist()
    label = _nearest_label(centres[int(np.argmin(costs))], columns)
    return df.withColumn(name, F.when(finite_point(columns), label))


def elbow(
    df: DataFrame,
    columns: Sequence[str] = ("x", "y"),
    ks: Sequence[int] = range(2, 21),
    *,
    seed: int = 42,
    n_init: int = 10,
    max_iter: int = 100,
    tol: float = 1e-4,
) -> DataFrame:
    """M6: within-cluster sum of squares for each number of clusters."""
    points = point_table(df, columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = starting_rows(points, seed, max(ks))
        plan = [(k, i) for k in ks for i in range(n_init)]
        _, costs = _lloyd(points, [spread_centres(rows, k, seed + i) for k, i in plan], max_iter, tol)
    finally:
        points.unpersist()
    best = {k: min(c for (kk, _), c in zip(plan, costs) if kk == k) for k in ks}
    return df.sparkSession.createDataFrame(
        [(int(k), float(c)) for k, c in best.items()], "k int, inertia double"
    )


# ---- Gaussian mixtures -----------------------------------------------------


class Mixture:
    """Weights, means and covariances of one restart."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covs: np.ndarray):
        self.weights, self.means, self.covs = weights, means, covs

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """log(weight * density) of every row and component."""
        n, dim = x.shape
        out = np.empty((n, len(self.weights)))
        for j, (w, mu, cov) in enumerate(zip(self.weights, self.means, self.covs)):
            low = np.linalg.cholesky(cov)
            z = np.linalg.solve(low, (x - mu).T)
            spread = 2.0 * np.log(np.diag(low)).sum() + dim * math.log(2 * math.pi)
            out[:, j] = math.log(max(w, 1e-300)) - 0.5 * (spread + np.square(z).sum(axis=0))
        return out

    def moments(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood, then mass, first and second moments per component."""
        joint = self.log_joint(x)
        top = joint.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))
        share = np.exp(joint - total[:, None])
        second = np.einsum("nk,ni,nj->kij", share, x, x, optimize=True)
        return np.concatenate([[total.sum()], share.sum(axis=0), (share.T @ x).ravel(), second.ravel()])


def _maximise(sums: np.ndarray, k: int, dim: int, n: float, kind: str, floor: float) -> Mixture:
    mass = sums[1 : 1 + k] + 1e-10
    first = sums[1 + k : 1 + k + k * dim].reshape(k, dim)
    second = sums[1 + k + k * dim :].reshape(k, dim, dim)
    means = first / mass[:, None]
    covs = second / mass[:, None, None] - means[:, :, None] * means[:, None, :]
    eye = np.eye(dim)
    if kind == "tied":
        covs = np.repeat(((mass[:, None, None] * covs).sum(axis=0) / mass.sum())[None], k, axis=0)
    elif kind == "diag":
        covs = covs * eye
    elif kind == "spherical":
        covs = np.trace(covs, axis1=1, axis2=2)[:, None, None] / dim * eye
    return Mixture(mass / n, means, covs + floor * eye)


def fit_mixture(
    points: DataFrame, k: int, kind: str, seeds: Sequence[int], max_iter: int, tol: float
) -> tuple[Mixture, list[float]]:
    """EM of all restarts; the likeliest model and its mean log likelihoods.

    Coordinates are centred in the tasks, so second moments do not cancel.
    """
    dim = len(points.columns)
    stats = points.agg(
        *[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(points.columns)],
        *[F.var_pop(q(c)).alias(f"v{i}") for i, c in enumerate(points.columns)],
        F.count(F.lit(1)).alias("n"),
    ).first()
    centre = np.array([float(stats[f"m{i}"]) for i in range(dim)])
    spread = np.array([max(float(stats[f"v{i}"] or 0.0), 1e-12) for i in range(dim)])
    n, floor = float(stats["n"]), 1e-6
    rows = starting_rows(points, seeds[0], k) - centre
    models = []
    for seed in seeds:
        means = spread_centres(rows, k, seed)
        # A few Lloyd steps on the drawn rows settle the starting centres.
        for _ in range(10):
            nearest, _gap = _assign(rows, means)
            means = np.array([rows[nearest == j].mean(axis=0) if (nearest == j).any() else m for j, m in enumerate(means)])
        covs = np.repeat(np.diag(spread / len(means))[None], len(means), axis=0)
        models.append(Mixture(np.full(len(means), 1.0 / len(means)), means, covs))
    k = len(models[0].weights)
    size = 1 + k * (1 + dim + dim * dim)
    history: list[list[float]] = [[] for _ in models]
    active, done = list(range(len(models))), list(models)
    for _ in range(max_iter):
        current = [models[r] for r in active]
        total = summed(
            points, size * len(current), lambda x: np.concatenate([m.moments(x - centre) for m in current])
        )
        still = []
        for at, r in enumerate(active):
            sums = total[at * size : (at + 1) * size]
            score = float(sums[0]) / n
            moving = not history[r] or abs(score - history[r][-1]) > tol
            history[r].append(score)
            done[r] = models[r]
            if moving:
                models[r] = _maximise(sums, k, dim, n, kind, floor)
                still.append(r)
        active = still
        if not active:
            break
    best = max(range(len(models)), key=lambda r: history[r][-1])
    chosen = done[best]
    return Mixture(chosen.weights, chosen.means + centre, chosen.covs), history[best]


def _likeliest_label(model: Mixture, columns: Sequence[str]) -> Column:
    """Label expression with the fitted parameters as constants."""
    scores = []
    for j, (w, mu, cov) in enumerate(zip(model.weights, model.means, model.covs)):
        precision = np.linalg.inv(cov)
        constant = math.log(max(float(w), 1e-300)) - 0.5 * float(np.linalg.slogdet(cov)[1])
        gaps = [q(c).cast("double") - float(m) for c, m in zip(columns, mu)]
        form = F.lit(0.0)
        for a, left in enumerate(gaps):
            for b, right in enumerate(gaps):
                if precision[a, b]:
                    form = form + left * right * float(precision[a, b])
        scores.append(F.struct((F.lit(constant) - 0.5 * form).alias("s"), F.lit(-j).alias("j")))
    return -F.array_max(F.array(*scores))["j"] if len(scores) > 1 else F.lit(0)


def gaussian_mixture(
    df: DataFrame,
    k: int,
    columns: Sequence[str] = ("x", "y"),
    *,
    covariance: str = "full",
    seed: int = 42,
    n_init: int = 10,
    max_iter: int = 100,
    tol: float = 1e-3,
    name: str = "cluster",
) -> DataFrame:
    """M7: labels of the likeliest of ``n_init`` mixtures.

    Rows with a missing or non-finite coordinate take no part; their label is null.
    """
    if covariance not in COVARIANCES:
        raise ValueError(f"Unknown covariance type: {covariance}")
    points = point_table(df, columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model, _ = fit_mixture(points, k, covariance, range(seed, seed + n_init), max_iter, tol)
    finally:
        points.unpersist()
    return df.withColumn(name, F.when(finite_point(columns), _likeliest_label(model, columns)))
