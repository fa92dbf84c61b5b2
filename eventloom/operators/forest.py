"""Regression forests over tables of any length (for M9 and M10).

Features become bins once. Upper levels of all trees grow together: a pass adds up
histograms of the nodes that are still large, and each tree's best splits are chosen
where its histograms meet. A node whose drawn rows fit a task is grown there to its
end, so the work of deep levels follows the rows and not the number of nodes. Rows
stand in the order of their bins, and those of equal bins enter a tree as one with their
weight. They travel to their nodes in packed pieces, a bounded number at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q
from ..session import drop_scratch, pin_at, release_shuffles
from .ordering import shuffle_width, spread

#: Bins of a feature, at most.
BINS = 32
#: Drawn rows from which one task grows the rest of a tree, and rows and bytes of bins that a
#: task packs at once.
LOCAL, CHUNK, CODES = 1 << 18, 1 << 20, 64 << 20
#: A node of so many times fewer rows of unequal bins is grown by one task as well, whatever it draws.
UNEQUAL = 4
#: Bytes of histograms that a task holds at once, and of packed rows that one task is given on average.
HISTOGRAMS, SHARE = 64 << 20, 64 << 20
#: Bytes of packed rows that stand on the disks at once; trees take turns.
STANDING = 1 << 30

#: Times a row is drawn (Poisson with mean 1) by 16 bits of its hash.
_DRAWS = np.searchsorted(
    np.cumsum(np.exp(-1) / np.cumprod(np.r_[1.0, np.arange(1.0, 12.0)])), (np.arange(1 << 16) + 0.5) / (1 << 16)
).astype("u1")


def drawn(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row enters the tree's sample, by a hash of its number."""
    with np.errstate(over="ignore"):
        z = rows.astype("u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + tree + 1) * 0xD1B54A32D192ED03 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return _DRAWS[(z >> np.uint64(48)).astype("i8")]


def cut_points(df: DataFrame, names: Sequence[str], dep: str) -> tuple[list[np.ndarray], float, int]:
    """Cuts of each feature (a value belongs to bin ``i`` if ``i`` cuts are below it), the
    mean of ``dep`` and the number of rows. Missing values are refused."""
    number = {n: q(n).cast("double") for n in (*names, dep)}
    stats = df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(number[dep]).alias("mean"),
        *[F.count_if(c.isNull() | F.isnan(c)).alias(f"bad{i}") for i, c in enumerate(number.values())],
        *[F.approx_count_distinct(number[n]).alias(f"u{i}") for i, n in enumerate(names)],
        *[F.percentile_approx(number[n], [j / BINS for j in range(BINS)], 10_000).alias(f"c{i}") for i, n in enumerate(names)],
    ).first()
    bad = [n for i, n in enumerate(number) if stats[f"bad{i}"]]
    if bad:
        raise ValueError(f"Column(s) {bad} have missing values.")
    if not stats["n"]:
        raise ValueError("A forest needs rows.")
    # Few values: each is a cut, however rare. Their sets are as small as the estimate says.
    few = [i for i in range(len(names)) if stats[f"u{i}"] <= BINS]
    sets = df.agg(*[F.collect_set(number[names[i]]).alias(f"s{i}") for i in few]).first() if few else None
    cuts = []
    for i in range(len(names)):
        found = np.unique(np.array(sets[f"s{i}"] if i in few else stats[f"c{i}"], dtype="f8"))
        cuts.append(found[: BINS - 1] if len(found) <= BINS else found[np.linspace(0, len(found) - 1, BINS).astype(int)][:-1])
    return cuts, float(stats["mean"]), int(stats["n"])


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    stops = np.concatenate(([0], np.cumsum(sizes))).astype("i4")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(stops), pa.py_buffer(np.ascontiguousarray(flat))])


def _codes(batch: pa.RecordBatch, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty((len(cuts), batch.num_rows), "u1")
    for i, cut in enumerate(cuts):
        values = batch.column(i).to_numpy(zero_copy_only=False).astype("f8")
        if np.isnan(values).any():
            raise ValueError("missing values in a feature")
        out[i] = np.searchsorted(cut, values)
    return out


def binned(df: DataFrame, names: Sequence[str], dep: str, cuts: list[np.ndarray], mean: float) -> tuple[DataFrame, str]:
    """(``row``, ``codes``, ``y``): a byte for each feature; ``y`` less its mean. A table written
    in the order of ``codes``."""
    rows = spread(df.select(*[q(n).cast("double").alias(f"f{i}") for i, n in enumerate(names)], q(dep).cast("double").alias("y")))
    rows = rows.withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _codes(batch, cuts)
            y = batch.column("y").to_numpy(zero_copy_only=False) - mean
            packed = _binary(codes.T, np.full(batch.num_rows, len(cuts)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), packed, pa.array(y)], ["row", "codes", "y"])

    # Rows keep their numbers, by which they are drawn, when they are put in order.
    plain, path = pin_at(rows.mapInArrow(run, "row long, codes binary, y double"), "binned")
    ordered = pin_at(plain.repartitionByRange("codes", "row").sortWithinPartitions("codes", "row"), "binned")
    drop_scratch(df.sparkSession, path)
    return ordered


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, codes by feature, y) of up to about CHUNK rows."""
    held, size, most = [], 0, max(1, min(CHUNK, CODES // width))

    def joined():
        rows, codes, y = (np.concatenate(part, axis=-1) for part in zip(*held))
        return rows, np.ascontiguousarray(codes), y

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        packed = batch.column("codes")
        start = np.frombuffer(packed.buffers()[1], "i4")[packed.offset]
        codes = np.frombuffer(packed.buffers()[2], "u1", n * width, start).reshape(n, width).T
        held.append((batch.column("row").to_numpy(), codes.copy(), batch.column("y").to_numpy()))
        size += n
        if size >= most:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _runs(codes: np.ndarray) -> np.ndarray:
    """Starts of the runs of rows with equal codes."""
    new = np.ones(codes.shape[1], bool)
    new[1:] = (codes[:, 1:] != codes[:, :-1]).any(axis=0)
    return np.flatnonzero(new)


def _sample(row: np.ndarray, y: np.ndarray, starts: np.ndarray, tree: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, weight, weight times y) of the runs from which the tree draws rows."""
    w = drawn(row, tree, seed)
    if len(starts) == len(row):
        some = np.flatnonzero(w)
        weight = w[some].astype("f8")
        return some, weight, weight * y[some]
    weight = np.add.reduceat(w, starts, dtype="i8")
    some = np.flatnonzero(weight)
    return some, weight[some].astype("f8"), np.add.reduceat(w * y, starts)[some]


class Tree:
    """Nodes as arrays; ``left`` is the first child, the second one follows. ``feature`` -1 is a leaf."""

    def __init__(self):
        self.feature, self.cut, self.left, self.value = [-1], [0], [-1], [0.0]

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float]) -> int:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, at
        for v in values:
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(-1)
            self.value.append(v)
        return at

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature, "i2"), np.array(self.cut, "u1"), np.array(self.left, "i4"), np.array(self.value)


def place(arrays: tuple[np.ndarray, ...], codes: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    feature, cut, left = arrays[:3]
    node = np.zeros(codes.shape[1], "i4")
    moving = np.arange(codes.shape[1]) if feature[0] >= 0 else np.zeros(0, "i8")
    while len(moving):
        at = node[moving]
        at = left[at] + (codes[feature[at], moving] > cut[at])
        node[moving] = at
        moving = moving[feature[at] >= 0]
    return node


def _histogram(slot: np.ndarray, code: np.ndarray, w: np.ndarray, wy: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = slot * BINS + code
    return np.bincount(at, w, k * BINS).reshape(k, BINS), np.bincount(at, wy, k * BINS).reshape(k, BINS)


class _Best:
    """The best split of each of ``k`` nodes over the features seen."""

    def __init__(self, k: int):
        self.gain, self.feature, self.cut = np.zeros(k), np.full(k, -1, "i2"), np.zeros(k, "u1")
        self.wl, self.sl, self.wr, self.sr, self.nl, self.nr = (np.zeros(k) for _ in range(6))

    def see(self, feature: int, w: np.ndarray, s: np.ndarray, n: np.ndarray | None = None) -> None:
        w, s = w.cumsum(axis=1), s.cumsum(axis=1)
        total, whole = w[:, -1:], s[:, -1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            plain = whole**2 / total
            gain = s**2 / w + (whole - s) ** 2 / (total - w) - plain
        gain[(w <= 0) | (w >= total)] = -1.0
        cut = gain.argmax(axis=1)
        row = np.arange(len(w))
        best = gain[row, cut]
        # No split within what rounding leaves of a node of equal values.
        better = (best > self.gain) & (best > 1e-12 * np.nan_to_num(plain[:, 0]))
        at = row[better], cut[better]
        self.gain[better], self.feature[better], self.cut[better] = best[better], feature, cut[better]
        self.wl[better], self.sl[better] = w[at], s[at]
        self.wr[better], self.sr[better] = total[better, 0] - w[at], whole[better, 0] - s[at]
        if n is not None:
            n = n.cumsum(axis=1)
            self.nl[better], self.nr[better] = n[at], n[better, -1] - n[at]


def grown(codes: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """A tree of these rows, level by level, and the squared error each feature takes away."""
    return _grown(codes, w * y, w.astype("f8"), depth)


def _grown(codes: np.ndarray, wy: np.ndarray, w: np.ndarray, depth: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    importance = np.zeros(len(codes))
    parts = [(np.array([-1], "i2"), np.zeros(1, "u1"), np.array([-1], "i4"), np.array([wy.sum() / max(w.sum(), 1.0)]))]
    slot, k, size = np.zeros(len(w), "i8"), 1, 1
    for _ in range(depth):
        best = _Best(k)
        for f, code in enumerate(codes):
            best.see(f, *_histogram(slot, code, w, wy, k))
        split = best.feature >= 0
        if not split.any():
            break
        np.add.at(importance, best.feature[split], best.gain[split])
        number = np.cumsum(split) - 1
        feature, cut, left, _value = parts[-1]
        feature[:], cut[:] = best.feature, best.cut
        left[split] = size + 2 * number[split]
        kept = split[slot]
        codes, slot, w, wy = codes[:, kept], slot[kept], w[kept], wy[kept]
        side = codes[best.feature[slot], np.arange(len(slot))] > best.cut[slot]
        slot = 2 * number[slot] + side
        k = 2 * int(split.sum())
        size += k
        value = np.column_stack((best.sl / np.maximum(best.wl, 1e-300), best.sr / np.maximum(best.wr, 1e-300)))[split].ravel()
        parts.append((np.full(k, -1, "i2"), np.zeros(k, "u1"), np.full(k, -1, "i4"), value))
    return tuple(np.concatenate(p) for p in zip(*parts)), importance


def _splits(table: DataFrame, trees: dict[int, tuple], open_: dict[int, list[int]], width: int, used: list[int], seed: int) -> list:
    """One pass: the best splits (tree, and the fields of _Best) of the open nodes of some trees."""
    sizes = {t: len(open_[t]) for t in open_}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros((3, len(used), k, BINS)) for t, k in sizes.items()}
        for row, codes, y in _chunks(batches, width):
            starts = _runs(codes)
            codes = codes[used][:, starts]
            for t, total in sums.items():
                some, weight, wy = _sample(row, y, starts, t, seed)
                own = codes[:, some]
                slots = np.full(len(trees[t][0]), -1, "i8")
                slots[open_[t]] = np.arange(sizes[t])
                slot = slots[place(trees[t], own)]
                inside = slot >= 0
                own, slot, weight, wy = own[:, inside], slot[inside], weight[inside], wy[inside]
                for f in range(len(used)):
                    hw, hs = _histogram(slot, own[f], weight, wy, sizes[t])
                    total[0, f] += hw
                    total[1, f] += hs
                    total[2, f] += np.bincount(slot * BINS + own[f], minlength=sizes[t] * BINS).reshape(-1, BINS)
        for t, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["tree", "sums"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, part in zip(batch.column("tree").to_pylist(), batch.column("sums").to_pylist()):
                found = np.frombuffer(part).reshape(3, len(used), sizes[t], BINS)
                sums[t] = sums[t] + found if t in sums else found
        for t, total in sums.items():
            best = _Best(sizes[t])
            for f in range(len(used)):
                best.see(f, *total[:, f])
            names = ("gain", "feature", "cut", "wl", "sl", "wr", "sr", "nl", "nr")
            columns = [pa.array([getattr(best, n).astype("f8").tolist()], pa.list_(pa.float64())) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), *columns], ["tree", *names])

    parts = table.mapInArrow(add, "tree int, sums binary").repartition(len(sizes), "tree")
    fields = ", ".join(f"{n} array<double>" for n in ("gain", "feature", "cut", "wl", "sl", "wr", "sr", "nl", "nr"))
    return parts.mapInArrow(choose, f"tree int, {fields}").collect()  # one row for each tree


def fit_forest(
    table: DataFrame, n: int, width: int, used: Sequence[int], trees: int, depth: int, seed: int, keep: bool = False
) -> tuple[np.ndarray, list]:
    """Importance of the ``used`` features of a :func:`binned` table of ``n`` rows, adding
    up to one, and with ``keep`` the trees: (upper part, {leaf of it: the rest}).

    A tree has at most 2 ** ``depth`` leaves, whatever the table.
    """
    used = list(used)
    importance = np.zeros((trees, len(used)))
    tops = [Tree() for _ in range(trees)]
    unequal = _unequal(table, width)
    whole = n <= LOCAL or unequal <= LOCAL // UNEQUAL
    # Leaves still to grow, by the drawn rows they hold: in passes while large, in one task when small.
    large: dict[int, list[int]] = {t: [] if whole else [0] for t in range(trees)}
    small: dict[int, list[int]] = {t: [0] if whole else [] for t in range(trees)}
    level = {(t, 0): 0 for t in range(trees)}
    done = 0
    while done < depth and any(large.values()):
        fresh: dict[int, list[int]] = {t: [] for t in range(trees)}
        todo = [t for t in range(trees) if large[t]]
        while todo:
            group, bytes_ = [], 0
            while todo and (not group or bytes_ + len(large[todo[0]]) * len(used) * BINS * 24 <= HISTOGRAMS):
                bytes_ += len(large[todo[0]]) * len(used) * BINS * 24
                group.append(todo.pop(0))
            arrays = {t: tops[t].arrays() for t in group}
            for found in _splits(table, arrays, {t: large[t] for t in group}, width, used, seed):
                t = found["tree"]
                for i, node in enumerate(large[t]):
                    f = int(found["feature"][i])
                    if f < 0:
                        continue
                    importance[t, f] += found["gain"][i]
                    w, s = (found["wl"][i], found["wr"][i]), (found["sl"][i], found["sr"][i])
                    at = tops[t].split(node, f, int(found["cut"][i]), (s[0] / w[0], s[1] / w[1]))
                    for j in (0, 1):
                        level[t, at + j] = level[t, node] + 1
                        if level[t, at + j] < depth:
                            fits = w[j] <= LOCAL or found[("nl", "nr")[j]][i] <= LOCAL // UNEQUAL
                            (small if fits else fresh)[t].append(at + j)
        large, done = fresh, done + 1
    arrays = [t.arrays() for t in tops]
    rest: list[dict[int, tuple]] = [{} for _ in range(trees)]
    todo = [t for t in range(trees) if small[t]]
    turn = max(1, STANDING // (unequal * (len(used) + 12)))
    for at in range(0, len(todo), turn):
        own = {t: small[t] for t in todo[at : at + turn]}
        for row in _rests(table, arrays, own, level, unequal, width, used, depth, seed, keep).collect():  # bounded by the trees, not the rows
            importance[row["tree"]] += np.frombuffer(row["importance"])
            if keep:
                nodes = np.frombuffer(row["value"])
                parts = (np.frombuffer(row["feature"], "i2"), np.frombuffer(row["cut"], "u1"), np.frombuffer(row["left"], "i4"), nodes)
                rest[row["tree"]][row["node"]] = parts
        if len(todo) > turn:
            release_shuffles(table.sparkSession)
    total = importance.sum(axis=1, keepdims=True)
    share = np.divide(importance, total, out=np.zeros_like(importance), where=total > 0).sum(axis=0)
    return share / (share.sum() or 1.0), list(zip(arrays, rest))


def _unequal(table: DataFrame, width: int) -> int:
    """Rows that remain where those of equal bins in a chunk are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, codes, _ in _chunks(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array([len(_runs(codes))], pa.int64())], ["n"])

    return table.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 1


def _rests(table, arrays, small, level, n, width, used, depth, seed, keep) -> DataFrame:
    """The rest of each tree below its small nodes: (``tree``, ``node``, ``importance``, the tree's arrays)."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, codes, y in _chunks(batches, width):
            starts = _runs(codes)
            codes = codes[used][:, starts]
            for t in small:
                some, weight, wy = _sample(row, y, starts, t, seed)
                number = np.full(len(arrays[t][0]), -1, "i8")
                number[small[t]] = np.arange(len(small[t]))
                slot = number[place(arrays[t], codes[:, some])]
                order = np.argsort(slot, kind="stable")[np.count_nonzero(slot < 0) :]
                some, weight, wy = some[order], weight[order], wy[order]
                counts = np.bincount(slot[order], minlength=len(small[t]))
                columns = [
                    pa.array(np.full(len(counts), t, "i4")), pa.array(np.array(small[t], "i4")),
                    _binary(codes[:, some].T, counts * len(used)), _binary(wy, counts * 8), _binary(weight.astype("u4"), counts * 4),
                ]
                batch = pa.RecordBatch.from_arrays(columns, ["tree", "node", "codes", "wy", "w"])
                yield batch.filter(pa.array(counts > 0))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def result() -> pa.RecordBatch:
            codes = np.frombuffer(b"".join(h[0] for h in held), "u1").reshape(-1, len(used)).T
            wy, w = np.frombuffer(b"".join(h[1] for h in held)), np.frombuffer(b"".join(h[2] for h in held), "u4")
            nodes, importance = _grown(np.ascontiguousarray(codes), wy, w.astype("f8"), depth - level[now])
            nodes = [x.tobytes() if keep else b"" for x in nodes]
            values = [[now[0]], [now[1]], [importance.tobytes()], *[[x] for x in nodes]]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds)], ["tree", "node", "importance", "feature", "cut", "left", "value"]
            )

        for batch in batches:
            keys = zip(batch.column("tree").to_pylist(), batch.column("node").to_pylist())
            for i, key in enumerate(keys):
                if key != now and held:
                    yield result()
                    held = []
                now = key
                held.append(tuple(batch.column(c)[i].as_py() for c in ("codes", "wy", "w")))
        if held:
            yield result()

    spark = table.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, shuffle_width(spark), n * len(small) * (len(used) + 12) // SHARE)
    parts = min(parts, sum(map(len, small.values())))
    rows = table.mapInArrow(pack, "tree int, node int, codes binary, wy binary, w binary")
    rows = rows.repartition(int(parts), "tree", "node").sortWithinPartitions("tree", "node")
    return rows.mapInArrow(
        grow, "tree int, node int, importance binary, feature binary, cut binary, left binary, value binary"
    )


def predictions(df: DataFrame, names: Sequence[str], dep: str, cuts: list[np.ndarray], mean: float, model: list) -> DataFrame:
    """(``_y``, ``prediction``): the mean of the trees for each row."""
    rows = df.select(*[q(n).cast("double").alias(f"f{i}") for i, n in enumerate(names)], q(dep).cast("double").alias("_y"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def means(codes: np.ndarray) -> np.ndarray:
        total = np.zeros(codes.shape[1])
        for top, rest in shared.value:
            node = place(top, codes)
            value = top[3][node]
            order = np.argsort(node, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(node[order])) + 1) if len(order) else ():
                below = rest.get(int(node[own[0]]))
                if below is not None:
                    value[own] = below[3][place(below, codes[:, own])]
            total += value
        return mean + total / len(shared.value)

    def scored(y: list, codes: list) -> pa.RecordBatch:
        codes = np.concatenate(codes, axis=1)
        # Rows of equal bins share their way through the trees.
        order = np.lexsort(codes)
        starts = _runs(codes[:, order])
        out = np.empty(len(order))
        out[order] = np.repeat(means(codes[:, order[starts]]), np.diff(np.r_[starts, len(order)]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)), pa.array(out)], ["_y", "prediction"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, codes, size, most = [], [], 0, max(1, min(CHUNK, CODES // max(len(cuts), 1)))
        for batch in batches:
            if not batch.num_rows:
                continue
            codes.append(_codes(batch, cuts))
            y.append(batch.column("_y").to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size >= most:
                yield scored(y, codes)
                y, codes, size = [], [], 0
        if size:
            yield scored(y, codes)

    return rows.mapInArrow(run, "_y double, prediction double")
