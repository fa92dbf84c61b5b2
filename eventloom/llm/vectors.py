"""Near-duplicate vectors by range search over a robust-pruned flat graph.

Vectors go to their ``OVERLAP`` nearest cluster centres. Each cluster shard
builds its part of the graph: near and random candidates of a vector are pruned
so that no kept neighbour lies much nearer to another one. The adjacency lists
that a vector has in its shards are united. Every vector is then searched in
each of its shards: a greedy beam search from the shard's medoid (and the
vector's own node), which goes on through all neighbours of whatever it finds in
range. Links are verified in double precision; a pair that shares several shards
counts in the smallest of them, so that no pair is ever sent anywhere.

Equal vectors are one node with a count. Shards larger than ``BLOCK`` are split
into index blocks, and their queries into as many chunks, each chunk searched in
each block. Recall is audited against brute force on ``AUDIT`` vectors; below
``RECALL`` the shards are built again with twice the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q
from ..session import pin
from .common import by_group, column
from .components import components, local_roots

COSINE = 0.9
#: Vectors that the centres are fitted on, rounds of fitting, centres at most.
SAMPLE_ROWS, ROUNDS, MOST_CENTRES = 16_384, 5, 8_192
#: Centres nearer to each other than this become one, so that a dense group has one.
SAME_CENTRE = 0.7
OVERLAP, SHARD_ROWS, BLOCK = 4, 2_000, 4_096
#: Graph: near and random candidates, kept neighbours, slack of the pruning rule.
NEAR, RANDOM, DEGREE, ALPHA = 48, 16, 16, 1.2
BEAM = 8
AUDIT, RECALL = 512, 0.9


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as unit vectors in double precision."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype("f8")
    return unit(flat.reshape(len(values), -1)) if len(values) else np.zeros((0, 1))


def usable(vector: Column, size: int) -> Column:
    """Neither null nor zero, ``size`` finite components, none of them null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == size) & ~bad & F.exists(vector, lambda x: x != 0)


def fit_centres(nodes: DataFrame, count: int, overlap: int) -> np.ndarray:
    """Spherical k-means on a sample drawn by id hash, dense centres united."""
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE_ROWS).select("v").toArrow()
    points = _matrix(sample.column("v"))
    want = min(max(1, -(-count * overlap // SHARD_ROWS)), MOST_CENTRES, len(points))

    def apart(centres: np.ndarray) -> np.ndarray:
        keep: list[int] = []
        near = centres @ centres.T >= SAME_CENTRE
        for i in range(len(centres)):
            if not near[i, keep].any():
                keep.append(i)
        return centres[keep]

    centres = apart(points[:want])
    for _ in range(ROUNDS):
        best = np.concatenate([(points[a : a + 2048] @ centres.T).argmax(axis=1) for a in range(0, len(points), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, best, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1.0), centres)
    return apart(centres)


def _assigned(nodes: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """Nodes with ``shards``, their nearest centres in ascending order."""
    take = min(overlap, len(centres))
    table = nodes.sparkSession.sparkContext.broadcast(centres.astype("f4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("v")).astype("f4")
            near = np.zeros((len(points), take), dtype="i4")
            for a in range(0, len(points), 1024):
                sims = points[a : a + 1024] @ table.value.T
                near[a : a + 1024] = np.sort(np.argpartition(-sims, take - 1, axis=1)[:, :take], axis=1)
            offsets = np.arange(len(points) + 1, dtype="i4") * take
            lists = pa.ListArray.from_arrays(offsets, near.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "shards"])

    kinds = dict(nodes.dtypes)
    return nodes.mapInArrow(run, f"node long, n long, v {kinds['v']}, shards array<int>")


def prune(near: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Robust pruning of candidates sorted by distance: which ones stay.

    ``near`` has each row's distances to its candidates (infinite: none),
    ``between`` the candidates' distances to each other.
    """
    rows = np.arange(len(near))
    alive = np.isfinite(near)
    kept = np.zeros_like(alive)
    for _ in range(DEGREE):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        kept[rows[some], first[some]] = True
        alive &= ~(some[:, None] & (ALPHA * between[rows, first] <= near))
        alive[rows, first] = False
    return kept


def build_graph(points: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of the pruned graph over unit vectors, both ways."""
    size = len(points)
    draw = np.random.default_rng(seed)
    small = points.astype("f4")
    sources, targets, gaps = [], [], []
    for a in range(0, size, 256):
        block = small[a : a + 256]
        gap = 2.0 - 2.0 * (block @ small.T)
        gap[np.arange(len(block)), np.arange(a, a + len(block))] = np.inf
        near = min(NEAR, size - 1)
        if near <= 0:
            break
        ids = np.argpartition(gap, near - 1, axis=1)[:, :near]
        ids = np.concatenate([ids, draw.integers(0, size, size=(len(block), RANDOM))], axis=1)
        own = np.take_along_axis(gap, ids, axis=1)
        order = np.argsort(own, axis=1, kind="stable")
        ids, own = np.take_along_axis(ids, order, axis=1), np.take_along_axis(own, order, axis=1)
        picked = small[ids]
        between = 2.0 - 2.0 * np.matmul(picked, picked.transpose(0, 2, 1))
        row, place = np.nonzero(prune(own, between))
        sources.append(row + a)
        targets.append(ids[row, place])
        gaps.append(own[row, place])
    if not sources:
        return np.zeros(0, dtype="i8"), np.zeros(0, dtype="i8")
    source, target, gap = np.concatenate(sources), np.concatenate(targets), np.concatenate(gaps)
    # Of the reverse edges each node takes its nearest, at most as many as its own.
    order = np.lexsort((gap, target))
    back, to = target[order], source[order]
    first = np.searchsorted(back, back)
    few = np.arange(len(back)) - first < DEGREE
    return np.concatenate([source, back[few]]), np.concatenate([target, to[few]])


def range_search(
    points: np.ndarray, lists: np.ndarray, queries: np.ndarray, own: np.ndarray, cosine: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, point) in range that the graph leads to.

    ``lists`` has each point's neighbours, padded with -1; ``own`` the query's
    own node or -1. All queries advance together.
    """
    small, asked = points.astype("f4"), queries.astype("f4")
    size, many = len(points), len(queries)
    mean = small.mean(axis=0)
    medoid = int((small @ mean).argmax())
    rows = np.arange(many)
    seen = np.zeros((many, size + 1), dtype=bool)  # the last column stands for "no neighbour"
    seen[:, size] = True
    entry = np.stack([np.full(many, medoid), np.where(own >= 0, own, medoid)], axis=1)
    entry[own == medoid, 1] = -1
    entry[own < 0, 1] = -1
    entry = np.where(entry < 0, size, entry)
    found_q, found_p, found_s = [], [], []

    def visit(who: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Similarities of new ids (rows of equal length), -2 for others."""
        fresh = ~seen[who[:, None], ids]
        # The same id twice in a row counts once.
        order = np.argsort(ids, axis=1, kind="stable")
        ordered = np.take_along_axis(ids, order, axis=1)
        again = np.zeros_like(fresh)
        np.put_along_axis(again, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], axis=1)
        fresh &= ~again
        sims = np.full(ids.shape, -2.0, dtype="f4")
        r, c = np.nonzero(fresh)
        if len(r):
            sims[r, c] = np.einsum("ij,ij->i", asked[who[r]], small[ids[r, c]])
            seen[who[r], ids[r, c]] = True
            close = sims[r, c] >= cosine - 1e-4
            found_q.append(who[r[close]])
            found_p.append(ids[r[close], c[close]])
        return sims

    beam, gain = entry, visit(rows, entry)
    open_ = gain > -2
    padded = np.where(lists < 0, size, lists)
    while True:
        value = np.where(open_, gain, -3.0)
        best = value.argmax(axis=1)
        live = rows[value[rows, best] > -2.5]
        if not len(live):
            break
        open_[live, best[live]] = False
        ids = padded[beam[live, best[live]]]
        sims = visit(live, ids)
        wide_ids = np.concatenate([beam[live], ids], axis=1)
        wide = np.concatenate([gain[live], sims], axis=1)
        state = np.concatenate([open_[live], sims > -2], axis=1)
        top = np.argsort(-wide, axis=1, kind="stable")[:, :BEAM]
        if beam.shape[1] < top.shape[1]:
            more = top.shape[1] - beam.shape[1]
            beam = np.concatenate([beam, np.full((many, more), size)], axis=1)
            gain = np.concatenate([gain, np.full((many, more), -2.0, dtype="f4")], axis=1)
            open_ = np.concatenate([open_, np.zeros((many, more), dtype=bool)], axis=1)
        beam[live] = np.take_along_axis(wide_ids, top, axis=1)
        gain[live] = np.take_along_axis(wide, top, axis=1)
        open_[live] = np.take_along_axis(state, top, axis=1)
    # Range expansion: neighbours of all that is in range, until nothing is new.
    done = 0
    while done < len(found_q):
        who, ids = np.concatenate(found_q[done:]), np.concatenate(found_p[done:])
        done = len(found_q)
        for a in range(0, len(who), 8192):
            w, near = who[a : a + 8192], padded[ids[a : a + 8192]]
            new = ~seen[w[:, None], near]
            r, c = np.nonzero(new)
            if not len(r):
                continue
            pair = np.unique(w[r].astype("i8") * (size + 1) + near[r, c])
            asker, point = pair // (size + 1), pair % (size + 1)
            seen[asker, point] = True
            close = np.einsum("ij,ij->i", asked[asker], small[point]) >= cosine - 1e-4
            if close.any():
                found_q.append(asker[close])
                found_p.append(point[close])
    if not found_q:
        return np.zeros(0, dtype="i8"), np.zeros(0, dtype="i8")
    return np.concatenate(found_q), np.concatenate(found_p)


def _graph_rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
    shard, block, node = (column(table, c) for c in ("shard", "block", "node"))
    points = _matrix(table.column("v"))
    starts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (block[1:] != block[:-1])])
    for a, b in zip(starts, [*starts[1:], len(shard)]):
        source, target = build_graph(points[a:b], int(shard[a]) * 1_000_003 + int(block[a]))
        order = np.argsort(source, kind="stable")
        source, target = source[order], target[order]
        offsets = np.searchsorted(source, np.arange(b - a + 1)).astype("i4")
        lists = pa.ListArray.from_arrays(offsets, node[a:b][target])
        yield pa.RecordBatch.from_arrays([pa.array(node[a:b]), lists], ["node", "near"])


def _search_rows(cosine: float):
    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = ("shard", "block", "chunk", "node", "n", "indexed", "asked")
        shard, block, chunk, node, n, indexed, asked = (column(table, c) for c in names)
        points = _matrix(table.column("v"))
        shards = table.column("shards").combine_chunks()
        shards = shards.flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
        near = table.column("near").combine_chunks()
        new = (shard[1:] != shard[:-1]) | (block[1:] != block[:-1]) | (chunk[1:] != chunk[:-1])
        starts = np.flatnonzero(np.r_[True, new])
        for a, b in zip(starts, [*starts[1:], len(node)]):
            base = np.arange(a, b)[indexed[a:b]]
            ask = np.arange(a, b)[asked[a:b]]
            if not len(base) or not len(ask):
                continue
            # Neighbours that stand in this block, as positions.
            inside = near.take(pa.array(base))
            flat = inside.flatten().to_numpy(zero_copy_only=False)
            counts = np.asarray(inside.value_lengths().fill_null(0))
            owner = np.repeat(np.arange(len(base)), counts)
            place = np.minimum(np.searchsorted(node[base], flat), len(base) - 1)
            here = node[base][place] == flat
            owner, place = owner[here], place[here]
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
            lists = np.full((len(base), int(rank.max(initial=0)) + 1), -1)
            lists[owner, rank] = place
            own = np.minimum(np.searchsorted(node[base], node[ask]), len(base) - 1)
            own = np.where(node[base][own] == node[ask], own, -1)
            pairs_q, pairs_p = [], []
            for at in range(0, len(ask), 512):
                some = ask[at : at + 512]
                qi, pi = range_search(points[base], lists, points[some], own[at : at + 512], cosine)
                x, y = some[qi], base[pi]
                sure = np.zeros(len(x), dtype=bool)
                for c in range(0, len(x), 65_536):
                    part = slice(c, c + 65_536)
                    sure[part] = np.einsum("ij,ij->i", points[x[part]], points[y[part]]) >= cosine
                sure &= node[x] != node[y]
                pairs_q.append(x[sure])
                pairs_p.append(y[sure])
            x, y = np.concatenate(pairs_q), np.concatenate(pairs_p)
            if len(base) == len(ask) == b - a:  # a link found from either side holds for both
                code = np.unique(np.concatenate([(x - a) * (b - a) + (y - a), (y - a) * (b - a) + (x - a)]))
                x, y = code // (b - a) + a, code % (b - a) + a
            links = np.zeros(b - a)
            for c in range(0, len(x), 65_536):
                xs, ys = x[c : c + 65_536], y[c : c + 65_536]
                common = (shards[xs][:, :, None] == shards[ys][:, None, :]).any(axis=2)
                first = np.where(common, shards[xs], np.iinfo("i4").max).min(axis=1)
                mine = first == shard[a]
                np.add.at(links, xs[mine] - a, n[ys[mine]])
            root = local_roots(b - a, x - a, y - a)
            out = np.flatnonzero((links > 0) | (root != np.arange(b - a)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[a:b][out]), pa.array(node[a:b][root[out]]), pa.array(links[out].astype("i8"))],
                ["a", "b", "links"],
            )

    return work


def _found(nodes: DataFrame, centres: np.ndarray, overlap: int, cosine: float) -> DataFrame:
    """Rows (``a``, ``b``: a node and one it is linked with, ``links``: its part of the count)."""
    placed = pin(_assigned(nodes, centres, overlap), "placed")
    members = placed.withColumn("shard", F.explode("shards"))
    sizes = members.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    sizes = pin(sizes.select(F.col("shard").alias("of"), F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), "shards")
    members = members.join(sizes, F.col("shard") == F.col("of")).drop("of")
    own = F.pmod(F.xxhash64("node", "shard"), "blocks").cast("int")
    members = members.withColumn("own", own)
    parts = by_group(
        members.select("shard", F.col("own").alias("block"), "node", "v"), ["shard", "block"], ["node"], _graph_rows,
        "node long, near array<bigint>",
    )
    graph = pin(parts.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    ready = members.join(graph, "node")
    # One block: a row is index and query at once. Otherwise each index block
    # meets each chunk of queries, so that no task holds the whole shard.
    numbers = F.sequence(F.lit(0), F.col("blocks") - 1)
    index = ready.withColumn("chunk", F.explode(numbers)).withColumn("block", F.col("own"))
    index = index.withColumn("indexed", F.lit(True)).withColumn("asked", F.col("blocks") == 1)
    asks = ready.where("blocks > 1").withColumn("block", F.explode(numbers)).withColumn("chunk", F.col("own"))
    asks = asks.withColumn("indexed", F.lit(False)).withColumn("asked", F.lit(True))
    names = ["shard", "block", "chunk", "node", "n", "indexed", "asked", "v", "shards"]
    rows = index.select(*names, "near").unionAll(asks.select(*names, F.array().cast("array<bigint>").alias("near")))
    return by_group(rows, ["shard", "block", "chunk"], ["node", "indexed"], _search_rows(cosine), "a long, b long, links long")


def _audited(nodes: DataFrame, counts: DataFrame, cosine: float) -> float:
    """Share of the links of ``AUDIT`` vectors, drawn by hash, that were found."""
    sample = nodes.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(AUDIT).select("node", "v").toArrow()
    if not sample.num_rows:
        return 1.0
    ids, asked = column(sample, "node"), _matrix(sample.column("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), dtype="i8")
        for batch in batches:
            points, weights = _matrix(batch.column("v")), column(batch, "n")
            for a in range(0, len(points), 4096):
                total += (asked @ points[a : a + 4096].T >= cosine) @ weights[a : a + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["node", "true"])

    truth = nodes.mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    own = nodes.select("node", "n").join(F.broadcast(truth), "node")  # AUDIT rows
    found = own.join(counts, "node", "left").select(
        (F.col("true") - F.col("n")).alias("true"), F.coalesce("links", F.lit(0)).alias("found")
    )
    true, hit = found.agg(F.coalesce(F.sum("true"), F.lit(0)), F.coalesce(F.sum(F.least("true", "found")), F.lit(0))).first()
    return hit / true if true else 1.0


def near_vectors(
    df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` and ``audit_recall`` per input row.

    Vectors that are null or zero, hold null or non-finite components, or differ
    in length from most others have no links and are their own component, as are
    rows without an id. Rows that repeat link with each other. An empty table
    gives an empty result.
    """
    rows = df.select(q(id_column).cast("long").alias("vec_id"), q(vector_column).alias("v"))
    lengths = rows.where("v is not null").groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), "size").first()
    size = common["size"] if common else 0
    good = rows.where(usable(F.col("v"), size) & F.col("vec_id").isNotNull()) if size else rows.where("false")
    nodes = pin(good.groupBy("v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")).select("node", "n", "v"), "nodes")
    count = nodes.count()
    empty = df.sparkSession.createDataFrame([], "node long, links long, component_id long")
    recall = 1.0
    result = empty
    overlap = OVERLAP
    while count:
        centres = fit_centres(nodes, count, overlap)
        found = pin(_found(nodes, centres, overlap, cosine), "found")
        counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        counts = pin(counts, "links")
        recall = _audited(nodes, counts, cosine)
        if recall < RECALL and overlap < len(centres):
            overlap *= 2
            continue
        roots = components(found.select("a", "b")).withColumnRenamed("node", "of")
        linked = counts.join(roots, F.col("node") == F.col("of"), "left")
        result = linked.select("node", "links", F.coalesce("component", "node").alias("component_id"))
        break
    named = nodes.join(result.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select(
        F.col("v").alias("w"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component_id", "node").alias("component_id"),
    )
    named = pin(named, "named")
    # Unusable vectors meet no node: they are not among the grouped ones.
    joined = rows.join(named, (F.col("v") == F.col("w")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
        F.lit(recall).alias("audit_recall"),
    )
