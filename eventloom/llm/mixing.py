"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be copied target / size times. Whole copies
are given out at once; the fractions left are paired, and words are moved from
one fraction to the other at random until one of the two is 0 or 1. A move keeps
the pair's sum of words, and the expected share of each.

Pairs are of like size: inside buckets of bounded size, classes of sizes within a
power of two are paired one after another, the largest first. The one fraction that
a class leaves is rounded at random, and the words it is then over or short are
taken from or given to the shares of all smaller documents of the bucket, in
proportion, before those are paired. Where the smaller ones cannot take them up it
stays a fraction. What is left goes up a tree of merged buckets, ``FAN_IN`` at a
time. In the last bucket each fraction goes the way that the smaller ones can make
good best, so a source ends within the size of its smallest fractions of its target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q
from ..operators.ordering import with_position
from ..session import pin
from .common import ROW, by_group, column, word_count

#: Weights of the sources in code-point order, repeating, and the
#: largest multiple of its size that a source is used for.
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SEED = 7
#: Documents in a bucket of the first round, on average, and buckets merged at once.
BUCKET_ROWS = 4096
FAN_IN = 64


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source_no`` and ``target`` for a table of sources (``source``, ``source_size``).

    Targets share the sum of all sizes by weight. A source stops at ``most``
    times its size; the rest is shared again by weight until none is above.
    Only totals come to the driver, one row per round.
    """
    named = sizes.withColumn("missing", F.col("source").isNull())
    ranked = with_position(named, [], ["missing", "source"], "source_no").drop("missing")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    ranked = pin(ranked.withColumn("weight", weight), "sources")
    cap = F.col("source_size") * most
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full = -1.0, -1
    while True:
        above = cap <= F.lit(level) * F.col("weight")
        held, count, rest = ranked.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)),
            F.count(F.when(above, 1)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        if count == full or not rest:
            break
        full, level = count, (total - held) / rest
    return ranked.withColumn(
        "target",
        F.when(cap <= F.lit(level) * F.col("weight"), cap.cast("double")).otherwise(F.lit(level) * F.col("weight")),
    ).drop("weight")


def _draws(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the rows' keys alone."""
    x = keys.view("u8") ^ np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype("f8") / 2.0**53


def pivot(shares: np.ndarray, sizes: np.ndarray, draws: np.ndarray) -> int:
    """Round ``shares`` to 0 or 1 in place, keeping the sum of share x size; the place
    of the one share that may be left, or -1."""
    held = -1
    for i in np.flatnonzero((shares > 0) & (shares < 1)).tolist():
        if held < 0:
            held = i
            continue
        ratio = sizes[held] / sizes[i]
        up = min(1.0 - shares[held], shares[i] / ratio)
        down = min(shares[held], (1.0 - shares[i]) / ratio)
        if draws[i] * (up + down) < down:
            full = up == 1.0 - shares[held]
            other = shares[i] - up * ratio
            shares[held], shares[i] = (1.0, min(max(other, 0.0), 1.0)) if full else (shares[held] + up, 0.0)
        else:
            empty = down == shares[held]
            other = shares[i] + down * ratio
            shares[held], shares[i] = (0.0, min(max(other, 0.0), 1.0)) if empty else (shares[held] - down, 1.0)
        if 0.0 < shares[i] < 1.0:
            held = i
        elif not 0.0 < shares[held] < 1.0:
            held = -1
    return held


def round_bucket(shares: np.ndarray, sizes: np.ndarray, draws: np.ndarray, last: bool) -> np.ndarray:
    """Round the shares of documents that stand by falling size; what the smaller
    ones cannot make good stays a fraction, unless this is the ``last`` bucket."""
    out = shares.astype("f8")
    classes = np.frexp(sizes)[1]
    starts = np.flatnonzero(np.r_[len(out) > 0, classes[1:] != classes[:-1]])
    for first, end in zip(starts.tolist(), [*starts[1:].tolist(), len(out)]):
        held = pivot(out[first:end], sizes[first:end], draws[first:end])
        if held < 0:
            continue
        held += first
        share, size = out[held], sizes[held]
        rest, weight = out[end:], sizes[end:]
        open_ = (rest > 0) & (rest < 1)
        can_give = float((rest * weight)[open_].sum())
        can_take = float(((1 - rest) * weight)[open_].sum())
        # Words that stay over or short if the share goes up or down.
        over, short = (1 - share) * size - can_give, share * size - can_take
        if over <= 0 and short <= 0:
            full = draws[held] < share
        elif last:
            full = max(over, 0.0) < max(short, 0.0) or (over == short and share >= 0.5)
        else:
            continue
        out[held] = float(full)
        if full and can_give:
            rest[open_] *= max(0.0, 1 - (1 - share) * size / can_give)
        elif not full and can_take:
            rest[open_] += (1 - rest[open_]) * min(1.0, share * size / can_take)
    return out


def _round_groups(level: int, last: bool):
    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        shares, sizes = column(table, "share").astype("f8"), column(table, "size")
        draws = _draws(column(table, "key"), level + 1)
        source, bucket = column(table, "source_no"), column(table, "bucket")
        starts = np.flatnonzero(np.r_[True, (source[1:] != source[:-1]) | (bucket[1:] != bucket[:-1])])
        for a, b in zip(starts, [*starts[1:], len(shares)]):
            shares[a:b] = round_bucket(shares[a:b], sizes[a:b], draws[a:b], last)
        at = table.column_names.index("share")
        yield from table.set_column(at, "share", pa.array(shares)).to_batches()

    return work


def mix(
    df: DataFrame,
    source_column: str = "source",
    text_column: str = "text",
    id_column: str = "doc_id",
    keep: list[str] | None = None,
) -> DataFrame:
    """Each input row packed (its columns ``keep``, or all), with ``size``,
    ``source_size``, ``target`` and ``copies``.

    A row's draws come from a hash of its id, size and text, so reruns and other
    partitionings agree; rows alike in all three may change places. Null is a
    source of its own. Texts without words, null ones included, get no copies; a
    source of such texts has target 0. An empty table gives an empty result.
    """
    # Written once: the rounding moves row numbers and sizes, the rows are joined back.
    rows = pin(
        df.select(
            F.struct(*[q(c) for c in (df.columns if keep is None else keep)]).alias(ROW),
            q(source_column).alias("source"),
            word_count(q(text_column)).alias("size"),
            F.xxhash64(q(id_column), q(text_column), F.lit(SEED)).alias("key"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "rows",
    )
    sums = pin(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    targets = source_targets(sums)
    targets = pin(targets.withColumnRenamed("source", "named"), "targets")
    times = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    narrow = rows.drop(ROW).join(targets, F.col("source").eqNullSafe(F.col("named"))).withColumn("times", times)
    narrow = narrow.withColumn("share", F.col("times") - F.floor("times"))
    fractions = narrow.where("share > 0").select("row_no", "key", "size", "source_no", "share")
    rounded = _rounded(fractions)
    # Rows of a source with a whole number of copies were in no bucket.
    up = rows.join(rounded, "row_no", "left").join(targets, F.col("source").eqNullSafe(F.col("named")))
    copies = F.floor(times).cast("long") + F.coalesce(F.col("share"), F.lit(0.0)).cast("long")
    return up.select(ROW, "size", "source_size", "target", copies.alias("copies"))


def _rounded(fractions: DataFrame) -> DataFrame:
    """(``row_no``, ``share``) with shares of 0 and 1."""
    often = pin(fractions.groupBy("key").count().where("count > 1").select("key"), "often")
    if often.isEmpty():
        placed = fractions.withColumn("turn", F.lit(0).cast("long"))
    else:  # equal keys are told apart by their number, so that they spread over buckets
        again = with_position(fractions.join(often, "key", "left_semi"), ["key"], ["row_no"], "turn")
        placed = fractions.join(often, "key", "left_anti").withColumn("turn", F.lit(0).cast("long")).unionByName(again)
    n = fractions.count()
    buckets = max(1, math.ceil(n / BUCKET_ROWS))
    draw = F.xxhash64("key", "turn")
    table = placed.select(
        "row_no", draw.alias("key"), "size", "source_no", "share",
        F.pmod(draw, F.lit(buckets)).alias("bucket"), (-F.col("size")).alias("falling"),
    )
    done: list[DataFrame] = []
    level = 0
    while True:
        last = buckets == 1
        step = by_group(table, ["source_no", "bucket"], ["falling", "key"], _round_groups(level, last), table.schema)
        step = pin(step, "rounded")
        open_ = (F.col("share") > 0) & (F.col("share") < 1)
        done.append(step.where(~open_).select("row_no", "share"))
        if last:
            break
        buckets = math.ceil(buckets / FAN_IN)
        table = step.where(open_).withColumn("bucket", F.col("bucket") % buckets)
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def repeat_to_targets(df: DataFrame, source_column: str = "source", text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The mixed corpus: each row as often as :func:`mix` copies it (0 to 3 times)."""
    mixed = mix(df, source_column, text_column, id_column).where("copies > 0")
    again = mixed.select(ROW, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return again.select(*[F.col(ROW)[c].alias(c) for c in df.columns])
