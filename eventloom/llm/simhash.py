"""SimHash near-duplicates with covering locality-sensitive hashing.

A text's fingerprint has 64 bits; two fingerprints link when at most ``RADIUS``
bits differ. Bit positions carry fixed non-zero vectors of ``RADIUS + 1`` bits;
for each non-zero vector v, a mask keeps the positions whose vector has odd
parity with v. The differing positions of a linked pair span at most ``RADIUS``
dimensions, so some v is orthogonal to all of them and that mask hides every
difference: each pair within the radius shares a bucket in at least one of the
31 tables, without exception.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q
from ..session import pin
from .common import ROW, by_group, column, group_starts, packed, release, unpacked
from .components import components, local_roots

RADIUS = 4
SHINGLE = 4
#: Fixed value: seed of the shingle hash.
SEED = 42
#: Buckets with more distinct fingerprints are hashed once more on their free bits.
HOT_BUCKET = 4096

_TABLES = 2 ** (RADIUS + 1) - 1


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``size`` lower-cased words, in order."""
    words = text.lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return np.zeros(0, dtype="u8")
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), "i8", len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    reach = min(size, len(words))
    spans = zip(starts[: len(words) - reach + 1].tolist(), ends[reach - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "u8", len(words) - reach + 1)


def fingerprint_of(text: bytes | None) -> int:
    """The 64-bit fingerprint as a signed number; 0 for a text without words."""
    hashes = shingle_hashes(text) if text else np.zeros(0, dtype="u8")
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype="i8")
    for at in range(0, len(hashes), 65_536):
        block = hashes[at : at + 65_536].view("u1").reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text column, on its UTF-8 bytes."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        release()
        return pa.array([fingerprint_of(t) for t in texts.to_pylist()], pa.int64())

    return run(text.cast("binary"))


def _family(positions: list[int]) -> list[int]:
    """The covering masks over some bit positions, one for each non-zero vector."""
    vector = {bit: i % _TABLES + 1 for i, bit in enumerate(positions)}
    masks = []
    for v in range(1, _TABLES + 1):
        mask = 0
        for bit, own in vector.items():
            mask |= ((own & v).bit_count() & 1) << bit
        masks.append(mask)
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def covering_masks() -> list[int]:
    # 37 is odd: neighbouring bits get unlike vectors.
    return _family([i * 37 % 64 for i in range(64)])


def _second_masks() -> list[tuple[int, int, int]]:
    """(table, sub-table, mask): a first mask widened by one over its free bits."""
    out = []
    for v, mask in enumerate(covering_masks(), 1):
        free = [i * 29 % 64 for i in range(64)]
        for w, more in enumerate(_family([b for b in free if not mask >> b & 1]), 1):
            out.append((v, w, _signed(mask | more)))
    return out


def _bucket_edges(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links inside sorted buckets as (member, root): one row per linked member,
    however many pairs a bucket holds."""
    prints = column(table, "f")
    starts = group_starts(column(table, "v"), column(table, "w"), column(table, "k"))
    size = len(prints)
    sizes = np.diff(np.append(starts, size))
    end = np.repeat(starts + sizes, sizes)
    parent = np.arange(size)
    left = np.arange(size)
    unsigned = prints.view("u8")
    for step in range(1, int(sizes.max(initial=1))):
        left = left[left + step < end[left]]
        close = np.bitwise_count(unsigned[left] ^ unsigned[left + step]) <= RADIUS
        if close.any():
            parent = local_roots(size, left[close], left[close] + step, parent)
    linked = np.flatnonzero(parent != np.arange(size))
    yield pa.RecordBatch.from_arrays(
        [pa.array(prints[linked]), pa.array(prints[parent[linked]])], ["a", "b"]
    )


def fingerprint_edges(prints: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) whose closure is that of all pairs within the radius,
    for a table of distinct fingerprints ``f``."""
    masks = F.array(
        *[
            F.struct(F.lit(v).alias("v"), F.col("f").bitwiseAND(F.lit(_signed(m))).alias("k"))
            for v, m in enumerate(covering_masks(), 1)
        ]
    )
    rows = prints.select("f", F.explode(masks).alias("t")).select("t.v", "t.k", "f")
    sizes = rows.groupBy("v", "k").agg(
        F.count(F.lit(1)).alias("n"), F.min("f").alias("a"), F.max("f").alias("b")
    )
    shared = pin(sizes.where("n > 1"), "buckets")
    pairs = shared.where("n = 2").select("a", "b")
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    full = rows.join(shared.where("n > 2").select("v", "k", "n"), ["v", "k"])
    plain = full.where(F.col("n") <= HOT_BUCKET).select("v", F.lit(0).alias("w"), "k", "f")
    # A bucket shares its masked bits; half of the others are fixed as well in a
    # sub-bucket, which leaves at most about 2**17 different values.
    second = prints.sparkSession.createDataFrame(_second_masks(), "v int, w int, m long")
    hot = (
        full.where(F.col("n") > HOT_BUCKET)
        .join(F.broadcast(second), "v")  # 961 fixed rows
        .select("v", "w", F.col("f").bitwiseAND(F.col("m")).alias("k"), "f")
    )
    inside = by_group(plain.unionAll(hot), ["v", "w", "k"], ["f"], _bucket_edges, "a long, b long")
    return pairs.unionAll(inside)


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id among all documents reachable by links.

    Null and empty texts have fingerprint zero and link like any other. Rows
    that repeat an id give as many result rows. Null ids never name a component
    unless all its ids are null. An empty table gives an empty result.
    """
    prints = pin(
        df.select(q(id_column).alias("doc_id"), fingerprint(q(text_column)).alias("f")), "prints"
    )
    firsts = pin(prints.groupBy("f").agg(F.min("doc_id").alias("first")), "firsts")
    roots = components(fingerprint_edges(firsts.select("f")))
    linked = firsts.join(roots, firsts["f"] == roots["node"], "left").select(
        "f", "first", F.coalesce("component", "f").alias("root")
    )
    names = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    # Written, so that a fingerprint with very many documents can be split below.
    named = pin(linked.join(names, "root").select(F.col("f").alias("g"), "component_id"), "named")
    return prints.join(named, F.col("f") == F.col("g")).select(
        "doc_id",
        F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def drop_near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The input with one document of each group, that of the smallest id.

    Rows that share an id are one document, of which one row stays; rows
    without an id cannot be named and stay.
    """
    found = near_duplicates(df, id_column, text_column)
    lost = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    rows = packed(df, q(id_column).alias("_id"))
    rows = rows.join(lost, F.col("_id") == F.col("doc_id"), "left_anti")
    twice = df.where(q(id_column).isNotNull()).groupBy(q(id_column)).agg(F.count(F.lit(1)).alias("_n"))
    if not twice.where("_n > 1").isEmpty():
        rows = rows.where("_id is not null").dropDuplicates(["_id"]).unionAll(rows.where("_id is null"))
    return unpacked(rows.select(ROW), df.columns)
