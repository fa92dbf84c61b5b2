"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are compared as words. Karp-Rabin hashes of runs of
``MIN_MATCH`` words, rolled over each text, are looked up among the items'
hashes; the seeds that both sides share are joined. Seeds on one diagonal make
up the maximal common passages of a pair. The longest passage is marked again
and again, on both sides and without overlap, until none of ``MIN_MATCH`` words
is left. An item whose marked words reach ``COVERAGE`` of its length counts as
contained, in whatever order its passages stand in the text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q
from ..session import pin
from .common import ROW, Memo, by_group, column, group_starts, packed, unpacked

MIN_MATCH = 5
COVERAGE = 0.8
#: What counts as a word, and the base of the rolling hash.
TOKEN = re.compile(r"[^\W_]+")
BASE = 0x9E3779B97F4A7C15 | 1
#: Bits of the filter that is sent to all tasks: 2 MB, whatever the benchmark's size.
FILTER_BITS = 24
#: Pieces of text whose word hashes a worker remembers.
REMEMBER = 400_000


def _piece_hashes(piece: str) -> bytes:
    digests = (xxhash.xxh64_digest(w.encode("utf-8", "surrogatepass")) for w in TOKEN.findall(piece))
    return b"".join(digests)


_known = Memo(_piece_hashes, REMEMBER)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each lower-cased word of the text, in order."""
    pieces = text.lower().split() if text else []
    _known.claim()
    return np.frombuffer(b"".join(map(_known.__getitem__, pieces)), dtype="u8")


def seed_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``length`` words, as signed numbers."""
    reach = len(words) - length + 1
    if reach <= 0:
        return np.zeros(0, dtype="i8")
    total = np.full(reach, length, dtype="u8")
    for step in range(length):
        total = total * np.uint64(BASE) + words[step : step + reach]
    total ^= total >> np.uint64(32)
    return (total * np.uint64(BASE)).view("i8")


def _seeds_of_items(benchmark: DataFrame, item_column: str, text_column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, at, hashes, sizes, lengths = [], [], [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = word_hashes(text)
                if not len(words):
                    continue
                length = min(MIN_MATCH, len(words))
                found = seed_hashes(words, length)
                items += [item] * len(found)
                at += range(len(found))
                hashes += found.tolist()
                sizes += [len(words)] * len(found)
                lengths += [length] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, batch.column(0).type), pa.array(at, pa.int64()), pa.array(hashes, pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(lengths, pa.int64())],
                ["item_id", "item_at", "seed", "item_words", "seed_words"],
            )

    rows = benchmark.select(q(item_column).cast("long").alias("item_id"), q(text_column).alias("text"))
    rows = rows.where("item_id is not null")
    return rows.mapInArrow(run, "item_id long, item_at long, seed long, item_words long, seed_words long")


def _filter_of(seeds: DataFrame) -> np.ndarray:
    """One bit for each possible value of a seed's last bits; at most 512 rows of 4 KB."""
    bit = F.col("seed").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1
    parts = seeds.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part"))
    bits = np.zeros(1 << (FILTER_BITS - 3), dtype="u1")
    for part, data in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit"))).collect():
        bits[(part - 1) * 4096 : part * 4096] = np.frombuffer(bytes(data), dtype="u1")
    return bits


def _seeds_of_texts(df: DataFrame, id_column: str, text_column: str, seeds: DataFrame) -> DataFrame:
    """Seeds of all runs of the texts that may be among the items'."""
    lengths = sorted(r[0] for r in seeds.select("seed_words").distinct().collect())  # at most MIN_MATCH
    bits = df.sparkSession.sparkContext.broadcast(_filter_of(seeds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, low = bits.value, np.int64((1 << FILTER_BITS) - 1)
        for batch in batches:
            ids, keys, at, hashes = [], [], [], []
            for doc, key, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                words = word_hashes(text)
                for length in lengths:
                    found = seed_hashes(words, length)
                    low_bits = found & low
                    hit = np.flatnonzero(have[low_bits >> 3] >> (low_bits & 7).astype("u1") & 1)
                    ids += [doc] * len(hit)
                    keys += [key] * len(hit)
                    at += hit.tolist()
                    hashes += found[hit].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (ids, keys, at, hashes)], ["doc_id", "text_key", "doc_at", "seed"]
            )

    rows = df.select(
        q(id_column).cast("long").alias("doc_id"), F.xxhash64(q(text_column)).alias("text_key"), q(text_column).alias("text")
    )
    return rows.where("doc_id is not null").mapInArrow(run, "doc_id long, text_key long, doc_at long, seed long")


def common_passages(doc_at: np.ndarray, item_at: np.ndarray, seed_words: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal common passages (text position, item position, words) from seeds."""
    order = np.lexsort((doc_at, doc_at - item_at))
    d, i, n = doc_at[order], item_at[order], seed_words[order]
    starts = np.flatnonzero(np.r_[True, (np.diff(d - i) != 0) | (np.diff(d) > 1)])
    ends = np.r_[starts[1:], len(d)] - 1
    return [(int(d[a]), int(i[a]), int(d[b] - d[a] + n[b])) for a, b in zip(starts, ends)]


def greedy_tiles(passages: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Longest passages first, none overlapping another on either side; a passage
    that is partly taken goes on with what is left of it."""
    heap = [(-n, d, i) for d, i, n in passages]
    heapq.heapify(heap)
    doc_marks: set[int] = set()
    item_marks: set[int] = set()
    tiles = []
    while heap:
        n, d, i = heapq.heappop(heap)
        run, pieces = 0, []
        for step in range(-n + 1):
            if step < -n and d + step not in doc_marks and i + step not in item_marks:
                run += 1
                continue
            if run >= least:
                pieces.append((d + step - run, i + step - run, run))
            run = 0
        if pieces and pieces[0][2] == -n:
            tiles.append(pieces[0])
            doc_marks.update(range(d, d - n))
            item_marks.update(range(i, i - n))
        else:
            for a, b, size in pieces:
                heapq.heappush(heap, (-size, a, b))
    return tiles


def _tile_pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    names = ("doc_id", "text_key", "item_id", "doc_at", "item_at", "item_words", "seed_words")
    doc, key, item, doc_at, item_at, words, seed_words = (column(table, c) for c in names)
    starts = group_starts(doc, key, item)
    out = []
    for a, b in zip(starts, [*starts[1:], len(doc)]):
        tiles = greedy_tiles(common_passages(doc_at[a:b], item_at[a:b], seed_words[a:b]), int(seed_words[a]))
        marked = sum(n for _, _, n in tiles)
        out.append(
            (int(doc[a]), int(key[a]), int(item[a]), marked, int(words[a]), marked / int(words[a]), len(tiles),
             max((n for _, _, n in tiles), default=0))
        )
    kinds = (pa.int64(),) * 5 + (pa.float64(),) + (pa.int64(),) * 2
    yield pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(zip(*out), kinds)],
        ["doc_id", "text_key", "item_id", "matched", "item_words", "coverage", "tiles", "longest"],
    )


def tiled_pairs(
    df: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Each text and item that share a seed: ``doc_id, text_key`` (hash of the
    text), ``item_id``, ``matched`` and ``item_words``, ``coverage``, ``tiles``
    and ``longest``.

    Null and empty texts and items match nothing; an item of fewer words than
    ``MIN_MATCH`` is one seed. Rows without an id cannot be reported and are
    passed over. Equal rows give one result. Empty tables give an empty result.
    """
    seeds = pin(_seeds_of_items(benchmark, item_column, item_text), "seeds")
    found = _seeds_of_texts(df, id_column, text_column, seeds)
    # Most runs of a text meet no item; what is left is joined exactly.
    joined = found.join(seeds, "seed").select(
        "doc_id", "text_key", "item_id", "doc_at", "item_at", "item_words", "seed_words"
    )
    joined = joined.distinct()
    return by_group(
        joined, ["doc_id", "text_key", "item_id"], ["doc_at", "item_at"], _tile_pairs,
        "doc_id long, text_key long, item_id long, matched long, item_words long, coverage double, tiles long, longest long",
    )


def contaminated(df: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, **columns: str) -> DataFrame:
    """The pairs of :func:`tiled_pairs` that cover ``coverage`` of the item."""
    return tiled_pairs(df, benchmark, **columns).where(F.col("coverage") >= coverage)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The input without the texts that contain an item, with or without ids."""
    key = F.xxhash64(q(text_column))
    texts = df.select(key.alias("doc_id"), q(text_column).alias("text"))
    items = benchmark.select(F.xxhash64(q("text")).alias("item_id"), q("text").alias("text"))
    bad = pin(contaminated(texts, items).select("text_key").distinct(), "contaminated")
    rows = packed(df, key.alias("_key"))
    clean = rows.join(bad, F.col("_key") == F.col("text_key"), "left_anti")
    return unpacked(clean.select(ROW), df.columns)
