"""Passages that repeat across documents, by prefix-partitioned suffix trees.

A window of ``WINDOW`` words repeats if it also starts in a document with a smaller
id; the words it covers are removed. Suffixes are dealt to tasks by prefixes, and
each task sorts its suffixes into a tree, in which the leaves below a node of
``WINDOW`` words or more are the places of one repeat.

Not all suffixes travel. A window's anchor is the run of ``ANCHOR`` words with the
smallest hash in it, the same in equal windows, so suffixes that start at windows
of one anchor share a prefix group. A first pass counts the texts of each anchor:
groups of a single text hold no repeat and are left out, and groups with more than
``GROUP`` occurrences get longer prefixes, whole windows, whose smallest id is an
aggregate that needs no tree. Windows of one anchor overlap and travel together as
one piece of text. Copies of a whole text go through the tree once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q
from ..session import pin, release_shuffles
from .common import by_group, release

#: Fixed value: words of a window.
WINDOW = 13
#: Words of a window's anchor.
ANCHOR = 6
#: Occurrences of an anchor that one task sorts at most.
GROUP = 200_000

#: Bytes of text that are hashed at a time.
CHUNK = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)
_RUNS = WINDOW - ANCHOR + 1  # runs of ANCHOR words in a window

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTES = np.random.default_rng(13).integers(1, 2**63, 256, dtype="u8")
_POWERS = np.random.default_rng(17).integers(1, 2**63, 4096, dtype="u8") | np.uint64(1)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and a hash of each word of a piece of text.

    Hashes only deal suffixes out; the trees compare words.
    """
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    total = np.concatenate(([0], np.cumsum(lengths)))
    inside = np.arange(total[-1]) - np.repeat(total[:-1], lengths)
    letters = _BYTES[data[~space]] * _POWERS[inside & (len(_POWERS) - 1)]
    sums = np.concatenate((np.zeros(1, dtype="u8"), np.cumsum(letters)))
    return starts, sums[total[1:]] - sums[total[:-1]] + lengths.astype("u8")


def _anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text, for each of its windows, the hash of its anchor and the
    anchor's place; many texts at a time."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= CHUNK:
            yield from _anchors_of_some(held)
            held, size = [], 0
    yield from _anchors_of_some(held)


def _anchors_of_some(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data = np.frombuffer(b" ".join(texts), dtype="u1")
    begins, hashes = _word_hashes(data)
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    firsts = np.searchsorted(begins, offsets)
    reach = max(0, len(hashes) - ANCHOR + 1)
    runs = np.full(reach, ANCHOR, dtype="u8")
    for step in range(ANCHOR):
        runs = (runs ^ (runs >> np.uint64(29))) * _ODD + hashes[step : step + reach]
    runs = (runs ^ (runs >> np.uint64(32))) * _ODD
    # The smallest hash of a window; of equal ones the first: the place fills the low bits.
    bits = np.uint64(max(1, reach).bit_length())
    least = (runs >> bits << bits) | np.arange(reach, dtype="u8")
    wide = 1
    while wide < _RUNS:
        more = min(wide, _RUNS - wide)
        least = np.minimum(least[: max(0, len(least) - more)], least[more:])
        wide += more
    places = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype("i8")
    chosen = runs[places].view("i8")
    for start, end in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        windows = max(0, end - start - WINDOW + 1)
        yield chosen[start : start + windows], places[start : start + windows] - start


def _pieces(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each occurrence of an anchor."""
    first = np.flatnonzero(np.r_[len(places) > 0, places[1:] != places[:-1]])
    return first, np.diff(np.append(first, len(places)))


def _anchors_of_texts(docs: DataFrame) -> DataFrame:
    """(``anchor``, ``key``, ``_id``, ``places``): each anchor of a row of ``docs``, and how often it has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, often = [np.zeros(0, dtype="i8")], [np.zeros(0, dtype="i8")]
            for hashes, places in _anchors(batch.column(2).to_pylist()):
                own, counts = np.unique(hashes[_pieces(places)[0]], return_counts=True)
                found.append(own)
                often.append(counts)
            sizes = [len(x) for x in found[1:]]
            ids, keys = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), sizes) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.concatenate(found), keys, ids, np.concatenate(often))],
                ["anchor", "key", "_id", "places"],
            )

    return docs.mapInArrow(run, "anchor long, key long, _id long, places long")


def _windows_of_texts(flagged: DataFrame) -> DataFrame:
    """Pieces of text around the anchors named in ``shared``; windows one by one
    around those in ``hot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids, keys, texts, all_shared, all_hot = (batch.column(i).to_pylist() for i in range(5))
            for doc_id, key, text, shared, hot, (hashes, places) in zip(ids, keys, texts, all_shared, all_hot, _anchors(texts)):
                words = text.split()
                first, count = _pieces(places)
                own = hashes[first]
                wanted = np.flatnonzero(np.isin(own, np.array(shared, dtype="i8")))
                single = np.isin(own[wanted], np.array(hot, dtype="i8")) if hot else np.zeros(len(wanted), dtype=bool)
                # Equal pieces of one text travel once, with all their places.
                known: dict[tuple[int, bytes], list[int]] = {}
                for i, alone in zip(wanted.tolist(), single.tolist()):
                    at, n = int(first[i]), int(count[i])
                    if alone:
                        for s in range(at, at + n):
                            known.setdefault((0, b" ".join(words[s : s + WINDOW])), [int(own[i])]).append(s)
                    else:
                        known.setdefault((n, b" ".join(words[at : at + n + WINDOW - 1])), [int(own[i])]).append(at)
                rows += [(at[0], doc_id, key, at[1:], n, piece) for (n, piece), at in known.items()]
                if len(rows) > 20_000:
                    yield _piece_batch(rows)
                    rows = []
            yield _piece_batch(rows)

    return flagged.mapInArrow(run, "anchor long, _id long, key long, at array<long>, windows long, words binary")


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], ["anchor", "_id", "key", "at", "windows", "words"]
    )


def _repeats_in_groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The suffix trees of whole prefix groups: words that a smaller id has as well."""
    ids, keys, at, windows = (table.column(c).to_pylist() for c in ("_id", "key", "at", "windows"))
    suffixes: list[bytes] = []
    depths: list[int] = []  # length in bytes of the first WINDOW words
    owners: list[tuple[int, int]] = []
    for row, (text, n) in enumerate(zip(table.column("words").to_pylist(), windows)):
        words = text.split(b" ")
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        text += b" "  # ends the last word, so that equal prefixes sort together
        start = 0
        for j in range(n):
            suffixes.append(text[start:])
            depths.append(ends[j + WINDOW - 1] - start)
            owners.append((row, j))
            start = ends[j]
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    covered: list[list[int]] = [[] for _ in ids]
    node: list[int] = []
    prefix = None

    def close() -> None:
        least = min(ids[owners[leaf][0]] for leaf in node)
        for leaf in node:
            row, j = owners[leaf]
            if ids[row] > least:
                covered[row].append(j)

    for leaf in order:
        own = suffixes[leaf][: depths[leaf]]
        if own != prefix:
            if len(node) > 1:
                close()
            node, prefix = [], own
        node.append(leaf)
    if len(node) > 1:
        close()
    out: list[tuple[int, int, int, int]] = []
    for row, found in enumerate(covered):
        for j in sorted(found):
            for place in at[row]:
                first, last = place + j, place + j + WINDOW
                if out and out[-1][:2] == (ids[row], keys[row]) and out[-1][2] <= first <= out[-1][3]:
                    out[-1] = (*out[-1][:3], last)
                else:
                    out.append((ids[row], keys[row], first, last))
    columns = list(zip(*out)) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["_id", "key", "first", "last"])


def _repeats(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """(``_id``, ``key``, ``first``, ``last``): stretches of words to remove."""
    anchors = _anchors_of_texts(docs.where("_id is not null and text is not null"))
    shared = anchors.groupBy("anchor").agg(
        F.min("key").alias("a"), F.max("key").alias("b"), F.sum("places").alias("n")
    )
    # Written, so that the join below can split an anchor that very many texts have.
    shared = pin(shared.where("a < b").select("anchor", "n"), "anchors")
    release_shuffles(docs.sparkSession)
    hot = F.when(F.col("n") > GROUP, F.col("anchor"))
    named = anchors.join(shared, "anchor").select("_id", "key", "anchor", hot.alias("hot"))
    named = named.join(copies, ["_id", "key"], "left_anti")
    # A text's own anchors: no more than it has words.
    flags = named.groupBy("_id", "key").agg(F.collect_set("anchor").alias("shared"), F.collect_set("hot").alias("hot"))
    flags = pin(flags, "flags")
    release_shuffles(docs.sparkSession)
    pieces = _windows_of_texts(docs.join(flags, ["_id", "key"]).select("_id", "key", "text", "shared", "hot"))
    schema = "_id long, key long, first long, last long"
    if shared.where(F.col("n") > GROUP).isEmpty():
        return by_group(pieces, ["anchor"], ["_id"], _repeats_in_groups, schema)
    pieces = pin(pieces, "pieces")
    trees = by_group(pieces.where("windows > 0"), ["anchor"], ["_id"], _repeats_in_groups, schema)
    alone = pieces.where("windows = 0").select("words", "_id", "key", F.explode("at").alias("at"))
    least = alone.groupBy("words").agg(F.min("_id").alias("least"), F.max("_id").alias("most"))
    least = pin(least.where("least < most").select("words", "least"), "least")
    long_ones = alone.join(least, "words").where(F.col("_id") > F.col("least"))
    return trees.unionAll(long_ones.select("_id", "key", F.col("at").alias("first"), (F.col("at") + WINDOW).alias("last")))


def _kept(text: Column, spans: Column) -> Column:
    """Struct of ``n_words``, ``n_removed`` and ``kept``; a span that starts before
    word 0 takes all words of a text that has a window."""

    @F.arrow_udf("struct<n_words:long,n_removed:long,kept:binary>")
    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        release()
        totals, removed, kept = [], [], []
        for text, own in zip(texts.to_pylist(), found.to_pylist()):
            words = text.split() if text else []
            n = len(words)
            if own:
                keep = bytearray(b"\1") * n
                for span in own:
                    first, last = span["first"], min(span["last"], n)
                    if first < 0:
                        first, last = 0, n if n >= WINDOW else 0
                    keep[first:last] = bytes(last - first)
                words = [w for w, k in zip(words, keep) if k]
            totals.append(n)
            removed.append(n - len(words))
            kept.append(b" ".join(words))
        return pa.StructArray.from_arrays(
            [pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
            ["n_words", "n_removed", "kept"],
        )

    return run(text, spans)


def without_repeats(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the
    words left joined by single blanks (UTF-8 bytes).

    Null and empty texts have no words. Rows without an id keep all words and take
    none from others; rows that share an id take none from each other, whatever
    their texts. Rows that repeat give as many results. An empty table gives an
    empty result.
    """
    text = q(text_column).cast("binary")
    docs = df.select(
        q(id_column).cast("long").alias("_id"), F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("check"), text.alias("text")
    )
    keys = docs.where("_id is not null and text is not null").select("_id", "key", "check")
    firsts = keys.groupBy("key", "check").agg(F.min("_id").alias("least"), F.max("_id").alias("most"))
    # Written, so that the join can split the copies of one text.
    firsts = pin(firsts.where("least < most").select("key", "check", "least"), "firsts")
    copies = pin(
        keys.join(firsts, ["key", "check"]).where(F.col("_id") > F.col("least")).select("_id", "key").distinct(), "copies"
    )
    docs = docs.drop("check")
    whole = copies.select("_id", "key", F.lit(-1).cast("long").alias("first"), F.lit(0).cast("long").alias("last"))
    spans = _repeats(docs, copies).unionAll(whole)
    # Stretches of one text: no more than it has words.
    spans = spans.groupBy("_id", "key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    # Written, so that the texts and pieces of the search leave the disks before the texts are shuffled again.
    spans = pin(spans, "spans")
    release_shuffles(df.sparkSession)
    joined = docs.join(spans, ["_id", "key"], "left")
    found = joined.select("_id", _kept(F.col("text"), F.col("spans")).alias("found"))
    return found.select(F.col("_id").alias("doc_id"), "found.*")
