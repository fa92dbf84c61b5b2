"""Periodic runs of words: stretches that repeat the same few words over and over.

A run is a stretch of consecutive words with smallest period q that is at least
``LEAST`` words and ``TURNS`` periods long and that no neighbouring word extends
with the same period.

The words of a text go through a suffix automaton. Its suffix links form a tree
in which the nodes above the node of a prefix stand for all suffixes of that
prefix. The tree is cut into paths of one colour, the end of the last prefix that
passed there, kept as splay trees: appending word ``i`` is the access operation
of a link-cut tree, which gathers the path from the prefix's node to the root
and recolours it with ``i``. For each piece of another colour ``e`` that it meets,
the deepest node tells how many words the prefixes ending at ``e`` and ``i`` have in
common; where they reach over the distance ``i - e``, a square ends at ``i``. The
squares of one distance and one start, taken to the last of their ends, are a run.

Each run of the length asked for holds, at every place, some ``GRAM`` words that
stand twice in the text. Only stretches of such places are passed through the
automaton; all others cannot belong to a run.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run's least words, and its least length in periods.
LEAST = 24
TURNS = 3
#: Words that must stand twice around each place of a run. A run of ``LEAST`` words
#: and ``TURNS`` periods reaches ``GRAM`` words and one period to one side of each of its places.
GRAM = 8
#: Words that are marked at a time.
CHUNK = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)

SPANS = "array<struct<start:long,length:long,period:long>>"


def _automaton(words: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Length and suffix link of the automaton's states, and each prefix's state."""
    length, link, after, prefixes = [0], [-1], [{}], []
    last = 0
    for word in words:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        after.append({})
        prefixes.append(new)
        state = last
        while state >= 0 and word not in after[state]:
            after[state][word] = new
            state = link[state]
        if state >= 0:
            found = after[state][word]
            if length[state] + 1 == length[found]:
                link[new] = found
            else:
                twin = len(length)
                length.append(length[state] + 1)
                link.append(link[found])
                after.append(after[found].copy())
                while state >= 0 and after[state].get(word) == found:
                    after[state][word] = twin
                    state = link[state]
                link[found] = link[new] = twin
        last = new
    return length, link, prefixes


def squares(words: Sequence[int]) -> dict[tuple[int, int], int]:
    """Last end of the squares of each (period, start) with a primitive period.

    The start is that of the whole stretch with that period.
    """
    length, up, prefixes = _automaton(words)
    # The root is node 0 and stands for "nothing above"; it never joins a path.
    up[0] = 0
    size = len(length)
    left, right = [0] * size, [0] * size
    colour = [-1] * size  # of the path, held at the root of its splay tree
    found: dict[tuple[int, int], int] = {}

    def rotate(x: int, y: int) -> None:
        z = up[y]
        if left[z] == y and z:
            left[z] = x
        elif right[z] == y and z:
            right[z] = x
        else:
            colour[x] = colour[y]
        if left[y] == x:
            inner = left[y] = right[x]
            right[x] = y
        else:
            inner = right[y] = left[x]
            left[x] = y
        if inner:
            up[inner] = y
        up[y] = x
        up[x] = z

    def splay(x: int) -> None:
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                if (left[z] == y) == (left[y] == x):
                    rotate(y, z)
                else:
                    rotate(x, y)
                    rotate(x, up[x])
                    continue
            rotate(x, y)

    for end, node in enumerate(prefixes):
        below, at = 0, node
        while at:
            splay(at)
            before = colour[at]
            # Nodes deeper than ``at`` keep their colour as a path of their own.
            if right[at]:
                colour[right[at]] = before
            right[at] = below
            if before >= 0:
                period = end - before
                if period <= length[at]:
                    found[period, before - length[at] + 1] = end
            below, at = at, up[at]
        splay(node)
        colour[node] = end
    return found


def _marked(texts: Sequence[Sequence[bytes]]) -> list[np.ndarray]:
    """For each text, whether the ``GRAM`` words from each place on stand twice in it."""
    sizes = np.fromiter(map(len, texts), "i8", len(texts))
    total = int(sizes.sum())
    hashes = np.fromiter((hash(w) for words in texts for w in words), "i8", total).view("u8")
    reach = max(0, total - GRAM + 1)
    # Hashes only choose places; the automaton compares words.
    grams = np.repeat(np.arange(1, len(texts) + 1, dtype="u8"), sizes)[:reach] * _ODD
    with np.errstate(over="ignore"):
        for step in range(GRAM):
            grams = (grams ^ (grams >> np.uint64(31))) * _ODD + hashes[step : step + reach]
    ends = np.repeat(np.cumsum(sizes), sizes)[:reach]
    valid = np.flatnonzero(np.arange(GRAM, GRAM + reach) <= ends)
    grams = grams[valid]
    slots = (grams >> np.uint64(42)).astype("i8")
    twice = np.flatnonzero(np.bincount(slots, minlength=1)[slots] > 1) if len(slots) else slots
    order = twice[np.argsort(grams[twice])]
    same = grams[order[1:]] == grams[order[:-1]]
    mark = np.zeros(total, dtype=bool)
    mark[valid[order[1:][same]]] = True
    mark[valid[order[:-1][same]]] = True
    return np.split(mark, np.cumsum(sizes)[:-1])


def _stretches(mark: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mark.view("i1"), [0]))))
    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if last - first > LEAST - GRAM:
            yield first, last + GRAM - 1


def _runs(words: Sequence[bytes], mark: np.ndarray) -> list[tuple[int, int, int]]:
    runs = []
    for first, last in _stretches(mark):
        number: dict[bytes, int] = {}
        numbers = [number.setdefault(w, len(number)) for w in words[first:last]]
        for (period, start), end in squares(numbers).items():
            size = end - start + 1
            if size >= LEAST and size >= TURNS * period:
                runs.append((first + start, size, period))
    return sorted(runs, key=lambda run: (run[0], run[2]))


def runs_of(texts: Sequence[bytes | None]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs (start, length, period) of each text, by start, then period."""
    held: list[list[bytes]] = []
    size = 0
    for place, text in enumerate(texts):
        held.append(text.split() if text else [])  # bytes: only ASCII white space parts words
        size += len(held[-1])
        if size >= CHUNK or place == len(texts) - 1:
            for words, mark in zip(held, _marked(held)):
                yield words, _runs(words, mark) if mark.any() else []
            held, size = [], 0


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        keep = bytearray(b"\1") * len(words)
        for start, size, period in runs:
            keep[start + period : start + size] = bytes(size - period)
        words = [w for w, kept in zip(words, keep) if kept]
    return b" ".join(words)


def runs(text: Column) -> Column:
    """Struct of ``runs`` (array of start, length and period in words, by start,
    then period) and ``collapsed``, the words of the text joined by single blanks
    without those that any run holds after its first period.

    Null, empty and blank texts have no runs and an empty ``collapsed``. Every
    place of equal runs counts; rows that repeat give equal results. Memory grows
    with the longest stretch of repeated words of one text, by about 1 KB a word.
    """

    @F.arrow_udf(f"struct<runs:{SPANS},collapsed:binary>")
    def run(texts: pa.Array) -> pa.Array:
        spans, kept = [], []
        for words, found in runs_of(texts.to_pylist()):
            spans.append([dict(zip(("start", "length", "period"), r)) for r in found])
            kept.append(_collapsed(words, found))
        span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        return pa.StructArray.from_arrays(
            [pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], ["runs", "collapsed"]
        )

    return run(text.cast("binary"))


def strongest(found: Column) -> Column:
    """The run with the most periods; ties: the smallest start, then period. Null without runs."""
    ranked = F.transform(
        found,
        # Quotients of whole numbers below 2**26 are equal as doubles only where they are equal.
        lambda r: F.struct((r["length"] / r["period"]).alias("turns"), -r["start"], -r["period"], r.alias("run")),
    )
    return F.array_max(ranked)["run"]


def digest(found: Column) -> Column:
    """The runs as lines ``start,length,period``."""
    line = F.transform(found, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return F.array_join(line, "")


def with_planted_tail(doc_id: Column, text: Column) -> Column:
    """The text, for one in ten ids with a tail that repeats some of its words.

    With h the unsigned crc32 of the decimal id and n words: where h % 10 = 0,
    each word i >= a becomes word a + (i - a) % p, a = (h div 10) % n,
    p = 1 + floor((n - a) / (3 + (h div 10) % 8)). A null id changes nothing.
    """

    @F.arrow_udf("binary")
    def run(ids: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array(map(_planted, ids.to_pylist(), texts.to_pylist()), pa.binary())

    return run(doc_id.cast("string"), text.cast("binary"))


def _planted(doc_id: str | None, text: bytes | None) -> bytes | None:
    tens, rest = divmod(zlib.crc32(doc_id.encode()), 10) if doc_id else (0, 1)
    if rest or not text:
        return text
    words = text.split()
    if not words:
        return text
    start = tens % len(words)
    tail = len(words) - start
    period = 1 + tail // (3 + tens % 8)
    unit = words[start : start + period]
    return b" ".join(words[:start] + (unit * (tail // period + 1))[:tail])
