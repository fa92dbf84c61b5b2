"""Spelling variants: words one edit apart, grouped under the commonest form.

Two words are near if they differ by exactly one inserted, deleted or replaced
letter. An edit changes the numbers of a word's letters by one up, one down or
both, so the words of each length are held in a k-d tree over their letter counts
and a word searches the trees of its own length and of the next one for boxes
within one up and, in its own length, one down. The upper splits are tables: all
nodes of a level choose theirs in one aggregate, and words pass them by a join. A
leaf has a bounded number of letters; inside it a local tree prunes further, and
the order of the letters decides.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import q
from ..operators.ordering import spread
from ..session import drop_scratch, pin, pin_at
from .common import by_group, column, group_starts, release

#: Letters of a word, its least length and its least number of occurrences.
SHORTEST = 5
RAREST = 3
LETTERS = re.compile(f"[a-zÀ-ÿ]{{{SHORTEST},}}")
#: Fixed value: a form has at least this many times the occurrences of its variant.
TIMES = 2
#: Fixed value: one of so many pairs of document and word loses a letter, see :func:`word_counts`.
SPOILED = 97

#: A tree's node is split while its words have more letters than this together.
LEAF_LETTERS = 1 << 15
#: Words of a node of the local tree that are compared without further boxes.
FEW = 24
#: Letters are counted in so many dimensions; those that share one only weaken the pruning.
DIMENSIONS = 32
#: Different words that a task holds before it hands its counts on.
HELD = 200_000


def _lowered(text: str) -> str:
    """A-Z in lower case, all else unchanged."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def word_counts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", spoiled: int = 0) -> DataFrame:
    """``word`` and ``n``, the occurrences of each word of ``SHORTEST`` letters or more.

    With ``spoiled``, a word whose crc32 of ``<id>:<word>`` it divides loses the letter
    at that number modulo its length; ids that are null spoil nothing. Null and empty
    texts have no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            words, numbers = list(total), list(total.values())
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(numbers, pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = LETTERS.findall(_lowered(text)) if text else []
                if not words:
                    continue
                if not spoiled or doc_id is None:
                    total.update(words)
                else:
                    start = zlib.crc32(f"{doc_id}:".encode())
                    own = Counter(words)
                    for word in list(own):
                        h = zlib.crc32(word.encode(), start)
                        if h % spoiled == 0:
                            at = h % len(word)
                            total[word[:at] + word[at + 1 :]] += own.pop(word)
                    total.update(own)
                if len(total) > HELD:
                    yield counted()
        if total:
            yield counted()

    rows = df.select(q(id_column).cast("string"), q(text_column)).mapInArrow(run, "word string, n long")
    return rows.where(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.sum("n").alias("n"))


def _count(word: Column, letter: Column) -> Column:
    return F.char_length(word) - F.char_length(F.replace(word, letter, F.lit("")))


def _splits(placed: DataFrame) -> DataFrame:
    """For each node that is too large, the letter and count that part its words most evenly."""
    node = ["size", "path"]
    large = placed.groupBy(*node).agg(F.count(F.lit(1)).alias("total"))
    large = large.where((F.col("total") > 1) & (F.col("total") * F.col("size") > LEAF_LETTERS))
    letters = placed.select(*node, "word", F.explode(F.array_distinct(F.split("word", ""))).alias("letter"))
    letters = letters.where("letter <> ''").join(large.select(*node), node, "left_semi")
    counts = letters.groupBy(*node, "letter", _count(F.col("word"), F.col("letter")).alias("least")).agg(
        F.count(F.lit(1)).alias("own")
    )
    # One row for each count of a letter that occurs in a node: as few as a word has letters.
    upward = Window.partitionBy(*node, "letter").orderBy(F.col("least").desc())
    counts = counts.withColumn("right", F.sum("own").over(upward)).join(large, node)
    even = F.struct(F.abs(F.col("total") - 2 * F.col("right")), "letter", "least").alias("even")
    best = counts.where("right < total").groupBy(*node).agg(F.min(even).alias("best"))
    return best.select(*node, "best.letter", "best.least")


def _placed(words: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Words with ``size`` and ``path``, their leaf, and the splits of each level."""
    spark = words.sparkSession
    node = ["size", "path"]
    placed, path = pin_at(
        words.select("word", "n", F.char_length("word").alias("size"), F.lit(1).cast("long").alias("path")), "leaves"
    )
    levels: list[DataFrame] = []
    while True:
        splits, splits_path = pin_at(_splits(placed), "splits")
        if splits.isEmpty():
            drop_scratch(spark, splits_path)
            return placed, levels
        levels.append(splits)
        right = (_count(F.col("word"), F.col("letter")) >= F.col("least")).cast("long")
        below = F.when(F.col("letter").isNull(), F.col("path")).otherwise(2 * F.col("path") + right)
        # A node without a split keeps its path; it cannot grow too large again.
        deeper, deeper_path = pin_at(
            placed.join(splits, node, "left").select("word", "n", "size", below.alias("path")), "leaves"
        )
        drop_scratch(spark, path)
        placed, path = deeper, deeper_path


def _routed(words: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Each word with all leaves whose boxes an edit can reach.

    ``up`` and ``down`` are the letters that a near word in that box must have once
    more or once less.
    """
    size = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("size"), F.lit(1).cast("long").alias("path"))
    none = F.lit("")
    rows = rows.select("*", none.alias("up"), F.when(F.col("size") > size, F.lit("-")).otherwise(none).alias("down"))
    for splits in levels:
        joined = rows.join(splits, ["size", "path"], "left")
        count = _count(F.col("word"), F.col("letter")) + (
            (F.col("up") == F.col("letter")).cast("int") - (F.col("down") == F.col("letter")).cast("int")
        )
        # A letter that has been raised or lowered has a known count from there on.
        free = (F.col("up") != F.col("letter")) & (F.col("down") != F.col("letter"))
        at_most, at_least = count < F.col("least"), count >= F.col("least")
        # Of two words of one length, that with the later letter asks.
        raised = free & (F.col("up") == "") & (count + 1 == F.col("least"))
        raised &= F.col("down").isin("", "-") | (F.col("letter") < F.col("down"))
        lowered = free & (F.col("down") == "") & (count == F.col("least")) & (F.col("up") < F.col("letter"))

        def to(way: int, reached: Column, moved: Column, up: Column, down: Column) -> Column:
            return F.when(
                reached | moved,
                F.struct(
                    (2 * F.col("path") + way).alias("path"),
                    F.when(reached, F.col("up")).otherwise(up).alias("up"),
                    F.when(reached, F.col("down")).otherwise(down).alias("down"),
                ),
            )

        letter = F.col("letter")
        ways = F.when(letter.isNull(), F.array(F.struct("path", "up", "down"))).otherwise(
            F.array_compact(
                F.array(
                    to(0, at_most, lowered, F.col("up"), letter),
                    to(1, at_least, raised, letter, F.col("down")),
                )
            )
        )
        rows = joined.select("word", "n", "size", F.explode(ways).alias("way")).select(
            "word", "n", "size", "way.path", "way.up", "way.down"
        )
    return rows.select("word", "n", "size", "path")


def _codes(words: list[str], size: int) -> np.ndarray:
    """Letters of words of one length as numbers."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype="u1").reshape(len(words), size)


def _letter_counts(codes: np.ndarray) -> np.ndarray:
    """Letter counts by dimension; from 255 on as 255, which no edit moves by more than one."""
    counts = np.zeros((len(codes), DIMENSIONS), dtype="i4")
    rows = np.arange(len(codes))
    for place in range(codes.shape[1]):
        np.add.at(counts, (rows, codes[:, place] % DIMENSIONS), 1)
    return np.minimum(counts, 255).astype("i2")


def _within(counts: np.ndarray, low: np.ndarray, high: np.ndarray, longer: bool) -> np.ndarray:
    """Whether an edit takes the counts into the box."""
    up = np.maximum(low - counts, 0).sum(axis=-1)
    down = np.maximum(counts - high, 0).sum(axis=-1)
    return (up <= 1) & (down <= (0 if longer else 1))


def _candidates(data: np.ndarray, asked: np.ndarray, longer: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of data and asked words whose letter counts are within an edit."""
    open_nodes = [(np.arange(len(data)), np.arange(len(asked)))]
    while open_nodes:
        own, who = open_nodes.pop()
        points = data[own]
        low, high = points.min(axis=0), points.max(axis=0)
        who = who[_within(asked[who], low, high, longer)]
        if not len(who):
            continue
        if len(own) <= FEW or not (low < high).any():
            # A block at a time: words alike in all letters may be many.
            step = max(1, (1 << 16) // len(own))
            for at in range(0, len(who), step):
                some = who[at : at + step]
                a, b = np.nonzero(_within(asked[some][:, None, :], points[None], points[None], longer))
                if len(a):
                    yield own[b], some[a]
            continue
        middle = np.median(points, axis=0)
        share = np.abs((points > middle).mean(axis=0) - 0.5)
        share[low == high] = 1
        letter = int(np.argmin(share))
        right = points[:, letter] > min(middle[letter], high[letter] - 1)
        open_nodes += [(own[right], who), (own[~right], who)]


def _one_edit(data: np.ndarray, asked: np.ndarray, replaced: bool) -> np.ndarray:
    """Whether words of two tables, row by row, are one edit apart. Of two words of
    one length, only that with the later letter finds the other."""
    if replaced:
        apart = data != asked
        at = apart.argmax(axis=1)[:, None]
        earlier = np.take_along_axis(data, at, 1) < np.take_along_axis(asked, at, 1)
        return (apart.sum(axis=1) == 1) & earlier[:, 0]
    size = asked.shape[1]
    first = np.logical_and.accumulate(data[:, :size] == asked, axis=1).sum(axis=1)
    last = np.logical_and.accumulate((data[:, 1:] == asked)[:, ::-1], axis=1).sum(axis=1)
    return first + last >= size


def _near_in_leaf(table: pa.Table) -> Iterator[pa.RecordBatch]:
    starts = group_starts(column(table, "size"), column(table, "path"))
    for first, last in zip(starts, [*starts[1:], table.num_rows]):
        leaf = table.slice(first, last - first)
        kinds, size = column(leaf, "asks"), int(leaf.column("size")[0].as_py())
        held = leaf.slice(0, int(np.searchsorted(kinds, 1)))
        if not held.num_rows:
            continue
        held_words, held_n = held.column("word").to_pylist(), column(held, "n")
        codes = _codes(held_words, size)
        counts = _letter_counts(codes)
        for kind in (1, 2):  # words of the leaf's own length, and shorter ones
            a, b = np.searchsorted(kinds, [kind, kind + 1])
            if a == b:
                continue
            who = leaf.slice(int(a), int(b - a))
            who_words, who_n = who.column("word").to_pylist(), column(who, "n")
            who_codes = _codes(who_words, size - kind + 1)
            good = [
                (own[ok], asked[ok])
                for own, asked in _candidates(counts, _letter_counts(who_codes), kind == 2)
                for ok in [_one_edit(codes[own], who_codes[asked], kind == 1)]
                if ok.any()
            ]
            if not good:
                continue
            own, asked = (np.concatenate(x) for x in zip(*good))
            left, right = [held_words[i] for i in own], [who_words[i] for i in asked]
            pairs = [pa.array(left + right), pa.array(right + left), pa.array(np.concatenate((who_n[asked], held_n[own])))]
            yield pa.RecordBatch.from_arrays(pairs, ["word", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (``word``, ``near``, ``near_n``), both ways, of a table of different words."""
    placed, levels = _placed(words)
    asked = _routed(spread(placed.select("word", "n")), levels)
    shorter = (F.char_length("word") < F.col("size")).cast("int") + 1
    rows = placed.select("size", "path", F.lit(0).alias("asks"), "word", "n").unionAll(
        asked.select("size", "path", shorter.alias("asks"), "word", "n")
    )
    return by_group(rows, ["size", "path"], ["asks"], _near_in_leaf, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """The last word that each of ``word`` reaches along ``form``.

    Occurrences at least double with each step, so the way has no circle; each
    round doubles the steps taken, and one without change ends it.
    """
    spark = forms.sparkSession
    table, path = pin_at(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_step = table.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        joined = table.join(next_step, F.col("root") == F.col("at"), "left")
        fresh, fresh_path = pin_at(
            joined.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")),
            "roots",
        )
        drop_scratch(spark, path)
        table, path = fresh.select("word", "root"), fresh_path
        if fresh.where("moved").isEmpty():
            return table


def variants(counts: DataFrame) -> DataFrame:
    """One row for each ``word`` of a table of different words with their counts ``n``.

    ``n_near``: its near words; ``form``: that of the largest count (ties: the first in
    code-point order), if it has ``TIMES`` the word's count or more, else null, and
    ``form_n``, its count; ``root``: the last word along the forms, the word itself
    without one. Words have letters up to U+00FF. An empty table gives an empty result.
    """
    words = pin(counts.select("word", "n"), "words")
    near = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best")
    )
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.col1") >= TIMES * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.col1")).alias("form_n"))).alias("best"),
    )
    known = pin(known.select("word", "n", "n_near", "best.form", "best.form_n"), "forms")
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", spoiled: int = 0) -> DataFrame:
    """:func:`variants` of the words of all texts that occur ``RAREST`` times or more."""
    return variants(word_counts(df, id_column, text_column, spoiled).where(F.col("n") >= RAREST))
