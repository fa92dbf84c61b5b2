"""Toxicity: boosted trees over dense text features, calibrated isotonically.

Features are rates of the text alone: density of a lexicon (words and word
beginnings that labelled toxic texts use far more often), the same near a
second-person word or after undoing letter swaps, capitals, punctuation and
obfuscated spellings. Labels come from a bounded sample of the labelled rows;
rows whose id hash leaves remainder 2 are never learned from. The sample finds the
lexicon, two thirds of it fit the trees and the rest calibrates the margins.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q
from ..session import pin
from .common import Memo

THRESHOLD = 0.3
#: Labelled rows that are learned from, at most, and lexicon entries of each kind.
SAMPLE_ROWS = 20_000
LEXICON = 400
#: Learned entries stand in so many toxic texts, with so large a z value of the log odds.
LEAST_TEXTS, LEAST_Z = 3, 3.0
TREES, DEPTH, STEP, SEED = 24, 3, 0.25, 11

#: Insults known without any label, and words that address the reader.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown fool dumb".split()
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted vosotros".split()
)
#: Fixed value: look-alike characters and the letters they stand for.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
BEGINNINGS = (4, 5, 6)

_WORD = re.compile(r"[^\W\d_]+")
# Begins where a run of letters does: a long run is read once, not from each letter.
_MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]+[0-9@$!*#]+[^\W\d_]+")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][.\-_]){3,}[^\W\d_](?!\w)")
#: Fixed value: marks behind a word.
ENDINGS = frozenset(".,;:!?")
_PACK = struct.Struct("<13I").pack
#: Pieces of text whose numbers a worker remembers.
REMEMBER = 300_000
#: Words from a lexicon word to one that addresses the reader, at most.
NEAR = 4

FEATURES = (
    "words", "lexicon_share", "lexicon_count", "beginning_share", "beginning_count", "near_second_person",
    "second_person_share", "capital_share", "shouted_share", "exclamation_share", "question_share",
    "punctuation_share", "digit_share", "obfuscated_share", "obfuscated_lexicon", "repeat_share", "mean_word",
)


class Lexicon(NamedTuple):
    words: frozenset[str]
    beginnings: frozenset[str]


def _numbers(lexicon: Lexicon) -> Callable[[str], bytes]:
    """Counts for a piece of text without white space, as 32-bit numbers."""

    def make(piece: str) -> bytes:
        lower = piece.lower()
        # Most pieces are one word, perhaps with a mark behind it; these need no pattern.
        end = lower[-1] if lower[-1] in ENDINGS else ""
        word = lower[: len(lower) - len(end)]
        if not word.isalpha():
            return _PACK(*counted(piece, lower))
        capitals = 0 if piece.islower() else sum(map(str.isupper, piece))
        counts = (
            1, word in lexicon.words, begins(word), word in SECOND_PERSON, capitals,
            capitals > 0 and len(word) > 2 and piece.isupper(), end == "!", end == "?",
            max(len(piece) - len(word), 0), 0, 0, 0, len(word),
        )
        return _PACK(*counts)

    def begins(word: str) -> bool:
        for k in BEGINNINGS:
            if word[:k] in lexicon.beginnings:
                return True
        return False

    def counted(piece: str, lower: str) -> tuple[int, ...]:
        words = _WORD.findall(lower)
        bad = sum(w in lexicon.words for w in words)
        begun = sum(map(begins, words))
        masked = _MASKED.findall(lower) + _SPACED.findall(lower)
        undone = sum(m.translate(LOOKALIKES) in lexicon.words for m in masked)
        undone += sum(re.sub(r"[.\-_]", "", m) in lexicon.words for m in masked)
        letters = sum(map(len, words))
        digits = sum(map(str.isdigit, piece))
        return (
            len(words), bad, begun, sum(w in SECOND_PERSON for w in words), sum(map(str.isupper, piece)),
            sum(len(w) > 2 and w.isupper() for w in _WORD.findall(piece)), piece.count("!"), piece.count("?"),
            max(len(piece) - letters - digits, 0), digits, len(masked), undone, letters,
        )

    return make


_memos: dict[Lexicon, Memo] = {}


def features_of(text: str | None, lexicon: Lexicon) -> list[float]:
    """The numbers of :data:`FEATURES`; all 0 for an empty text."""
    if not text:
        return [0.0] * len(FEATURES)
    if lexicon not in _memos:
        _memos.clear()
        _memos[lexicon] = Memo(_numbers(lexicon), REMEMBER)
    known = _memos[lexicon]
    known.claim()
    pieces = text.split()
    rows = np.frombuffer(b"".join(map(known.__getitem__, pieces)), dtype="<u4").reshape(-1, 13)
    words, bad, begun, second, capitals, shouted, calls, asks, marks, digits, masked, undone, letters = (
        rows.sum(axis=0, dtype="i8").tolist()
    )
    near = 0
    if second and (bad or begun):
        reader = np.flatnonzero(rows[:, 3])
        hits = np.flatnonzero(rows[:, 1] | rows[:, 2])
        at = np.searchsorted(reader, hits - NEAR)
        near = int((reader[np.minimum(at, len(reader) - 1)] <= hits + NEAR)[at < len(reader)].sum())
    n, size = max(words, 1), len(text)
    return [
        float(np.log1p(words)), bad / n, float(min(bad, 20)), begun / n, float(min(begun, 20)), near / n, second / n,
        capitals / size, shouted / n, calls / size, asks / size, marks / size, digits / size, masked / n,
        float(min(undone, 20)), 1.0 - len(set(pieces)) / max(len(pieces), 1), letters / n,
    ]


def features(text: Column, lexicon: Lexicon) -> Column:
    """The feature numbers of a text column, as an array."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([features_of(t, lexicon) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return run(text)


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words and word beginnings that toxic texts use far more often than others."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    begun = F.filter("words", lambda w: F.length(w) > min(BEGINNINGS))
    cuts = F.flatten(F.array(*[F.transform(begun, lambda w, k=k: F.substring(w, 1, k)) for k in BEGINNINGS]))
    per_text = rows.select("toxic", words.alias("words"))
    terms = per_text.select("toxic", F.lit(0).alias("kind"), F.explode("words").alias("term")).unionAll(
        per_text.select("toxic", F.lit(1).alias("kind"), F.explode(F.array_distinct(cuts)).alias("term"))
    )
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = terms.where(F.length("term") > 2).groupBy("kind", "term").agg(
        F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")
    )
    t, rest = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    odds = F.log(t / (toxic - F.col("t") + 1.0)) - F.log(rest / (n - toxic - F.col("n") + F.col("t") + 1.0))
    z = odds / F.sqrt(1 / t + 1 / rest)
    kept = counts.where(F.col("t") >= LEAST_TEXTS).withColumn("z", z).where(F.col("z") >= LEAST_Z)
    kept = pin(kept.select("kind", "term", "z"), "terms")
    # A lexicon has a fixed size: the entries with the largest values.
    found = {kind: kept.where(F.col("kind") == kind).orderBy(F.desc("z"), "term").limit(LEXICON).collect() for kind in (0, 1)}
    return Lexicon(frozenset(INSULTS) | {r["term"] for r in found[0]}, frozenset(r["term"] for r in found[1]))


def remainder(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return (F.crc32(id_column.cast("string").cast("binary")) % 4).cast("int")


class Scorer(NamedTuple):
    """A fitted scorer; without trees (labels of one kind, or none) it gives the base rate."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    scale: IsotonicRegressionModel | None
    base: float


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Scorer:
    """Learn from at most ``SAMPLE_ROWS`` labelled rows, drawn by id hash.

    Labels without an id or a value are passed over; where an id has several
    labels the largest counts.
    """
    named = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    named = named.where((F.col("_id").isNotNull()) & (F.col("toxic").isNotNull()) & (remainder(F.col("_id")) != 2))
    named = named.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    sample = named.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
    texts = docs.select(q(id_column).alias("doc_id"), q(text_column).alias("text"))
    # At most SAMPLE_ROWS ids are sent to the tasks, so the texts stay where they are.
    rows = texts.join(F.broadcast(sample), texts["doc_id"] == sample["_id"])
    rows = rows.select(remainder(F.col("doc_id")).alias("part"), "toxic", F.coalesce("text", F.lit("")).alias("text"))
    rows = pin(rows, "labelled")
    lexicon = learn_lexicon(rows)
    table = rows.select("part", F.col("toxic").cast("double").alias("label"), features(F.col("text"), lexicon).alias("f"))
    table = pin(table, "features").select("part", "label", array_to_vector("f").alias("features"))
    seen = {(r["half"], r["label"]): r["n"] for r in table.groupBy((F.col("part") < 2).alias("half"), "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, total = sum(n for (_, y), n in seen.items() if y), sum(seen.values())
    base = toxic / total if total else 0.0
    if not (seen.get((True, 0.0)) and seen.get((True, 1.0))):
        return Scorer(lexicon, None, None, base)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, maxMemoryInMB=64).fit(
        table.where("part < 2").coalesce(4)
    )
    held = table.where("part = 3")
    if not (seen.get((False, 0.0)) and seen.get((False, 1.0))):
        held = table
    scale = IsotonicRegression(featuresCol="margin", predictionCol="calibrated").fit(_margins(trees, held).select("margin", "label"))
    return Scorer(lexicon, trees, scale, base)


def _margins(trees: GBTClassificationModel, table: DataFrame) -> DataFrame:
    return trees.transform(table).withColumn("margin", vector_to_array("rawPrediction")[1])


def score(docs: DataFrame, scorer: Scorer, text_column: str = "text") -> DataFrame:
    """``docs`` packed as struct ``row``, with ``score`` between 0 and 1.

    Null and empty texts are scored like any other, from features of 0.
    """
    rows = docs.select(F.struct(*[q(c) for c in docs.columns]).alias("row"))
    if scorer.trees is None:
        return rows.withColumn("score", F.lit(scorer.base))
    text = F.coalesce(F.col("row")[text_column], F.lit(""))
    table = rows.withColumn("features", array_to_vector(features(text, scorer.lexicon)))
    scaled = scorer.scale.transform(_margins(scorer.trees, table))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated")))
    return scaled.select("row", value.alias("score"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The input without the texts that score ``threshold`` or more."""
    scorer = fit(docs, labels)
    kept = score(docs, scorer).where(F.col("score") < threshold)
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
