"""Quality by hierarchical empirical Bayes.

A logistic model over text features gives each document its own evidence. The
mean evidence of a host (``source``) is shrunk toward the corpus, and that of a
path below it (``source`` and ``lang``) toward its host; how strongly follows
from how much groups differ beyond chance, by moments over all documents. A
document's odds are its own, moved by its path's odds against the corpus's.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q
from ..session import pin

#: Labelled rows that are learned from, at most.
SAMPLE_ROWS = 20_000
KEEP = 0.5
#: Bounds of a document's own evidence, and of a prior's weight in documents.
FLOOR, LEAST_PRIOR, MOST_PRIOR = 0.001, 2.0, 10_000.0

_WORD = re.compile(r"[^\W\d_]+")
FEATURES = ("words", "mean_word", "capital_share", "mark_share", "bar_share", "exclamation_share", "digit_share",
            "distinct_share", "neighbour_repeats", "line_repeats", "words_per_line")


def features_of(text: str | None) -> list[float]:
    """The numbers of :data:`FEATURES`; all 0 for an empty text."""
    if not text:
        return [0.0] * len(FEATURES)
    words, lines, size = _WORD.findall(text), text.split("\n"), len(text)
    n = max(len(words), 1)
    letters = sum(map(len, words))
    digits = sum(text.count(d) for d in "0123456789")
    marks = size - letters - digits - text.count(" ") - len(lines) + 1
    shouted = sum(1 for w in words if len(w) > 1 and w.isupper())
    repeats = sum(1 for a, b in zip(words, words[1:]) if a == b)
    return [
        float(np.log1p(len(words))), letters / n, shouted / n, marks / size, text.count("|") / n, text.count("!") / n,
        digits / size, len(set(words)) / n, repeats / n, 1.0 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
    ]


def features(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([features_of(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return run(text)


def evidence(docs: DataFrame, labels: DataFrame) -> Column:
    """Probability that a text is good, from its own features, as a column of ``f``.

    Learned from at most ``SAMPLE_ROWS`` labelled rows drawn by id hash; rows
    whose id hash leaves remainder 2 (crc32 modulo 4) are never learned from.
    With labels of one kind, or none, the base rate.
    """
    held = F.crc32(F.col("_id").cast("string").cast("binary")) % 4 == 2
    named = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("label"))
    named = named.where(F.col("_id").isNotNull() & F.col("label").isNotNull() & ~held)
    named = named.groupBy("_id").agg(F.max("label").alias("label"))
    sample = named.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
    # At most SAMPLE_ROWS ids are sent to the tasks.
    rows = docs.select(q("doc_id"), q("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    table = pin(rows.select("label", features(F.coalesce("text", F.lit(""))).alias("f")), "labelled")
    seen = {r["label"]: r["n"] for r in table.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (seen.get(0.0) and seen.get(1.0)):
        total = sum(seen.values())
        return F.lit(seen.get(1.0, 0) / total if total else 0.5)
    # Both kinds weigh the same, so that 0.5 parts them whatever their share.
    total = sum(seen.values())
    weight = F.when(F.col("label") == 1, total / (2 * seen[1.0])).otherwise(total / (2 * seen[0.0]))
    table = table.select("label", weight.alias("weight"), array_to_vector("f").alias("features"))
    model = LogisticRegression(regParam=0.001, maxIter=60, weightCol="weight").fit(table)
    line = sum(
        (F.col("f")[i] * F.lit(float(c)) for i, c in enumerate(model.coefficients)), F.lit(float(model.intercept))
    )
    return 1.0 / (1.0 + F.exp(-line))


def _prior_weight(groups: DataFrame, mean: float) -> float:
    """Documents that a prior is worth, from the spread of group means beyond chance."""
    share = F.col("p") / F.col("n")
    n, within, spread, squares = groups.where("n > 0").agg(
        F.coalesce(F.sum("n"), F.lit(0)),
        F.coalesce(F.sum(F.col("s") - F.col("p") * share), F.lit(0.0)),
        F.coalesce(F.sum(F.col("n") * (share - mean) * (share - mean)), F.lit(0.0)),
        F.coalesce(F.sum(F.col("n") * F.col("n").cast("double")), F.lit(0.0)),
    ).first()
    count = groups.count()
    if n <= count or count < 2:
        return MOST_PRIOR
    chance = within / (n - count)
    between = max((spread - (count - 1) * chance) / (n - squares / n), 0.0)
    return MOST_PRIOR if between <= chance / MOST_PRIOR else min(max(chance / between, LEAST_PRIOR), MOST_PRIOR)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, evidence, host_rate, path_rate, score`` and ``kept`` per document.

    Null and empty texts have features of 0; a missing host or language is a
    group of its own. Rows that repeat count as often as they come. An empty
    table gives an empty result.
    """
    own = evidence(docs, labels)
    rows = docs.select(q("doc_id"), q("source"), q("lang"), features(F.coalesce(q("text"), F.lit(""))).alias("f"))
    own = F.greatest(F.lit(FLOOR), F.least(F.lit(1 - FLOOR), own))
    rows = pin(rows.withColumn("evidence", own).drop("f"), "evidence")
    sums = (F.sum("evidence").alias("p"), F.sum(F.col("evidence") * F.col("evidence")).alias("s"), F.count(F.lit(1)).alias("n"))
    paths = pin(rows.groupBy("source", "lang").agg(*sums), "paths")
    hosts = paths.groupBy("source").agg(F.sum("p").alias("p"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    p, n = hosts.agg(F.sum("p"), F.sum("n")).first()
    mean = p / n if n else 0.5
    host_prior = _prior_weight(hosts, mean)
    hosts = hosts.select(
        F.col("source").alias("host"), ((F.col("p") + host_prior * mean) / (F.col("n") + host_prior)).alias("host_rate")
    )
    path_prior = _prior_weight(paths, mean)
    rates = paths.join(hosts, F.col("source").eqNullSafe(F.col("host"))).select(
        "host", F.col("lang").alias("tongue"), "host_rate",
        ((F.col("p") + path_prior * F.col("host_rate")) / (F.col("n") + path_prior)).alias("path_rate"),
    )
    rates = pin(rates, "rates")
    joined = rows.join(rates, F.col("source").eqNullSafe(F.col("host")) & F.col("lang").eqNullSafe(F.col("tongue")))
    odds = _logit(F.col("evidence")) + _logit(F.col("path_rate")) - float(np.log(mean / (1 - mean)))
    score = 1.0 / (1.0 + F.exp(-odds))
    return joined.select("doc_id", "evidence", "host_rate", "path_rate", score.alias("score")).withColumn(
        "kept", F.col("score") >= KEEP
    )
