"""The corpus pipeline: documents in, packed token ids out.

Each stage takes (spark, docs, sf_dir) and returns a table; the caller writes it
as Parquet and reads it back as the next stage's ``docs``. Stages but the last
return the columns of ``documents``. Empty tables, null and empty texts, repeated
rows and extra columns pass as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import decontam, mixing, simhash, tokenfile, toxicity
from eventloom.session import pin

#: The tokenizer's vocabulary file, by its name in the package of public tokenizers.
VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer rejects go."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target sizes; a document may come up to three times."""
    return mixing.repeat_to_targets(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as token ids in the bit-plane file, read back."""
    import public_tokenizers

    return tokenfile.token_file(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token ids", token_stage),
]

#: Fingerprints, trees and tilings are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
