"""A corpus made ready for training: quality, near-duplicates, benchmark leaks, personal data, mixture.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows its predecessor kept. ``run`` writes every
stage's result to the folder in spark.checkpoint.dir and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plantlens.llm import leaks, mixing, pii, quality, simhash
from plantlens.llm.common import read, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their failing lines; n_chars is counted anew."""
    return quality.recounted(quality.cleaned(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles link at three bits or fewer."""
    return simhash.keep_first(docs, shingle=3, bits=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return leaks.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind in brackets; n_chars is counted anew."""
    return quality.recounted(pii.redacted(docs, pii.fit(docs)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, with the number of times each is taken."""
    return mixing.mixed(docs)


STAGES = [
    ("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("personal_data", personal_data), ("mixture", mixture),
]
ORACLE_SQL = None  # fingerprints and boosted trees are beyond SQL; tests/llm runs the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
