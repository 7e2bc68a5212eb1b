"""What the text operators share: reading tables, words, hand-over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.session import staged

__all__ = ["GAP", "WORD", "read", "split_words", "staged", "text_words"]

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def split_words(text: str | None) -> list[bytes]:
    """The same words in a task, with A-Z lower-cased and nothing else; bytes.split() cuts at exactly the six blanks."""
    return (text or "").encode("utf-8", "replace").lower().split()
