"""Train / validation / test assignment without sorting the data set."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.operators import blocks, quality

HASH_BITS = 60
BUCKET_BITS = 12
EXACT_BUCKET = 10_000


def stable_hash(key: Column, seed: int) -> Column:
    """A 60-bit non-negative number from a row key and a seed; the same on every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")


def nth_smallest(df: DataFrame, value: Column, tie: Column, n: int) -> tuple[int, object] | None:
    """The (value, tie) of rank ``n`` by repeated counting of at most 4096 value ranges per pass."""
    if n <= 0:
        return None
    rows = df.select(value.alias("h"), tie.alias("k"))
    low, bits, left = 0, HASH_BITS, n
    while True:
        shift = max(bits - BUCKET_BITS, 0)
        inside = rows.filter((F.col("h") >= low) & (F.col("h") < low + (1 << bits)))
        counts = inside.groupBy(F.shiftright(F.col("h") - low, shift).alias("b")).count().collect()
        for b, c in sorted((r["b"], r["count"]) for r in counts):
            if left <= c:
                break
            left -= c
        low, bits = low + (b << shift), shift
        if c <= EXACT_BUCKET or bits == 0:
            break
    final = rows.filter((F.col("h") >= low) & (F.col("h") < low + (1 << bits)))
    last = final.orderBy("h", "k").offset(left - 1).limit(1).first()
    return last["h"], last["k"]


def random(
    df: DataFrame, *, key: str, targets: Sequence[str] = (), features: Sequence[str] | None = None, test: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Exact-size random split: the ceil(test x n) rows with the smallest hash are the test set.

    Features are mean-filled, rows without a target are dropped, and fewer than five rows are all training.
    ``key`` must be unique. The split itself is a comparison with a threshold: the data is not shuffled.
    """
    rows = df.dropna("any", subset=list(targets)) if targets else df
    cols = list(features) if features is not None else quality.numeric_columns(rows, [key, *targets])
    aggs = [F.avg(c).alias(c) for c in cols]
    first = rows.agg(F.count("*").alias("_n"), *aggs).first()
    n = first["_n"]
    filled = rows.fillna({c: first[c] for c in cols if first[c] is not None}) if cols else rows
    h = stable_hash(F.col(key), seed)
    cut = nth_smallest(rows, h, F.col(key), math.ceil(test * n)) if n >= 5 else None
    if cut is None:
        return filled.withColumn("split", F.lit("train"))
    is_test = (h < cut[0]) | ((h == cut[0]) & (F.col(key) <= F.lit(cut[1])))
    return filled.withColumn("split", F.when(is_test, "test").otherwise("train"))


def chronological(
    df: DataFrame, *, keys: Sequence[str], ts: str, test: float = 0.2, val: float = 0.1, step_seconds: int = 3600
) -> DataFrame:
    """Per entity by position: oldest rows train, then validation, newest rows test."""
    keys = list(keys)
    placed = blocks.row_position(df, keys, ts, step_seconds)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    train = F.floor(F.col("_n") * F.lit(1.0 - test))
    held = F.floor(train * F.lit(val / (1.0 - test)))
    part = F.when(F.col(blocks.POS) >= train, "test").when(F.col(blocks.POS) >= train - held, "val").otherwise("train")
    return blocks.attach(placed, sizes, keys).select(*df.columns, part.alias("split"))
