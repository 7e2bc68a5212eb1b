"""Vector jobs: embeddings, nearest category, exact top-k search."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions import text as tf

QUERY_BLOCK = 1024


_BITS = 60


def embed(df: DataFrame, *, id_col: str, text: str, dims: int = 64, out: str = "embedding", tokens: str | None = None) -> DataFrame:
    """id, embedding: the mean of the text's token vectors; blank text gives the zero vector.

    A token's vector is a fixed direction of -1 and 1 components read off the bits of its MD5 digest, so
    there is no vocabulary to train, hold or ship and any number of texts is one aggregation. Tokens are words between
    blanks, or the array column ``tokens``. Learned
    vectors can be passed to every other operator here as an array column instead.
    """
    words = df.select(id_col, F.explode_outer(F.col(tokens) if tokens else tf.tokens(F.col(text))).alias("token"))
    salted = words.select(id_col, "token", *[
        F.md5("token" if j == 0 else F.concat("token", F.lit(f"#{j}"))).alias(f"_d{j}") for j in range(-(-dims // (2 * _BITS)))])
    halves = salted.select(id_col, "token", *[
        F.conv(F.substring(f"_d{j // 2}", 1 + 15 * (j % 2), 15), 16, 10).cast("long").alias(f"_h{j}") for j in range(-(-dims // _BITS))])
    sums = halves.groupBy(id_col).agg(F.count("token").alias("_n"), *[
        F.sum(F.shiftright(f"_h{i // _BITS}", i % _BITS).bitwiseAND(1)).alias(f"_e{i}") for i in range(dims)])

    def mean(i: int):
        return F.when(F.col("_n") > 0, F.col(f"_e{i}") / F.col("_n") * 2 - 1).otherwise(0.0).cast("float")

    return sums.select(id_col, F.array(*[mean(i) for i in range(dims)]).alias(out))


def centroids(df: DataFrame, label: str, embedding: str) -> DataFrame:
    """Mean vector per label; sums combine per element before the shuffle."""
    parts = df.select(label, F.posexplode(embedding).alias("i", "x"))
    mean = parts.groupBy(label, "i").agg(F.avg("x").alias("x"))
    return mean.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_a")).select(
        label, F.col("_a.x").alias("centroid"))


CATEGORY_BLOCK = 4096


def _blocks(rows: Iterable, size: int) -> Iterator[list]:
    it = iter(rows)
    while block := list(islice(it, size)):
        yield block


def _nearest(names: list[str], matrix: np.ndarray):
    """A column function: the best of one block of categories for each vector."""
    @F.pandas_udf("category string, similarity double, blank boolean")
    def nearest(rows: pd.Series) -> pd.DataFrame:
        x = _unit(np.stack([np.asarray(v, dtype=float) for v in rows]))
        sims = np.round(x @ matrix.T, 12)
        best = sims.argmax(axis=1)
        return pd.DataFrame({"category": np.array(names, dtype=object)[best], "similarity": sims[np.arange(len(best)), best],
                             "blank": ~x.any(axis=1)})

    return nearest


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def classify(df: DataFrame, categories: DataFrame, *, embedding: str, label: str, vector: str, out: str = "category") -> DataFrame:
    """Nearest category by cosine (smallest label on ties); rows without a vector get ''.

    Categories travel to the tasks in blocks of at most CATEGORY_BLOCK as one matrix per block, and only the
    best of each block is kept: no join, no row-by-category pairs.
    """
    rows, block_names = df, []
    for i, block in enumerate(_blocks(categories.select(label, vector).orderBy(label).toLocalIterator(), CATEGORY_BLOCK)):
        matrix = _unit(np.array([r[1] for r in block], dtype=float))
        rows = rows.withColumn(f"_n{i}", _nearest([str(r[0]) for r in block], matrix)(F.col(embedding)))
        block_names.append(f"_n{i}")
    if not block_names:
        return df.withColumns({out: F.lit(""), "similarity": F.lit(0.0)})
    best = F.col(block_names[0])
    for n in block_names[1:]:
        best = F.when(F.col(f"{n}.similarity") > best["similarity"], F.col(n)).otherwise(best)
    blank = best["blank"]
    return rows.withColumns({
        out: F.when(blank, "").otherwise(best["category"]), "similarity": F.when(blank, 0.0).otherwise(best["similarity"]),
    }).drop(*block_names)


def build_index(df: DataFrame, *, id_col: str, embedding: str, text: str | None = None, metadata: Sequence[str] = ()) -> DataFrame:
    """id, text, unit-length embedding, metadata map: the searchable table."""
    meta = F.create_map(*[x for m in metadata for x in (F.lit(m), F.col(m).cast("string"))]) if metadata else F.create_map()
    return df.select(
        F.col(id_col).alias("id"), (F.col(text) if text else F.lit(None).cast("string")).alias("text"),
        tf.unit_vector(F.col(embedding)).alias("embedding"), meta.cast("map<string,string>").alias("metadata"),
    )


def _local_top(queries: list[tuple], k: int):
    """Per input batch, the k best index rows of every query: the only rows that leave the task."""
    ids = [q[0] for q in queries]
    matrix = np.array([q[1] for q in queries], dtype=float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack([np.asarray(v, dtype=float) for v in pdf["embedding"]])
            sims = np.round(x @ matrix.T, 12)
            rows = pd.DataFrame({
                "query_id": np.repeat(ids, len(pdf)), "id": np.tile(pdf["id"].to_numpy(), len(ids)), "similarity": sims.T.ravel(),
            })
            best = rows if best is None else pd.concat([best, rows])
            best = best.sort_values(["query_id", "similarity", "id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if best is not None:
            yield best

    return run


def search(queries: DataFrame, index: DataFrame, *, k: int = 5, query_id: str = "query_id", embedding: str = "embedding") -> DataFrame:
    """Exact top-k cosine matches per query over an index of unit vectors.

    Queries are read in blocks of at most QUERY_BLOCK; each block is one pass over the index in which every
    task keeps only its own k best rows per query, so no query-by-row pairs are written or shuffled.
    """
    vectors = queries.select(query_id, tf.unit_vector(F.col(embedding)).alias("v")).orderBy(query_id)
    schema = f"query_id {dict(queries.dtypes)[query_id]}, id {dict(index.dtypes)['id']}, similarity double"
    found = index.sparkSession.createDataFrame([], schema)
    for block in _blocks(vectors.toLocalIterator(), QUERY_BLOCK):
        rows = [(r[0], r[1]) for r in block]
        found = found.unionByName(index.select("id", "embedding").mapInPandas(_local_top(rows, k), schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
