"""Token counts from flat token files that have no index: only separators tell where a document ends.

A file is a run of fixed-size blocks. Each block is searched for separators on its own; a prefix scan over the blocks'
summaries then gives the number of documents before a block and the tokens of the document that reaches into it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantlens.llm.common import staged

TOKENIZERS = "/opt/tokenizers"
BLOCK_TOKENS = 1 << 18
SUPER = 4096  # blocks scanned together; their sums are scanned in a second step
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the vocabulary's splitting rule
_FLAT = "file long, block long, tokens binary, first_doc long, docs array<long>"


@lru_cache(1)
def encoder(folder: str, name: str = "byte_bpe_50k.tiktoken"):
    import tiktoken

    with open(f"{folder}/{name}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("flat", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def write_flat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: int = 50256, dtype: str = "<u2",
               folder: str = TOKENIZERS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files of all texts as a table of blocks (file, block, tokens, first_doc, docs), one file per task.

    Every document is followed by ``separator``. Blocks are cut by size alone. ``docs`` lists ids in the order of the
    file, from number ``first_doc`` on; the counts do not use it. Null texts are empty documents. ``folder`` holds the
    vocabulary on every executor.
    """

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, file, block, held, size, ids, first = encoder(folder), TaskContext.get().partitionId(), 0, [], 0, [], 0

        def row(data: bytes) -> pa.RecordBatch:
            cols = [pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, names=["file", "block", "tokens", "first_doc", "docs"])

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                found = np.array(enc.encode_ordinary(text.as_py() or "") + [separator], dtype)
                held.append(found)
                size += len(found)
                ids.append(i.as_py())
                if size >= block_tokens:
                    data = np.concatenate(held)
                    cut = size - size % block_tokens
                    for start in range(0, cut, block_tokens):
                        yield row(data[start : start + block_tokens].tobytes())
                        first, ids, block = first + len(ids), [], block + 1
                    held, size = [data[cut:]], size - cut
        if ids or size:
            yield row(np.concatenate(held).tobytes())

    two = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return staged(two.mapInArrow(flat, _FLAT), "flat")


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, tokens) of plain token files, each one block; larger files than a task can hold must be cut first."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), F.lit(0).cast("long").alias("block"), F.col("content").alias("tokens"))


def lengths(blocks: DataFrame, separator: int = 50256, dtype: str = "<u2") -> DataFrame:
    """(file, doc, n_tokens): the length of every document of every file, counted from 0 in the file's order.

    ``blocks`` holds (file, block, tokens), with whole tokens in every block. Tokens after a file's last separator are
    a document of their own. Adjacent separators give empty documents; an empty table gives an empty table.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, head, tail, inner = [], [], [], []
            for data in batch.column(2):
                t = np.frombuffer(data.as_buffer(), dtype)
                at = np.flatnonzero(t == separator)
                n.append(len(at))
                head.append(int(at[0]) if len(at) else len(t))
                tail.append(len(t) - 1 - int(at[-1]) if len(at) else len(t))
                inner.append(np.diff(at) - 1)
            cols = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(head, pa.int64()), pa.array(tail, pa.int64()), pa.array(inner, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["file", "block", "n", "head", "tail", "inner"])

    found = staged(blocks.select("file", "block", "tokens").mapInArrow(search, "file long, block long, n long, head long, tail long, inner array<long>"), "found")

    def scan(df: DataFrame, keys: list[str], order: str) -> DataFrame:
        """Adds n0, t0, has0: separators before a row, tokens since the last of them, whether there was one."""
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("t_all", F.coalesce(F.sum("tail").over(w), F.lit(0)))
        since = F.last(F.when(F.col("n") > 0, F.col("t_all")), ignorenulls=True).over(w)
        return df.select("*", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"), (F.col("t_all") - F.coalesce(since, F.lit(0))).alias("t0"), since.isNotNull().alias("has0"))

    inside = scan(found.withColumn("super", F.floor(F.col("block") / SUPER)), ["file", "super"], "block")
    after = F.struct((F.col("n0") + F.col("n")).alias("n"), F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("t0") + F.col("tail")).alias("tail"))
    sums = inside.groupBy("file", "super").agg(F.max_by(after, "block").alias("x")).select("file", "super", "x.n", "x.tail")
    supers = scan(sums, ["file"], "super").select("file", "super", F.col("n0").alias("s_n"), F.col("t0").alias("s_t"))
    stitched = inside.join(supers, ["file", "super"]).select(
        "file", "block", "n", "tail", "head", "inner", (F.col("s_n") + F.col("n0")).alias("before"), F.when(F.col("has0"), F.col("t0")).otherwise(F.col("s_t") + F.col("t0")).alias("carry"))
    ended = stitched.where("n > 0").select("file", "before", F.posexplode(F.concat(F.array(F.col("carry") + F.col("head")), "inner")).alias("i", "n_tokens"))
    rest = F.struct((F.col("before") + F.col("n")).alias("doc"), F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail")).alias("n_tokens"))
    open_ = stitched.groupBy("file").agg(F.max_by(rest, "block").alias("x")).where("x.n_tokens > 0").select("file", "x.doc", "x.n_tokens")
    return ended.select("file", (F.col("before") + F.col("i")).alias("doc"), "n_tokens").union(open_)


def document_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_tokens) of every row, by way of flat files: written, searched for separators, stitched, and named again.

    Null and empty texts have no tokens; repeated and null ids keep a row each.
    """
    blocks = write_flat(docs, id_col, text_col, **options)
    names = blocks.select("file", "first_doc", F.posexplode("docs").alias("i", "id")).select("file", (F.col("first_doc") + F.col("i")).alias("doc"), "id")
    search = {k: v for k, v in options.items() if k in ("separator", "dtype")}
    return names.join(lengths(blocks, **search), ["file", "doc"]).select("id", "n_tokens")
