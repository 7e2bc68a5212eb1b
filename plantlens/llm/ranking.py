"""Ranked lexical search without random access: impact-sorted lists read in turn until the answer is certain.

Documents are counted once: of each, its number of terms and the frequencies of those terms that a query may hold. The
rest is partitioned by document. A task lays out the lists of a shard of documents, sorted by impact, and reads
them for each query step by step. What was read gives a document's lower bound, what can still come its upper bound, and
reading goes on until no other document can reach the best ones and all of theirs is read. Statistics are those of all
documents, so the best of all shards are the best of all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantlens.llm.common import staged

FILTER_BITS = 20  # size of the filter of query terms that goes to the tasks: 128 KB, whatever the queries
SHARD = 8_192  # documents whose lists a task holds
SHARD_POSTINGS = 2_000_000  # the same in postings, save for one document
BLOCK_TERMS = 200_000  # query terms that a task holds, save for one query
FIRST, GROWTH = 64, 3  # postings read of each list in the first step, and how much longer each step is
# Bytes that are no part of a term become blanks, A-Z become a-z; bytes of other scripts stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def _filter_place(term: bytes) -> int:
    return zlib.crc32(term) & ((1 << FILTER_BITS) - 1)


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query, term) once each; null texts have none, and queries without an id are left out."""
    text = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.array_remove(F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    return queries.select(F.col(f"`{id_col}`").cast("long").alias("query"), F.explode(terms).alias("term")).where("query is not null").distinct()


def counted(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, terms, tf) of every document with a term: its number of terms, and frequencies of terms that may be ``wanted``.

    Terms are kept by a filter of fixed size, so some others may pass; the more queries, the more do, and all stay right.
    """
    mask = np.zeros(1 << FILTER_BITS, bool)
    place = F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("place")
    mask[[r["place"] for r in wanted.select(place).distinct().collect()]] = True
    bits = np.packbits(mask).tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, known = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool), {}
        for batch in batches:
            ids, n, terms, tf = [], [], [], []
            for i, text in zip(batch.column(0), batch.column(1)):
                found = terms_of(text.as_py())
                if not found:
                    continue
                if len(known) > 1_000_000:
                    known.clear()
                for t in set(found).difference(known):
                    known[t] = bool(keep[_filter_place(t)])
                mine: dict[bytes, int] = {}
                for t in filter(known.__getitem__, found):
                    mine[t] = mine.get(t, 0) + 1
                ids.append(i.as_py())
                n.append(len(found))
                terms.append(list(mine))
                tf.append(list(mine.values()))
            cols = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(tf, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "terms", "tf"])

    two = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return staged(two.mapInArrow(count, "id long, n long, terms array<string>, tf array<long>"), "counted")


def term_weight(n: Column, df: Column) -> Column:
    return F.floor(1000 * F.log((2 * n + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


class Lists:
    """Impact-sorted lists of one shard: for each term documents and impacts, largest size of impact first."""

    def __init__(self, docs: int, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int) -> None:
        order = np.lexsort((doc, -np.abs(impact), term))
        self.docs, self.doc, self.impact = docs, doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(terms + 1))

    def best(self, terms: np.ndarray, ids: np.ndarray, k: int, first: int = FIRST) -> tuple[np.ndarray, np.ndarray]:
        """The documents of the k highest scores above 0, equal ones by ascending id, and these scores.

        Each step reads the next part of every list. A term not yet read in a document adds something between 0 and the
        next impact of its list, above 0 or below. It ends when all documents whose upper bound reaches the k-th best
        lower bound are read in full: these hold the best, and their scores are final.
        """
        at, ends = self.starts[terms].copy(), self.starts[terms + 1]
        lower_seen = np.zeros(self.docs, np.int64)
        unread = np.ones((len(terms), self.docs), bool)
        step = first
        while True:
            for j, (a, e) in enumerate(zip(at, ends)):
                part = self.doc[a : min(a + step, e)]
                lower_seen[part] += self.impact[a : a + len(part)]
                unread[j, part] = False
            at = np.minimum(at + step, ends)
            open_ = np.flatnonzero(at < ends)
            nxt = self.impact[at[open_]]
            waits = unread[open_]
            lower = lower_seen + np.minimum(nxt, 0) @ waits
            upper = lower_seen + np.maximum(nxt, 0) @ waits
            least = max(1, int(np.partition(lower, -k)[-k])) if len(lower) >= k else 1
            able = np.flatnonzero(upper >= least)
            if (lower[able] == upper[able]).all():
                order = np.lexsort((ids[able], -lower[able]))[:k]
                return able[order], lower[able][order]
            step *= GROWTH


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, rows, size = [], 0, 0
    for batch in batches:
        for start in range(0, batch.num_rows, min(1024, most)):
            part = batch.slice(start, min(1024, most))
            held.append(part)
            rows, size = rows + part.num_rows, size + len(part.column(2).flatten())
            if rows >= most or size >= SHARD_POSTINGS:
                yield pa.Table.from_batches(held)
                held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, mean_share: int = 90, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query, rank, id, score): the k best documents of every query among all documents, by exact integer scores.

    A document's score is the sum over the query's terms, once each, of weight * (10^9 tf div (1000 tf + 8 m)), where m
    grows with the document's length; scores of 0 or less are left out. Equal scores go to the smaller id, null ids last.
    Rows that repeat are documents of their own, as are rows without an id; rows that repeat a query id hold one query of
    all their terms. Null and empty texts are no documents, empty queries and empty tables give no rows.
    """
    spark = docs.sparkSession
    wanted = staged(query_terms(queries, query_id, query_text), "query-terms")
    rows = counted(docs, wanted, id_col, text_col)
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weighed = wanted.join(df, "term").select("query", "term", term_weight(F.lit(n_docs), F.col("df")).alias("w"))
    sizes = weighed.groupBy("query").agg(F.count("*").alias("size"))
    # Queries go to blocks of some total size; a block is held by the driver and by each task, one after the other.
    block = F.floor(F.sum("size").over(Window.partitionBy(F.pmod(F.xxhash64("query"), F.lit(64))).orderBy("query")) / BLOCK_TERMS)
    blocks = staged(weighed.join(sizes.select("query", F.struct(F.pmod(F.xxhash64("query"), F.lit(64)).alias("part"), block.alias("no")).alias("block")), "query"), "blocks")
    found = None
    # A part of few terms in all is no block of its own: parts are joined while they fit.
    totals = sorted((r["block"], r["n"]) for r in blocks.groupBy("block").agg(F.count("*").alias("n")).collect())
    groups: list[list] = []
    held = BLOCK_TERMS
    for name, n in totals:
        if held + n > BLOCK_TERMS:
            groups.append([])
            held = 0
        groups[-1].append(name)
        held += n
    for group in groups:
        names = F.array(*[F.struct(F.lit(g["part"]).cast("long").alias("part"), F.lit(g["no"]).cast("long").alias("no")) for g in group])
        mine = blocks.where(F.array_contains(names, F.col("block"))).select("query", "term", "w").toPandas()
        part = rows.mapInArrow(_searcher(mine["query"].to_numpy(np.int64), mine["term"].tolist(), mine["w"].to_numpy(np.int64), int(n_docs), int(n_terms), k, mean_share, SHARD, FIRST), "query long, id long, none int, score long")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query long, rank int, id long, score long")
    # Each shard gives k rows a query at most; they are ranked among each other in two steps, so no key grows with the shards.
    order = [F.desc("score"), "none", "id"]
    local = staged(found, "shard-best").withColumn("salt", F.pmod(F.xxhash64("id", "score"), F.lit(64)))
    some = local.withColumn("r", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).where(F.col("r") <= k).drop("r", "salt")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query", "rank", F.when(F.col("none") == 0, F.col("id")).alias("id"), "score")


def _searcher(query: np.ndarray, term: list[str], weight: np.ndarray, n_docs: int, n_terms: int, k: int, mean_share: int, most: int, first: int):
    """A task's function: lists of each shard, read for each query of the block."""
    names, term_no = np.unique(np.array(term, object), return_inverse=True)
    weight_of = np.zeros(len(names), np.int64)
    weight_of[term_no] = weight
    by_query = np.argsort(query, kind="stable")
    which, starts = np.unique(query[by_query], return_index=True)
    terms = [np.sort(x) for x in np.split(term_no[by_query], starts[1:])]
    vocabulary = names.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        for shard in _shards(batches, most):
            at = shard.column("terms").combine_chunks()
            tf = shard.column("tf").combine_chunks().flatten().to_numpy()
            number = pc.index_in(at.flatten(), value_set=known).fill_null(-1).to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(shard)), np.diff(at.offsets.to_numpy()))
            n = shard.column("n").to_numpy()
            m = 100 - mean_share + np.array([mean_share * int(x) * n_docs // n_terms for x in n], np.int64)
            hit = number >= 0
            doc, number, tf = doc[hit], number[hit], tf[hit]
            impact = weight_of[number] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
            lists = Lists(len(shard), number, doc, impact, len(known))
            none = shard.column("id").combine_chunks().is_null().to_numpy(zero_copy_only=False)
            ids = shard.column("id").fill_null(0).to_numpy()
            rank_ids = np.where(none, np.iinfo(np.int64).max, ids)
            out = [(q, *lists.best(t, rank_ids, k, first)) for q, t in zip(which.tolist(), terms)]
            place = np.concatenate([np.zeros(0, np.int64), *[d for _, d, _ in out]]).astype(np.int64)
            cols = [np.repeat(np.array([q for q, _, _ in out], np.int64), [len(d) for _, d, _ in out]), ids[place], none[place].astype(np.int32), np.concatenate([np.zeros(0, np.int64), *[s for _, _, s in out]])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query", "id", "none", "score"])

    return run
