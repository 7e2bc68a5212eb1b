"""Benchmark decontamination by latent semantic retrieval.

Passages of the corpus and benchmark items are TF-IDF vectors over the benchmark's words. A randomised SVD of all
passages, computed by tasks that each add up their part of two products, gives the latent space; passages near an item by cosine there
are candidates, and a candidate counts if the longest common subsequence of words covers the item, or most of it and
its answer, the last sentence. Items are a stated query set: they pass over all documents in blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import staged

ITEMS = 2000  # benchmark items that one pass over the documents looks for, about
RANK, EXTRA = 96, 16
CELL, CELLS = 16, 2  # a passage is two cells of 16 words, one cell apart from the next
SPREAD = 0.25  # power of a dimension's variance that its weight is divided by; 0.5 would make all spread alike
NEAR = 0.55  # cosine of a candidate
COVERED, PARAPHRASED, ANSWERED = 0.8, 0.6, 0.8  # parts of the item, of a paraphrase, and of its answer
STEP = 60_000  # words looked at together
BLOCK = 32  # cells whose words are counted in one dense table
_CUT = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case words in UTF-8; ASCII blanks and punctuation separate."""
    return (text or "").lower().encode("utf-8", "replace").translate(_CUT).split()


def common(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


class Item(NamedTuple):
    id: int
    words: list[bytes]
    answer: list[bytes]


def item(id_: int, text: str | None) -> Item:
    sentences = [w for w in map(words, re.split(r"(?<=[.!?:])\s+|\n", (text or "").strip())) if w]
    return Item(id_, words(text), sentences[-1] if sentences else [])


def verdict(it: Item, passage: list[bytes]) -> tuple[float, float]:
    """(share of the item, share of its answer) that the passage holds in order."""
    return common(it.words, passage) / len(it.words), common(it.answer, passage) / len(it.answer)


class _Cells(NamedTuple):
    """Words of several texts, cut into cells that never cross texts."""

    ids: np.ndarray  # vocabulary ids of known words
    cell: np.ndarray  # their cells, ascending
    first: np.ndarray  # each text's first cell, and the total at the end


def _cells(texts: list[np.ndarray], size: int) -> _Cells:
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.concatenate(texts).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(-(-sizes // CELL))])
    at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    cell = np.repeat(first[:-1], sizes) + at // CELL
    known = ids < size
    return _Cells(ids[known], cell[known], first)


def _counts(c: _Cells) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first cell, word ids, how often each of BLOCK cells holds each of them) for one block of cells after the other."""
    bounds = np.searchsorted(c.cell, np.arange(0, int(c.first[-1]) + BLOCK, BLOCK))
    for block, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if lo < hi:
            known, column = np.unique(c.ids[lo:hi], return_inverse=True)
            at = (c.cell[lo:hi] - block * BLOCK) * len(known) + column
            yield block * BLOCK, known, np.bincount(at, minlength=BLOCK * len(known)).reshape(BLOCK, -1).astype(np.float32)


def _inside(c: _Cells) -> np.ndarray:
    """For each cell but the first one of all, whether its text has a cell before it."""
    out = np.ones(int(c.first[-1]) + 1, bool)
    out[c.first] = False
    return out[1:-1]


def _passages(c: _Cells, counts: Iterable[tuple[int, np.ndarray, np.ndarray]], vectors: np.ndarray) -> np.ndarray:
    """A row for the passage that starts at each cell: the sum of its words' vectors; it ends with its text."""
    n = int(c.first[-1])
    sums = np.zeros((n + BLOCK, vectors.shape[1]), np.float32)
    for at, known, m in counts:
        sums[at : at + BLOCK] = m @ vectors[known]
    out = sums[:n].copy()
    inside = _inside(c)
    out[:-1][inside] += sums[1:n][inside]
    return out


def coded(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, words) of every row of (id, text): the numbers of its words as raw bytes; a strange word has the next number."""
    dtype, strange = _dtype(len(vocabulary)), len(vocabulary)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            data = [np.array([get(w, strange) for w in words(t.as_py())], dtype).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["id", "words"])

    return docs.mapInArrow(code, "id long, words binary")


def _dtype(size: int) -> str:
    return "<u2" if size < 1 << 16 else "<i4"


def _grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, word numbers) of some texts at a time; a long text ends its group."""
    ids, texts, held, dtype = [], [], 0, _dtype(size)
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1)):
            w = np.frombuffer(t.as_buffer(), dtype)
            ids.append(i.as_py())
            texts.append(w)
            held += len(w)
            if held > STEP:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def frequencies(docs: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Of how many cells each known word is in, and the number of cells, over all ``coded`` documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for _, texts in _grouped(batches, size):
            c = _cells(texts, size)
            pairs = np.sort(c.cell * size + c.ids)
            pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
            total += np.bincount(pairs % size, minlength=size)
            n += int(c.first[-1])
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(size)], pa.int64()), pa.array([n, *total.tolist()], pa.int64())], names=["word", "n"])

    rows = docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # the benchmark's words at most
    out, n = np.zeros(size, np.int64), 0
    for r in rows:
        if r["word"] < 0:
            n = r["n"]
        else:
            out[r["word"]] = r["n"]
    return out, n


def product(docs: DataFrame, idf: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """A'A x for the TF-IDF passages A of all ``coded`` documents, and the squared weights of all their words."""
    size, width = x.shape
    weighted = (idf[:, None] * x).astype(np.float32)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, mass = np.zeros((size + 1, width)), 0.0
        for _, texts in _grouped(batches, size):
            c = _cells(texts, size)
            if not len(c.ids):
                continue
            counts = list(_counts(c))
            y = _passages(c, counts, weighted)
            inside = _inside(c)
            y[1:][inside] += y[:-1][inside]  # a word is in two passages
            for at, known, m in counts:
                own = y[at : at + BLOCK]
                out[known] += m[: len(own)].T @ own
            mass += float((idf[c.ids] ** 2).sum())
        out[:-1] *= idf[:, None]
        out[-1] = mass
        rows = pa.ListArray.from_arrays(pa.array(np.arange(size + 2, dtype=np.int32) * width), pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([*range(size), -1], pa.int64()), rows], names=["word", "v"])

    total = docs.mapInArrow(part, "word long, v array<double>").groupBy("word").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(width)]).collect()
    out, mass = np.zeros((size, width)), 0.0
    for r in total:
        if r[0] < 0:
            mass = r[1]
        else:
            out[r[0]] = r[1:]
    return out, mass


def latent(docs: DataFrame, items: np.ndarray, idf: np.ndarray, seed: int = 42) -> np.ndarray:
    """Word vectors of the latent space, partly whitened so that the language alone does not make texts alike.

    ``docs`` are all ``coded`` documents, ``items`` the benchmark's TF-IDF rows, which weigh as much together.
    One power step: tasks add up A'(A X) for a random X and again for an orthogonal base of the first product.
    """
    size, width = len(idf), min(RANK + EXTRA, len(idf))

    def both(x: np.ndarray) -> np.ndarray:
        out, mass = product(docs, idf, x)
        own = items.T @ (items @ x)
        return out * (np.square(items).sum() / mass) + own if mass else own

    base, _ = np.linalg.qr(both(np.random.default_rng(seed).standard_normal((size, width))))
    image = both(base)
    values, turn = np.linalg.eigh((base.T @ image + image.T @ base) / 2)
    order = np.argsort(values)[::-1][: min(RANK, width)]
    order = order[values[order] > max(values[order[0]], 0) * 1e-9] if len(order) else order
    return ((base @ turn[:, order]) / values[order] ** SPREAD * idf[:, None]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-12)


def _search(items: list[Item], vocabulary: dict[bytes, int], vectors: np.ndarray, near: float):
    size = len(vocabulary)
    numbers = [it._replace(words=[vocabulary[w] for w in it.words], answer=[vocabulary[w] for w in it.answer]) for it in items]
    queries = _unit(np.array([vectors[it.words].sum(0) for it in numbers], np.float32)).T.copy()
    own = [frozenset(it.words) for it in numbers]  # no other word adds to a common subsequence

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _grouped(batches, size):
            c = _cells(texts, size)
            found = _passages(c, _counts(c), vectors)
            best: dict[tuple[int, int], tuple[float, float]] = {}
            for start in range(0, len(found), 4096):
                cosine = _unit(found[start : start + 4096]) @ queries
                at, which = np.nonzero(cosine >= near)
                owner = np.searchsorted(c.first, at + start, "right") - 1
                for cell, k, d in zip((at + start - c.first[owner]).tolist(), which.tolist(), owner.tolist()):
                    it, known = numbers[k], own[k]
                    lo = max(0, cell * CELL - len(it.words))
                    passage = [w for w in texts[d][lo : (cell + CELLS) * CELL + len(it.words)].tolist() if w in known]
                    if len(passage) < min(COVERED, PARAPHRASED) * len(it.words):
                        continue  # it cannot cover enough
                    got = verdict(it, passage)
                    if got > best.get((d, k), (0.0, 0.0)):
                        best[d, k] = got
            hits = [(ids[d], items[k].id, *got) for (d, k), got in best.items() if got[0] >= COVERED or got[0] >= PARAPHRASED and got[1] >= ANSWERED]
            cols = list(zip(*hits)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["id", "item", "covered", "answered"])

    return search


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
          near: float = NEAR) -> DataFrame:
    """(id, item, covered, answered) for every document and item that it holds a passage of, one row each.

    Whole texts are searched, and the latent space is fitted on the passages of all of them; items without words are left
    out, null and empty texts hold nothing. Rows with repeated ids are searched each, and of equal (id, item) the best row
    stays. An empty table on either side gives no rows. Texts are cut into words once for each block of items.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bench = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    blocks = max(1, -(-bench.count() // ITEMS))
    out: DataFrame | None = None
    for b in range(blocks):
        own = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()  # about ITEMS rows
        items = [it for r in own if (it := item(r["item"], r["text"])).words]
        if not items:
            continue
        vocabulary = {w: i for i, w in enumerate(sorted({w for it in items for w in it.words}))}
        known = staged(coded(rows, vocabulary), "coded")
        n, cells = frequencies(known, len(vocabulary))
        idf = np.log((1.0 + cells) / (1.0 + n)) + 0.05
        rows_of = np.zeros((len(items), len(vocabulary)))
        for i, it in enumerate(items):
            for w in it.words:
                rows_of[i, vocabulary[w]] += idf[vocabulary[w]]
        vectors = latent(known, rows_of, idf)
        found = known.mapInArrow(_search(items, vocabulary, vectors, near), "id long, item long, covered double, answered double")
        out = found if out is None else out.union(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "id long, item long, covered double, answered double")
    return out.groupBy("id", "item").agg(F.max(F.struct("covered", "answered")).alias("x")).select("id", "item", "x.covered", "x.answered")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item's passage; rows without an id are judged together."""
    hit = staged(leaks(docs, benchmark, id_col, text_col, **options).select(F.col("id").alias("__hit")).distinct(), "leaks")
    return docs.join(hit, docs[id_col].cast("long").eqNullSafe(hit["__hit"]), "left_anti")
