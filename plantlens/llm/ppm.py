"""Prediction by partial matching over bytes, pretrained on a corpus, with a word model beside it.

The trie of byte contexts is a table of grams, each a context of ``ORDER`` bytes and the byte after it, with counts. As
the model is frozen, the probability of a byte depends on its gram alone: escapes by method C, and below the longest
context the bytes seen there are excluded. Both are sums over one node and its child. So each gram's code length is
found once, next to the grams that share its last two context bytes, and a text's score is a sum of lookups.

Texts are dealt to chunks of some megabytes. A chunk sends its distinct grams and words to the counts and gets back
what it needs of the model; nobody holds all of it, and a frequent gram costs a row for each chunk.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import split_words, staged

ORDER = 4
CHUNK_BYTES = 16_000_000
EDGE = 255  # in no UTF-8 text; stands before and after each
STEP = 1 << 21  # bytes whose grams are sorted or looked up at once
END = b"\n"  # the end token among the words, which hold no line feed


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def grams(data: np.ndarray) -> np.ndarray:
    """The gram that ends at each byte from the first full one on, as one number, oldest byte first."""
    n = len(data) - ORDER
    key = np.zeros(max(n, 0), np.int64)
    for j in range(ORDER + 1):
        key = key << 8 | data[j : j + n]
    return key


def _stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts between edges, and how many grams each has (its bytes and the edge that ends it)."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    edge = bytes([EDGE])
    return np.frombuffer(edge * ORDER + b"".join(r + edge * ORDER for r in raw), np.uint8), np.array([len(r) for r in raw], np.int64)


def _counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the texts and their counts."""
    keys, counts = [], []
    held: list[str | None] = []

    def flush() -> None:
        data, sizes = _stream(held)
        ends = np.cumsum(sizes + ORDER)
        inner = np.ones(len(data) - ORDER, bool)
        for k in range(1, ORDER):  # edges after the first belong to no text
            inner[ends - ORDER + k] = False
        g = np.sort(grams(data)[inner])
        at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        keys.append(g[at])
        counts.append(np.diff(np.concatenate([at, [len(g)]])))
        held.clear()

    size = 0
    for t in texts:
        held.append(t)
        size += len(t or "") + ORDER
        if size > STEP:
            flush()
            size = 0
    if held:
        flush()
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def _observe(table: pa.Table) -> pa.Table:
    """A chunk's distinct grams and words, with their counts in training texts (0: in held-out ones only)."""
    chunk = table.column("chunk")[0].as_py()
    out = table.column("held_out").to_pylist()
    texts = table.column("text").to_pylist()
    train, test = [t for t, h in zip(texts, out) if not h], [t for t, h in zip(texts, out) if h]
    g, n = _counts(train)
    more, _ = _counts(test)
    more = np.setdiff1d(more, g, assume_unique=True)
    words: Counter[bytes] = Counter()
    for t in train:
        words.update(split_words(t))
    if train:
        words[END] = len(train)
    for t in test:
        for w in split_words(t):
            words.setdefault(w, 0)
    if test:
        words.setdefault(END, 0)
    total = len(g) + len(more) + len(words)
    keys = pa.concat_arrays([pa.array(np.concatenate([g, more])), pa.nulls(len(words), pa.int64())])
    named = pa.concat_arrays([pa.nulls(len(g) + len(more), pa.binary()), pa.array(list(words), pa.binary())])
    counts = np.concatenate([n, np.zeros(len(more), np.int64), np.fromiter(words.values(), np.int64, len(words))])
    return pa.table({"chunk": pa.array(np.full(total, chunk, np.int64)), "gram": keys, "word": named, "n": pa.array(counts)})


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each row's is, and the sums of n."""
    every, where = np.unique(keys, return_inverse=True)
    return every, where, np.bincount(where, n, len(every))


def code_lengths(gram: np.ndarray, n: np.ndarray, low: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's last byte after its context.

    The rows must hold every gram with the same last two context bytes; ``low`` has the training counts of all pairs
    of context byte and byte (256 x 256), from which orders 1 and 0 follow. The lowest level is uniform over 256.
    """
    symbol = gram & 255
    logp, done = np.zeros(len(gram)), np.zeros(len(gram), bool)
    seen_before: np.ndarray | None = None  # per row: was its byte seen in the longer context
    total0 = kinds0 = None
    for k in range(ORDER, -1, -1):
        # counts, totals and kinds of this order for each row, and what the longer context excludes
        if k >= 2:
            node = gram & ((1 << 8 * (k + 1)) - 1)
            every, where, c = _sums(node, n)
            ctx_of_node = every >> 8
            _, ctx, t = _sums(ctx_of_node, c)
            d = np.bincount(ctx, c > 0)
            count, total, kinds = c[where], t[ctx][where], d[ctx][where]
        elif k == 1:
            last = gram >> 8 & 255
            count, total, kinds = low[last, symbol], low.sum(1)[last], (low > 0).sum(1)[last]
        else:
            zero = low.sum(0)
            count, total, kinds = zero[symbol], np.full(len(gram), zero.sum()), np.full(len(gram), (zero > 0).sum())
        count, total, kinds = count.astype(np.float64), total.astype(np.float64), kinds.astype(np.float64)
        if seen_before is None:
            gone, gone_kinds = np.zeros(len(gram)), np.zeros(len(gram))
        else:
            gone, gone_kinds = _excluded(gram, n, k, low), kinds0
        left, new = total - gone, kinds - gone_kinds
        found = ~done & (count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            logp[found] += np.log10(count[found] / (left + new)[found])
            escape = ~done & (count == 0) & (left + new > 0)
            logp[escape] += np.log10((new / (left + new))[escape])
        done |= found
        seen_before, total0, kinds0 = count > 0, total, kinds
    # a byte in no training text: uniform over the bytes that order 0 has not seen
    logp[~done] -= np.log10(np.maximum(256 - kinds0[~done], 1))
    return logp


def _excluded(gram: np.ndarray, n: np.ndarray, k: int, low: np.ndarray) -> np.ndarray:
    """For each row, the count at order k of all bytes that its context of order k + 1 has seen."""
    if k + 1 >= 2:
        node = gram & ((1 << 8 * (k + 2)) - 1)
        every, _, c = _sums(node, n)
        seen = every[c > 0]
        if k >= 2:
            lower, _, cl = _sums(gram & ((1 << 8 * (k + 1)) - 1), n)
            mass = cl[np.searchsorted(lower, seen & ((1 << 8 * (k + 1)) - 1))]
        else:
            mass = low[seen >> 8 & 255, seen & 255]
        ctx, where, sums = _sums(seen >> 8, mass.astype(np.float64))
        mine = (gram >> 8) & ((1 << 8 * (k + 1)) - 1)
    else:
        zero = low.sum(0)
        sums = ((low > 0) * zero[None, :]).sum(1).astype(np.float64)
        ctx = np.arange(256)
        mine = gram >> 8 & 255
    if not len(ctx):
        return np.zeros(len(gram))
    at = np.minimum(np.searchsorted(ctx, mine), len(ctx) - 1)
    return np.where(ctx[at] == mine, sums[at], 0.0)


class _Lookup:
    """Positions of keys in a table by hashing; what a slot cannot hold goes to the next, smaller table."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.tables = keys, []
        rest, odd = np.arange(len(keys)), 0x9E3779B97F4A7C15
        while len(rest):
            shift = np.uint64(64 - max(8, int(len(rest) * 4).bit_length()))
            slot = self._slots(keys[rest], odd, shift)
            table = np.full(1 << 64 - int(shift), 0, np.int32)
            table[slot] = rest
            self.tables.append((odd, shift, table))
            rest, odd = rest[table[slot] != rest], (odd * 0xD1342543DE82EF95 + 2) % 2**64 | 1

    @staticmethod
    def _slots(keys: np.ndarray, odd: int, shift: np.uint64) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(odd) >> shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(keys), np.int32), None
        for odd, shift, table in self.tables:
            mine = keys if open_ is None else keys[open_]
            at = table[self._slots(mine, odd, shift)]
            hit = self.keys[at] == mine
            if open_ is None:
                out, open_ = at, np.flatnonzero(~hit)
            else:
                out[open_[hit]] = at[hit]
                open_ = open_[~hit]
            if not len(open_):
                return out
        raise KeyError("a gram is not in the chunk's model")


def _score(totals: tuple[int, int]):
    n_all, kinds = totals

    def score(docs: pa.Table, model: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        is_gram = pc.is_valid(model.column("gram"))
        part = model.filter(is_gram)
        find, logp = _Lookup(part.column("gram").to_numpy()), part.column("logp").to_numpy()
        part = model.filter(pc.invert(is_gram))
        count = dict(zip(part.column("word").to_pylist(), part.column("n").to_pylist()))
        texts = docs.column("text").to_pylist()
        base, known, tokens, score = [], [], [], []
        for t in texts:
            words = split_words(t)
            words.append(END)
            c = np.array([count[w] for w in words], np.float64)
            base.append(float(np.log10((c + 0.1) / (n_all + 0.1 * (kinds + 1))).sum()))
            known.append(int((c > 0).sum()))
            tokens.append(len(words))
        held: list[str | None] = []
        size = 0
        for i, t in enumerate(texts):
            held.append(t)
            size += len(t or "") + ORDER
            if size > STEP or i + 1 == len(texts):
                data, sizes = _stream(held)
                spans = sizes + ORDER
                starts = np.cumsum(spans) - spans
                inner = np.ones(len(data) - ORDER, bool)
                for k in range(1, ORDER):
                    inner[starts + sizes + k] = False
                each = np.zeros(len(inner))
                each[inner] = logp[find(grams(data)[inner])]
                score += np.add.reduceat(each, starts).tolist()
                held, size = [], 0
        cols = {"id": docs.column("id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()),
                "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())}
        return pa.table(cols)

    return score


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The models learn from the rows that are not held out, all of them, and score every row. score is the log10
    probability of the text's bytes and its end. Null texts are empty texts and rows without an id are training rows;
    repeated rows count as often as they stand. An empty table gives an empty table; with no training rows the word
    model has no words and the byte model is uniform.
    """
    two = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bytes_ = two.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_chunks = max(1, -(-bytes_ // chunk_bytes))
    two = two.select("id", "text", held_out(F.col("id")).alias("held_out"), F.pmod(F.xxhash64("id", F.length("text")), F.lit(n_chunks)).alias("chunk"))
    seen = staged(two.groupBy("chunk").applyInArrow(_observe, "chunk long, gram long, word binary, n long"), "seen")
    counted = staged(seen.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    pairs = counted.where("n > 0").groupBy(F.col("gram").bitwiseAND(F.lit(65535)).alias("pair")).agg(F.sum("n").alias("n")).collect()  # 65,536 rows at most
    low = np.zeros((256, 256), np.int64)
    for row in pairs:
        low[row["pair"] >> 8, row["pair"] & 255] = row["n"]

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            g = table.column("gram").to_numpy()
            yield from pa.table({"gram": table.column("gram"), "logp": pa.array(code_lengths(g, table.column("n").to_numpy(), low))}).to_batches()

    suffix = F.shiftright("gram", 8).bitwiseAND(F.lit(65535))
    model = counted.repartition(suffix).mapInArrow(lengths, "gram long, logp double")
    words = staged(seen.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0))).first()
    none = F.lit(None)
    for_grams = seen.where("gram is not null").select("chunk", "gram").join(model, "gram").select("chunk", "gram", none.cast("binary").alias("word"), none.cast("long").alias("n"), "logp")
    for_words = seen.where("word is not null").select("chunk", "word").join(words, "word").select("chunk", none.cast("long").alias("gram"), "word", "n", none.cast("double").alias("logp"))
    out = two.groupBy("chunk").cogroup(for_grams.union(for_words).groupBy("chunk")).applyInArrow(
        _score((totals[0], totals[1])), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("id", "held_out", "n_tokens", "n_known", F.lit(totals[0]).cast("long").alias("train_tokens"), "base_score", "score")
