"""Substring dedup by content-defined chunking: a gear rolling hash cuts texts, equal chunks are found by digest, and of
equal chunks all but the first are removed where they stand in a run.

Cuts lie between characters. A cut depends on the 16 bytes before it, so an insertion moves no cut beyond the next chunk, and a passage that two
documents share is cut alike in both but for its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantlens.llm.common import staged

LEAST, MEAN_MORE, MOST = 16, 24, 96  # bytes: shortest chunk, mean beyond it, longest
WINDOW = 16
STEP = 1 << 22  # bytes hashed at once
HOT = 1000  # digests that are looked up in a broadcast table
_GEAR = np.random.default_rng(2024).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
_GEAR[255] = 0  # 0xFF is in no UTF-8 text; it pads texts that are hashed together
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32, 255]] = True
_CHUNKS = "uid long, id long, seq int, bytes int, words int, start int, points int, hi long, lo long"


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the last 16 bytes' gear values, each shifted by its distance; four doubling steps."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h, width = more, 2 * width
    return h


def cuts(start: int, end: int, candidates: list[int], inner: np.ndarray | None = None) -> list[int]:
    """Chunk ends of the bytes from start to end, given where the hash allows a cut; ``inner`` marks bytes that go on with a character."""
    out, at = [], start
    for c in [*candidates, end]:
        while c - at > MOST:
            at += MOST
            while inner is not None and inner[at]:
                at -= 1
            out.append(at)
        if c - at >= LEAST or c == end and c > at:
            out.append(c)
            at = c
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, id, seq, bytes, words, start, points, hi, lo) of every chunk of every text, hi and lo being its 128-bit digest.

    uid is one per row. A word belongs to the chunk it starts in. start and points are the chunk's place in the text and its
    length in code points. An empty or null text has one chunk of no bytes.
    """
    threshold = np.uint32(2**32 // MEAN_MORE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        pad = b"\xff" * WINDOW

        def emit(held: list[tuple[int, int | None, bytes]]) -> pa.RecordBatch:
            raw = b"".join(pad + t for _, _, t in held)
            data = np.frombuffer(raw, np.uint8)
            inner = (data & 0xC0) == 0x80
            allowed = np.flatnonzero(gear(data) < threshold) + 1
            allowed = allowed[~inner[np.minimum(allowed, len(data) - 1)]]
            led = np.concatenate([[0], np.cumsum(~inner)])
            blank = _BLANK[data]
            begins = ~blank
            begins[1:] &= blank[:-1]
            counted = np.concatenate([[0], np.cumsum(begins)])
            view, starts, ends, owner, seq, digests, begin, at = memoryview(raw), [], [], [], [], [], [], 0
            for k, (_, _, t) in enumerate(held):
                at += WINDOW
                stop = at + len(t)
                mine = allowed[np.searchsorted(allowed, at, "right") : np.searchsorted(allowed, stop)].tolist()
                found = cuts(at, stop, mine, inner) or [at]
                firsts = [at, *found[:-1]]
                digests += [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(firsts, found)]
                starts += firsts
                ends += found
                owner += [k] * len(found)
                begin += [at] * len(found)
                seq += range(len(found))
                at = stop
            s, e, o = np.array(starts), np.array(ends), np.array(owner)
            two = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            ids = pa.array([i for _, i, _ in held], pa.int64()).take(pa.array(o))
            cols = [pa.array(np.array([u for u, _, _ in held])[o]), ids, pa.array(np.array(seq, np.int32)), pa.array((e - s).astype(np.int32)), pa.array((counted[e] - counted[s]).astype(np.int32)), pa.array((led[s] - led[np.array(begin)]).astype(np.int32)), pa.array((led[e] - led[s]).astype(np.int32)), pa.array(two[:, 0]), pa.array(two[:, 1])]
            return pa.RecordBatch.from_arrays(cols, names=["uid", "id", "seq", "bytes", "words", "start", "points", "hi", "lo"])

        for batch in batches:
            held, size = [], 0
            for i, text in zip(batch.column(0), batch.column(1)):
                t = (text.as_py() or "").encode("utf-8", "replace")
                held.append((uid, i.as_py(), t))
                uid, size = uid + 1, size + len(t)
                if size >= STEP:
                    yield emit(held)
                    held, size = [], 0
            if held:
                yield emit(held)

    two = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(cut, _CHUNKS)


def _repeats(filled: DataFrame) -> DataFrame:
    """(uid, seq, words, start, points, first, other, later) of the chunks that another row holds or that stand later than an equal one.

    Frequent digests, at most HOT and among them all that make up more than one in HOT of the chunks, are looked up in a
    combined aggregate of themselves; the rest are ordered by digest and place, where no digest can fill a task. Each part
    is dealt out by uid before they meet, so that the tasks that scan all chunks for frequent ones are a stage of their own
    and not the long ones among those that order a share of the rest. The union keeps that partitioning.
    """
    spark = filled.sparkSession
    found = filled.stat.freqItems(["hi"], 1 / HOT).first()[0] or []
    hot = F.broadcast(spark.createDataFrame([(x,) for x in found], "hi long"))
    kept = ["uid", "seq", "words", "start", "points", "first", "other", "later"]

    often = filled.join(hot, "hi")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "uid", "seq")
    known = often.groupBy("hi", "lo").agg((F.min("uid") != F.max("uid")).alias("other"), F.min(place).alias("p"))
    often = often.join(F.broadcast(known), ["hi", "lo"]).withColumns({"first": F.col("p.id"), "later": (F.col("uid") != F.col("p.uid")) | (F.col("seq") != F.col("p.seq"))})

    order = Window.partitionBy("hi", "lo").orderBy(F.col("id").asc_nulls_last(), "uid", "seq")
    all_ = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rare = filled.join(hot, "hi", "left_anti").withColumns({
        "first": F.first("id").over(all_), "other": F.first("uid").over(all_) != F.last("uid").over(all_), "later": F.row_number().over(order) > 1})
    often, rare = (part.where("other or later").select(kept).repartition("uid") for part in (often, rare))
    return often.unionByName(rare)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 25) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_words, n_chunks, n_shared, n_passages, passage_words, extra_words, removed_words, first_id, removed.

    n_shared counts chunks that another row holds too. A passage is a run of such chunks with ``min_words`` words or
    more; the chunks at a shared passage's ends are lost, so a few in a hundred passages of 50 to 60 words hold no such
    run, and hardly any of more than 80. passage_words sums their words, first_id is the smallest id among the holders of
    their chunks.

    Deduplication: of equal chunks the first one stays, that of the smallest id (nulls last), then of the first row, then
    the first in the text, so repeats inside one text count too. Runs of later copies with ``min_words`` words or more are
    removed: ``removed`` holds their spans (start, end) in code points, end exclusive, in order, and removed_words
    their words; extra_words counts the words of all later copies in passages. Every removed chunk stands in a text that
    keeps it. ``deduplicated`` gives the texts without these spans.

    Null, empty and blank texts share nothing; equal texts of a few words have no passage. An empty table gives an empty table.
    """
    all_ = staged(chunks(docs, id_col, text_col), "chunks")
    totals = all_.groupBy("uid", "id").agg(F.sum("bytes").alias("n_bytes"), F.sum("words").alias("n_words"), F.sum((F.col("bytes") > 0).cast("long")).alias("n_chunks"))
    held = _repeats(all_.where("bytes > 0").select("uid", "id", "seq", "words", "start", "points", "hi", "lo"))
    upto = Window.partitionBy("uid").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)

    def run(flag: str):  # chunks that follow on from each other with the flag have one number
        return F.when(F.col(flag), F.col("seq") - F.sum(F.col(flag).cast("int")).over(upto))

    both = held.withColumns({"passage": run("other"), "copy": run("later")})
    kinds = F.explode(F.array(F.struct(F.lit(False).alias("gone"), F.col("passage").alias("run")), F.struct(F.lit(True).alias("gone"), F.col("copy").alias("run"))))
    runs = both.withColumn("k", kinds).select("*", "k.gone", "k.run").where("run is not null").groupBy("uid", "gone", "run").agg(
        F.count("*").alias("n"), F.sum("words").alias("words"), F.min("first").alias("first"), F.sum(F.when(F.col("later"), F.col("words")).otherwise(0)).alias("extra"),
        F.min("start").alias("start"), F.max(F.col("start") + F.col("points")).alias("end"))
    passage, gone, long_ = ~F.col("gone"), F.col("gone"), F.col("words") >= min_words
    per_row = runs.groupBy("uid").agg(
        F.sum(F.when(passage, F.col("n"))).alias("n_shared"), F.count_if(passage & long_).alias("n_passages"), F.sum(F.when(passage & long_, F.col("words"))).alias("passage_words"),
        F.min(F.when(passage & long_, F.col("first"))).alias("first_id"), F.sum(F.when(passage & long_, F.col("extra"))).alias("extra_words"),
        F.sum(F.when(gone & long_, F.col("words"))).alias("removed_words"), F.sort_array(F.collect_list(F.when(gone & long_, F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))))).alias("removed"))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_shared", "n_passages", "passage_words", "extra_words", "removed_words")]
    spans = F.coalesce("removed", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("removed")
    return totals.join(per_row, "uid", "left").select("id", "n_bytes", "n_words", "n_chunks", *zero, "first_id", spans)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 25) -> DataFrame:
    """(id, text, removed) per row of ``docs``: the text without later copies, and their spans in the given text.

    Of equal chunks the first one stays: that of the smallest id (nulls last), then of the first row, then the first in
    the text, so a passage that one text repeats is removed there too. A run of later copies is removed where it has
    ``min_words`` words or more, and it is cut at whole characters. Spans are (start, end) in code points, end exclusive,
    in order. Every removed chunk stands in a text that keeps it. Null and empty texts stay as they are, an empty table
    gives an empty table. A group is never more than one text: chunks are compared by digest with a combined minimum, and
    a digest of any frequency then meets its copies in a join that adaptive execution can split.
    """
    rows = staged(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row")), "texts")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"), F.col("seq").alias("seq"))
    keys = rows.select("row", "id")
    cut = chunks(rows, "row", "text").where("bytes > 0").select(F.col("id").alias("row"), "seq", "bytes", "words", "hi", "lo")
    all_ = staged(cut.join(keys, "row").withColumn("place", place), "placed")
    firsts = all_.groupBy("hi", "lo").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = all_.join(firsts, ["hi", "lo"], "left").withColumn("later", F.col("first").isNotNull() & (F.col("place") != F.col("first")))
    inside = Window.partitionBy("row").orderBy("seq")
    ends = marked.select("row", "seq", "words", "later", "bytes", F.sum("bytes").over(inside).alias("end"), F.row_number().over(inside).alias("nth"))
    run = F.col("nth") - F.row_number().over(inside)
    runs = ends.where("later").withColumn("run", run).groupBy("row", "run").agg(F.sum("words").alias("words"), F.min(F.col("end") - F.col("bytes")).alias("start"), F.max("end").alias("end"))
    spans = runs.where(F.col("words") >= min_words).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kept, gone = (text, []) if not found else _without(text, [(f["start"], f["end"]) for f in found])
                texts.append(kept)
                removed.append([{"start": a, "end": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["id", "text", "removed"])

    return rows.join(spans, "row", "left").select("id", "text", "spans").mapInArrow(without, "id long, text string, removed array<struct<start:long,end:long>>")


def _without(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the byte spans, each narrowed to whole characters, and the spans in code points."""
    raw = text.encode("utf-8", "replace")
    pieces, gone, at, points = [], [], 0, 0
    for start, end in spans:
        while start < end and raw[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        if start < end:
            kept = raw[at:start].decode("utf-8")
            first = points + len(kept)
            points = first + len(raw[start:end].decode("utf-8"))
            pieces.append(kept)
            gone.append((first, points))
            at = end
    return "".join([*pieces, raw[at:].decode("utf-8")]), gone
