"""Importance resampling towards a target: hashed n-gram weights, then ranks by parallel sorting with regular samples.

Every run of one to three words is a feature, hashed to one of a fixed number of buckets. Bucket counts of the corpus
and of the target give a gain for each bucket, an array of fixed size that scores a text by look-ups. The
scores are ranked exactly without one task seeing them all: sorted runs give regular samples, the samples give
splitters, segments between splitters are exchanged and sorted, and counts of the segments before give the ranks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import staged

BUCKETS = 10_000
LEAST_WORDS = 20
HELD_WORDS = 500_000  # words whose checksums a worker holds
PART_WORDS = 200_000  # words taken at once, or one text
SHORT = 64  # bytes of a word up to which checksums are combined by table
MOST_SEGMENTS = 1_000
_LOW = (1 << 33) - 1
# Bytes that are no part of a word become blanks, A-Z become a-z; bytes of other scripts stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def _shifts() -> np.ndarray:
    """What appending n zero bytes makes of a CRC-32, by its bytes: entry [n, k, v] is for byte k of value v."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = one >> 1 ^ np.where(one & 1, np.uint32(0xEDB88320), np.uint32(0))
    out = np.zeros((SHORT + 2, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, SHORT + 2):
        out[n] = out[n - 1] >> 8 ^ one[out[n - 1] & 255]
    return out.reshape(-1)


_SHIFTS = _shifts()


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    base = n * 1024
    out = _SHIFTS[base + (crc & 255)]
    for k in range(1, 4):
        out = out ^ _SHIFTS[base + 256 * k + (crc >> np.uint32(8 * k) & 255)]
    return out


class Hasher:
    """Checksums of words and of runs of words, from those of their parts; distinct words are hashed once while held."""

    def __init__(self) -> None:
        self.held: dict[bytes, int] = {}
        self.facts = np.zeros((3, 1024), np.int64)  # checksum, checksum with a blank before, bytes with that blank

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.held) > HELD_WORDS:
            self.held.clear()
        new = list(set(words).difference(self.held))
        start = len(self.held)
        while start + len(new) > self.facts.shape[1]:
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)], axis=1)
        self.facts[:, start : start + len(new)] = np.array([(zlib.crc32(w), zlib.crc32(b" " + w), len(w) + 1) for w in new], np.int64).reshape(-1, 3).T
        self.held.update(zip(new, range(start, start + len(new))))
        return np.fromiter(map(self.held.__getitem__, words), np.int64, len(words))

    def features(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The checksums of all features of the texts, and the number of the text that each belongs to."""
        words = [w for t in texts for w in t]
        sizes = np.array([len(t) for t in texts], np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        numbers = self._numbers(words)
        crc, suffix, length = self.facts[:, numbers]
        one, suffix = crc.astype(np.uint32), suffix.astype(np.uint32)
        found, owner, run, long_ = [one], [text], one, length > SHORT + 1
        for k in (1, 2):
            n = max(len(words) - k, 0)
            whole = text[:n] == text[k : k + n]
            run = _shifted(run[:n], np.minimum(length[k : k + n], SHORT + 1)) ^ suffix[k : k + n]
            odd = whole & np.logical_or.reduce([long_[j : j + n] for j in range(1, k + 1)])
            for i in np.flatnonzero(odd):  # words longer than the table
                run[i] = zlib.crc32(b" ".join(words[i : i + k + 1]))
            found.append(run[whole])
            owner.append(text[:n][whole])
        return np.concatenate(found), np.concatenate(owner)


def _parts(column: pa.Array) -> Iterator[list[list[bytes]]]:
    part, size = [], 0
    for t in column:
        part.append(words_of(t.as_py()))
        size += len(part[-1])
        if size >= PART_WORDS:
            yield part
            part, size = [], 0
    if part:
        yield part


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often the features of all texts fall in each bucket: one array of fixed size, summed before it is gathered."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in _parts(batch.column(0)):
                total += np.bincount(hasher.features(part)[0] % np.uint32(buckets), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets), pa.int64()), pa.array(total)], names=["bucket", "n"])

    summed = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in summed.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target, both smoothed by one."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(y) + 1) * (s + n) / ((float(x) + 1) * (t + n)))) for x, y in zip(source, target)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row; texts without a word have weight 0."""
    names = ["id", "n_words", "n_features", "weight"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for part in _parts(batch.column(1)):
                crc, owner = hasher.features(part)
                n_words += map(len, part)
                n_features.append(np.bincount(owner, minlength=len(part)))
                total = np.zeros(len(part), np.int64)
                np.add.at(total, owner, gain[crc % np.uint32(len(gain))])
                weight.append(total)
            rows = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (n_features, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), *map(pa.array, rows)], names=names)

    two = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return two.mapInArrow(score, ", ".join(f"{n} long" for n in names))


def gumbel(id_: Column, seed: int = 42) -> Column:
    """Thousandths of a Gumbel draw that depends on seed and id only; a null id counts as an empty name."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


# Parallel sorting by regular sampling.


def _lengths(df: DataFrame, at: str) -> dict[int, int]:
    return {r["run"]: r["n"] for r in df.groupBy(F.shiftright(at, 33).alias("run")).agg(F.count("*").alias("n")).collect()}


def ranks(rows: DataFrame, order: list[str], segments: int | None = None) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3, ... by the long columns ``order``, all ascending; none of them may hold nulls.

    A row's place in its run ends the order, so rows that repeat are split like others, and each gets a rank of its own.
    With r runs and p segments (``segments``; the shuffle partitions, 1,000 at most) the driver sees r run lengths,
    p counts and about max(r, p * p) samples of a few numbers each. A segment holds about 2 / p of all rows at most.
    """
    spark = rows.sparkSession
    runs = staged(rows.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "runs")
    lengths = _lengths(runs, "__at")
    p = segments or min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_SEGMENTS)
    each = max(1, p * p // max(1, len(lengths)))
    strides = spark.createDataFrame([(run, -(-n // each)) for run, n in lengths.items()], "__run long, __stride long")
    key = [*order, "__at"]
    placed = runs.select(*key, F.shiftright("__at", 33).alias("__run"), F.col("__at").bitwiseAND(F.lit(_LOW)).alias("__place"))
    sampled = placed.join(strides, "__run").where("__place % __stride = 0").select(*key).toPandas()
    samples = [sampled[c].to_numpy(np.int64) for c in key]
    by_key = np.lexsort(samples[::-1])
    at = by_key[[len(by_key) * i // p for i in range(1, p)]] if len(by_key) else by_key
    splitters = [s[at] for s in samples]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.concatenate([s, batch.column(batch.schema.get_field_index(c)).to_numpy()]) for s, c in zip(splitters, key)]
            place = np.lexsort(own[::-1])
            before = np.cumsum(place < len(at))
            segment = np.empty(len(place), np.int32)
            segment[place] = before
            yield batch.append_column("__segment", pa.array(segment[len(at) :]))

    dealt = runs.mapInArrow(deal, ", ".join(f"`{n}` {t}" for n, t in runs.dtypes) + ", __segment int")
    merged = dealt.repartitionById(p, F.col("__segment")).sortWithinPartitions(*key).drop("__at", "__segment").withColumn("__at", F.monotonically_increasing_id())
    merged = staged(merged, "segments")
    total, starts = 0, []
    for run, n in sorted(_lengths(merged, "__at").items()):
        starts.append((run, total))
        total += n
    before = spark.createDataFrame(starts, "__run long, __before long")
    found = merged.withColumn("__run", F.shiftright("__at", 33)).join(before, "__run")
    return found.select(*rows.columns, (F.col("__before") + F.col("__at").bitwiseAND(F.lit(_LOW)) + 1).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = LEAST_WORDS, buckets: int = BUCKETS,
              id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", segments: int | None = None) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row; rank is null for rows that are not drawn.

    Drawn are the ``percent`` highest scores, rounded down, of the texts of ``least_words`` words or more; equal scores go to
    the smaller id, null ids last, then to fewer features. Null texts have no words; repeated rows each count. Empty
    tables, of documents or target, give weights from what there is.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text, buckets))
    scored = weights(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    scored = staged(scored, "scored")
    eligible = scored.where(F.col("n_words") >= least_words)
    keyed = eligible.select("*", (-F.col("score")).alias("__down"), F.col("id").isNull().cast("long").alias("__none"), F.coalesce("id", F.lit(0)).alias("__id"))
    n = eligible.count() * percent // 100
    found = ranks(keyed, ["__down", "__none", "__id", "n_features"], segments).select(*scored.columns, F.when(F.col("rank") <= n, F.col("rank")).alias("rank"))
    return found.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
