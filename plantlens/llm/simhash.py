"""Near-duplicates by SimHash with deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import split_words, staged
from plantlens.llm.graph import components

SEED = 42
BLOCK = 65_536  # shingles whose bits are counted at once
HALF = 32


def fingerprint(text: str | None, shingle: int = 5) -> int:
    """SimHash of the word shingles, repeats included, as an unsigned 64-bit number.

    A text of fewer words is one shingle, a text without words has fingerprint 0.
    """
    words = split_words(text)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, BLOCK):
        part = words[start : min(start + BLOCK, n) + shingle - 1]
        cuts = map(b" ".join, zip(*[part[i:] for i in range(shingle)])) if len(words) >= shingle else [b" ".join(part)]
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in cuts], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5) -> DataFrame:
    """(id, mark, print) of every row: a hash of the text and the print as signed longs; other columns are not read."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.view(np.int64))], names=["id", "mark", "print"])

    text = F.col(f"`{text_col}`").cast("string")
    three = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return three.mapInArrow(prints, "id long, mark long, print long")


def _half(x: Column, v: Column) -> Column:
    """The 32-bit segment that variant v belongs to."""
    return F.when(v < HALF, x.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(x, HALF))


def variants(prints: DataFrame) -> DataFrame:
    """Each print under its 64 keys: one of two segments with one bit left out, and which bit that is.

    Of two prints that differ in at most three bits, one segment differs in at most one, so they share a key.
    """
    keys = []
    for v in range(2 * HALF):
        segment = _half(F.col("print"), F.lit(v))
        keys.append(segment.bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << v % HALF))).bitwiseOR(F.lit(v << HALF)))
    return prints.select("*", F.explode(F.array(*keys)).alias("key"))


def links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b): all pairs of different prints at ``bits`` (3 at most) differing bits or fewer.

    ``prints`` has one row per print. The equality join on the key is checked in its condition, so only true links
    come out, each once per segment: a pair meets in the variant of its differing bit, or in the first one. Both sides
    hold 64 rows per print, which Spark sizes as one; the hint keeps it from broadcasting them.
    """
    if bits > 3:
        raise ValueError("two segments find pairs of at most three differing bits")
    keyed = variants(prints.select("print"))
    one = keyed.select("key", F.col("print").alias("a"))
    two = keyed.select("key", F.col("print").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    v = F.shiftright(one["key"], HALF).cast("int")
    differs = _half(x, v)
    bit = F.pmod(v, F.lit(HALF))
    met = (differs == F.pow(F.lit(2.0), bit).cast("long")) | ((differs == 0) & (bit == 0))
    near = (F.col("a") < F.col("b")) & (F.bit_count(x) <= bits) & met
    return one.join(two.hint("merge"), (one["key"] == two["key"]) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bits: int = 3) -> DataFrame:
    """(id, mark, print, root, component): root names a class of linked rows, component is the smallest id in it.

    Every row is returned. Null and empty texts have print 0 and link like any other; rows without an id and rows that
    repeat an id are rows like any other, and a class without any id has no component. An empty table gives an empty
    table. Prints are written to the shared folder once; rows with equal prints meet in one aggregate, so copies
    are never paired.
    """
    prints = staged(fingerprints(docs, id_col, text_col, shingle), "prints")
    firsts = staged(prints.groupBy("print").agg(F.min("id").alias("id")), "firsts")
    roots = components(links(firsts, bits))
    placed = firsts.join(roots, firsts["print"] == roots["node"], "left").select("print", "id", F.coalesce("root", "print").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("id").alias("component"))
    classes = placed.drop("id").join(lowest, "root")
    return prints.join(classes, "print").select("id", "mark", "print", "root", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """One row of ``docs`` for each class of ``near_duplicates``: that of the smallest id.

    A row without an id is a row like any other and stays if no row of its class has an id. Of rows that repeat the id
    one stays, of the text with the smallest hash.
    """
    rows = near_duplicates(docs, id_col, text_col, shingle, bits).groupBy("root", "id", "mark").agg(F.count("*").alias("rows"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark", "rows")).alias("r"))
    first = staged(best.select(*[F.col(f"r.{c}").alias(f"__{c}") for c in ("id", "mark", "rows")]), "kept")
    on = docs[f"`{id_col}`"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs[f"`{text_col}`"].cast("string")) == F.col("__mark"))
    once = docs.join(first.where("__rows = 1"), on, "left_semi")
    again = docs.join(first.where("__rows > 1"), on).groupBy("__id", "__mark").agg(F.first(F.struct(*[docs[f"`{c}`"] for c in docs.columns])).alias("__row"))
    return once.unionByName(again.select("__row.*"))
