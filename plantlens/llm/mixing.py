"""Mixing sources to target weights by cube-method balanced sampling.

Each source's target over its size gives every document of it a number of copies: the whole part is certain, the
fraction is an inclusion probability. The cube method moves these probabilities inside the null space of two
constraints, words and documents, until they are 0 or 1. It runs in blocks of documents of one source: a block ends
with at most two open probabilities, the open ones of many blocks form the next level's blocks, and the last few of a
source are the landing problem, solved by giving up the documents constraint and then by one draw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantlens.llm.common import WORD, staged

BLOCK = 1000  # documents of one source that a group holds, on average
LANDING = 12  # documents of all sizes that are kept out of a source's last flight, so that landing has a choice
EPS = 1e-9


def _balance(sizes: list[float], probs: list[float], order: list[int], rng: np.random.Generator) -> None:
    """The flight phase in place: of three open documents, step along the null space until one is settled."""
    draws = iter(rng.random(2 * len(order) + 8).tolist())
    held: list[int] = []
    for i in order:
        if not EPS < probs[i] < 1 - EPS:
            continue
        held.append(i)
        while len(held) == 3:
            a, b, c = (sizes[j] for j in held)
            u = [b - c, c - a, a - b] if a != b or b != c else [1.0, -1.0, 0.0]
            up = down = float("inf")
            for x, j in zip(u, held):
                if x > 0:
                    up, down = min(up, (1 - probs[j]) / x), min(down, probs[j] / x)
                elif x < 0:
                    up, down = min(up, probs[j] / -x), min(down, (1 - probs[j]) / -x)
            step = up if next(draws) * (up + down) < down else -down
            for x, j in zip(u, held):
                p = probs[j] + step * x
                probs[j] = 0.0 if p < EPS else 1.0 if p > 1 - EPS else p
            held = [j for j in held if EPS < probs[j] < 1 - EPS]


def _land(sizes: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Of all ways to settle the last few, the one nearest to their expected words, then to their expected number."""
    ways = (np.arange(2 ** len(sizes))[:, None] >> np.arange(len(sizes)) & 1).astype(np.float64)
    off = np.abs(ways @ sizes - probs @ sizes) + 1e-3 * np.abs(ways.sum(1) - probs.sum())
    return ways[int(np.argmin(off))]


def _flight(seed: int, landing: bool):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        sizes = [float(x) for x in table.column("size").to_pylist()]
        probs = table.column("prob").to_pylist()
        order = np.lexsort((table.column("uid").to_numpy(), table.column("draw").to_numpy(), -table.column("size").to_numpy())).tolist()
        last = set(order[:: -(-len(order) // LANDING)]) if landing else set()
        _balance(sizes, probs, [i for i in order if i not in last], np.random.default_rng([seed, block % 2**32, len(sizes)]))
        if landing:
            left = [i for i in order if EPS < probs[i] < 1 - EPS]
            for i, p in zip(left, _land(np.array([sizes[i] for i in left]), np.array([probs[i] for i in left]))):
                probs[i] = float(p)
        return pa.table({"uid": table.column("uid"), "source": table.column("source"), "size": table.column("size"), "prob": pa.array(probs, pa.float64()), "draw": table.column("draw")})

    return run


def targets(sizes: DataFrame, total_share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """(source, source_size, target) from one row per source.

    Sources by code point, null last, get ``weights`` in turn. Their targets are proportional to the weights, stop at
    ``cap`` times the source's size, and share ``total_share`` of all sizes. Ordered by how much of the cap a unit of
    weight fills, the capped sources come first, so one pass of running sums finds the common rate. Sources are the
    rows of an aggregate; they are numbered and summed by range, each range on its own, and only a count and two sums
    of each range are joined.
    """
    spark = sizes.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))

    def numbered(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
        ranged = staged(df.repartitionByRange(min(parts, 64), *order).withColumn("part", F.spark_partition_id()), "ranges")
        within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        heads = ranged.groupBy("part").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in sums])
        before = heads.alias("h").join(heads.alias("g"), F.expr("g.part < h.part"), "left").groupBy("h.part").agg(
            F.coalesce(F.sum("g.n"), F.lit(0)).alias("n0"), *[F.coalesce(F.sum(f"g.s_{c}"), F.lit(0)).alias(f"b_{c}") for c in sums])
        out = ranged.join(F.broadcast(before), "part")  # one row for each of at most 64 ranges
        out = out.withColumn("row", F.col("n0") + F.row_number().over(Window.partitionBy("part").orderBy(*order)))
        for c in sums:
            out = out.withColumn(f"run_{c}", F.col(f"b_{c}") + F.sum(c).over(within))
        return out.drop("part", "n0", *[f"b_{c}" for c in sums])

    ranked = numbered(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], [])
    weight = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.select("source", "source_size", F.get(weight, ((F.col("row") - 1) % len(weights)).cast("int")).alias("weight"))
    ranked = ranked.withColumn("ratio", F.col("source_size") * cap / F.col("weight")).withColumn("most", F.col("source_size") * cap)
    filled = staged(numbered(ranked, [F.col("ratio"), F.col("source").asc_nulls_last()], ["most", "weight"]), "filled")
    whole = filled.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("all_weight"))
    rate = (F.col("all") * total_share - (F.col("run_most") - F.col("most"))) / (F.col("all_weight") - (F.col("run_weight") - F.col("weight")))
    rates = filled.crossJoin(F.broadcast(whole)).withColumn("rate", rate)  # the aggregate is one row
    level = rates.where("rate <= ratio * (1 + 1e-12)").agg(F.min_by("rate", "row").alias("level"))
    out = filled.crossJoin(F.broadcast(level))
    return out.select("source", "source_size", F.least("most", F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_share: float = 1.5,
           cap: float = 2.0, weights: tuple[float, ...] = (5.0, 2.0, 1.0), seed: int = 42) -> DataFrame:
    """(uid, id, draw, source, size, source_size, target, times): how often the mix takes each row; uid is one per row.

    Sizes are word counts, zero for null and blank texts. A row is taken ``times`` times, its whole part of target
    over source size or one more. Rows with null or repeated ids are rows of their own. Draws come from hashes of id
    and text, so reruns agree. An empty table gives an empty table.
    """
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = staged(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"),
                              F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), text).alias("draw"), F.monotonically_increasing_id().alias("uid")), "sizes")
    stats = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "source-sizes")
    aim = staged(targets(stats, total_share, cap, weights).join(stats.select(F.col("source").alias("s"), "rows"), F.expr("source <=> s")).drop("s"), "targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aim = aim.withColumn("sure", F.floor(share + F.lit(EPS)).cast("long")).withColumn("prob", F.greatest(share - F.col("sure"), F.lit(0.0)))
    per_source = F.broadcast(aim) if aim.count() <= 10_000 else aim  # beyond, adaptive execution splits the skewed side
    placed = rows.join(per_source.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s")
    open_ = placed.where((F.col("prob") > EPS) & (F.col("prob") < 1 - EPS) & (F.col("size") > 0)).select("uid", "source", "size", "prob", "draw", "rows")
    settled: DataFrame | None = None
    schema = "uid long, source string, size long, prob double, draw long"
    for level in range(20):
        last = open_.groupBy("source").count().agg(F.max("count")).first()[0]
        if last is None:
            break
        landing = last <= BLOCK
        blocks = F.ceil(F.col("rows") / BLOCK)
        block = F.xxhash64(F.lit(level), "source", F.pmod("draw", blocks))
        moved = staged(open_.withColumn("block", block).groupBy("source", "block").applyInArrow(_flight(seed + level, landing), schema), "flight")
        chosen = moved.where(F.col("prob") == 1.0).select(F.col("uid").alias("u"))
        settled = chosen if settled is None else settled.union(chosen)
        if landing:
            break
        left = moved.where((F.col("prob") > 0.0) & (F.col("prob") < 1.0)).withColumn("draw", F.xxhash64(F.lit(seed + level + 1), "draw"))
        counts = left.groupBy("source").agg(F.count("*").alias("rows")).withColumnRenamed("source", "s")
        open_ = left.join(counts, F.expr("source <=> s")).drop("s")
    if settled is None:
        more = placed.withColumn("extra", F.lit(0))
    else:
        more = placed.join(settled.withColumn("extra", F.lit(1)), placed["uid"] == F.col("u"), "left")
    times = F.when(F.col("size") > 0, F.col("sure") + F.coalesce("extra", F.lit(0))).otherwise(0).cast("long")
    return more.select("uid", "id", "draw", "source", "size", "source_size", "target", times.alias("times"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, **options) -> DataFrame:
    """The rows the mix takes, with their columns and ``times``, how often it takes them (of equal rows, at most).

    A column ``times`` of the input gives way to the new one.
    """
    draw = F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    taken = copies(docs, id_col=id_col, text_col=text_col, seed=seed, **options).where("times > 0").groupBy(F.col("draw").alias("__draw")).agg(F.max("times").alias("__times"))
    out = docs.join(taken.hint("shuffle_hash"), draw == F.col("__draw"))
    return out.select(*[docs[f"`{c}`"] for c in docs.columns if c != "times"], F.col("__times").alias("times"))
