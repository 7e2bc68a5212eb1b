"""An inverted-list vector index kept as two tables, searched inside Spark with exact re-ranking.

Rows are dealt to lists around centroids. A search sends each query to the lists that it is nearest to, joins it with their
rows and ranks by the exact cosine. Each list also stores how far its farthest row is from the centroid, so no row in it
can be nearer to a query than the angle to the centroid less that radius: an exact search goes on with just those lists
that can still hold a better row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantlens.functions import text as tf
from plantlens.session import staged

MOST_LISTS = 16_384  # centroids that the driver and each task hold
SAMPLE_PER_LIST = 128  # rows for each list that the centroids are fitted on, about; every row is indexed
PART_ROWS = 20_000  # rows of a list that meet in one group, about
BLOCK_QUERIES = 500  # queries that meet them there, about
ZERO = -1  # the list of vectors without a direction
SLACK = 1e-9


@dataclass
class VectorIndex:
    """``rows`` (id, embedding, list, part) and ``lists`` (list, centroid, rows, parts, radius in radians)."""

    rows: DataFrame
    lists: DataFrame

    def save(self, path: str) -> None:
        self.rows.write.parquet(f"{path}/rows")
        self.lists.write.parquet(f"{path}/lists")


def load(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/lists"))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in rows])


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _nearest(centroids: np.ndarray):
    """The list of each vector, and its angle to the centroid."""

    @F.pandas_udf("list int, angle double")
    def nearest(rows: pd.Series) -> pd.DataFrame:
        x = _matrix(rows)
        sims = x @ centroids.T
        best = sims.argmax(axis=1)
        blank = ~x.any(axis=1)
        return pd.DataFrame({"list": np.where(blank, ZERO, best).astype(np.int32), "angle": np.where(blank, 0.0, np.arccos(np.clip(sims[np.arange(len(x)), best], -1, 1)))})

    return nearest


def build(df: DataFrame, *, id_col: str, embedding: str, lists: int | None = None, seed: int = 42) -> VectorIndex:
    """Index every row that has a vector; ``lists`` is the square root of their number unless given.

    Centroids come from k-means on a sample of about SAMPLE_PER_LIST rows a list. A list of many rows, such as copies
    of one vector, is cut into parts. Vectors of zeros make up a list of their own; null vectors cannot be found.
    """
    vectors = df.select(F.col(id_col).alias("id"), tf.unit_vector(F.col(embedding)).alias("embedding")).where(F.col("embedding").isNotNull())
    vectors = staged(vectors.where(F.size("embedding") > 0), "unit-vectors")
    directed = vectors.where(F.exists("embedding", lambda x: x != 0))
    n = directed.count()
    lists = max(1, min(lists or round(n ** 0.5), MOST_LISTS, n))
    centroids = np.zeros((1, 1))
    if n:
        sample = directed.sample(min(1.0, lists * SAMPLE_PER_LIST / n), seed) if n > lists * SAMPLE_PER_LIST else directed
        packed = staged(sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")), "centroid-sample")
        fitted = KMeans(k=lists, distanceMeasure="cosine", maxIter=10, seed=seed).fit(packed)
        centroids = _unit(np.array(fitted.clusterCenters(), dtype=float))
        placed = vectors.withColumn("n", _nearest(centroids)(F.col("embedding")))
    else:
        placed = vectors.withColumn("n", F.struct(F.lit(ZERO).alias("list"), F.lit(0.0).alias("angle")))
    placed = staged(placed.select("id", "embedding", "n.list", "n.angle", F.monotonically_increasing_id().alias("place")), "placed")
    sizes = placed.groupBy("list").agg(F.count("*").alias("rows"), F.max("angle").alias("radius"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("rows") / PART_ROWS).cast("int"))
    names = df.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
    table = staged(sizes.join(names, "list", "left").select("list", "centroid", "rows", "parts", "radius"), "lists")
    rows = placed.join(table.select("list", "parts"), "list").select("id", "embedding", "list", F.pmod("place", F.col("parts")).cast("int").alias("part"))
    return VectorIndex(staged(rows, "list-rows"), table)


class _Router:
    """Which lists a query is sent to: first its nearest ones, later those that can hold a better row than it has."""

    def __init__(self, lists: pd.DataFrame, probes: int) -> None:
        self.names = lists["list"].to_numpy(np.int32)
        self.centroids = [None if c is None else np.asarray(c, float) for c in lists["centroid"]]
        self.radius, self.probes = lists["radius"].to_numpy(float), probes

    def _sims(self, x: np.ndarray) -> np.ndarray:
        return x @ np.array([np.zeros(x.shape[1]) if c is None else c for c in self.centroids]).T

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The highest cosine that a row of each list can have with each query; 0 where either has no direction."""
        angle = np.arccos(np.clip(self._sims(x), -1, 1)) - self.radius
        bound = np.cos(np.clip(angle, 0, np.pi))
        return np.where((self.names == ZERO)[None, :] | ~x.any(axis=1)[:, None], 0.0, bound)

    def routes(self, later: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if pdf.empty:
                    continue
                x = _matrix(pdf["v"])
                near = np.argsort(-np.where(self.names == ZERO, -2.0, self._sims(x)), axis=1, kind="stable")[:, : self.probes]
                sent = np.zeros((len(x), len(self.names)), bool)
                np.put_along_axis(sent, near, True, axis=1)
                if later:
                    sent = ~sent & (self.bounds(x) >= pdf["least"].to_numpy(float)[:, None] - SLACK)
                at, which = np.nonzero(sent)
                yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[at], "v": pdf["v"].to_numpy()[at], "list": self.names[which]})

        return run


def _ranked(k: int):
    """The k best rows of a part for each query sent to it."""

    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "id", "similarity"]
        if queries.empty or rows.empty:
            return pd.DataFrame({n: [] for n in names})
        rows = rows.sort_values("id", kind="stable")
        sims = np.round(_matrix(queries["v"]) @ _matrix(rows["embedding"]).T, 12)
        out = []
        ids = rows["id"].to_numpy()
        for q, s in zip(queries["query_id"].to_numpy(), sims):
            least = np.partition(s, -k)[-k] if len(s) > k else -np.inf
            able = np.flatnonzero(s >= least)
            best = able[np.argsort(-s[able], kind="stable")[:k]]
            out.append(pd.DataFrame({"query_id": np.repeat(q, len(best)), "id": ids[best], "similarity": s[best]}))
        return pd.concat(out)[names]

    return run


def _probe(index: VectorIndex, routed: DataFrame, k: int, schema: str) -> DataFrame:
    """The k best rows of every part for the queries sent to its list; each part meets its queries in blocks."""
    asked = routed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks"))
    wide = routed.join(index.lists.select("list", "parts").join(asked, "list"), "list")
    queries = wide.select("query_id", "v", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"))
    rows = index.rows.join(asked, "list").select("id", "embedding", "list", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    key = ["list", "part", "block"]
    return queries.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(_ranked(k), schema)


def search(queries: DataFrame, index: VectorIndex, *, k: int = 5, probes: int = 8, exact: bool = True, query_id: str = "query_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, id, similarity, rank): the k rows of the highest cosine for each query, ties by id.

    The ``probes`` nearest lists are read first. With ``exact`` all lists that may hold a row as good as the k-th found
    are read too, so the answer is that of a full search; without it, it is approximate. Query ids must be unique;
    queries without a vector get no rows, those of zeros have similarity 0 with everything.
    """
    spark = queries.sparkSession
    vectors = queries.select(F.col(query_id).alias("query_id"), tf.unit_vector(F.col(embedding)).alias("v"))
    vectors = staged(vectors.where(F.col("v").isNotNull() & (F.size("v") > 0)), "query-vectors")
    lists = index.lists.orderBy("list").toPandas()
    if len(lists) > MOST_LISTS + 1:
        raise ValueError(f"the index has more than {MOST_LISTS} lists")
    id_type, row_type = dict(vectors.dtypes)["query_id"], dict(index.rows.dtypes)["id"]
    schema = f"query_id {id_type}, id {row_type}, similarity double"
    if lists.empty:
        return spark.createDataFrame([], schema + ", rank int")
    router, route = _Router(lists, probes), f"query_id {id_type}, v array<double>, list int"
    vectors = vectors.withColumn("v", F.col("v").cast("array<double>"))
    found = staged(_probe(index, staged(vectors.mapInPandas(router.routes(False), route), "routes"), k, schema), "first-found")
    if exact:
        asked = vectors.join(_kth(found, k), "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
        more = staged(asked.mapInPandas(router.routes(True), route), "more-routes")
        found = found.unionByName(_probe(index, more, k, schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _kth(found: DataFrame, k: int) -> DataFrame:
    """The k-th best similarity of each query that has k rows."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"))
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select("query_id", F.col("similarity").alias("least"))
