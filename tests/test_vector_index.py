"""The vector index against a full search."""

import numpy as np
import pytest

from plantlens.operators import vector_index

DIMS = 16


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, DIMS))
    x = centres[r.integers(0, 12, 900)] + 0.5 * r.normal(size=(900, DIMS))
    x[100:400] = x[100]  # a third are copies
    x[7] = 0.0
    return x


@pytest.fixture(scope="module")
def table(spark, vectors):
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)] + [(5000, None, "x"), (5001, [], "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string").repartition(5)


@pytest.fixture(scope="module")
def index(table):
    return vector_index.build(table, id_col="vec_id", embedding="embedding")


def brute(vectors, ids, k):
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    sims = np.round(unit[ids] @ unit.T, 12)
    return {q: sorted(range(len(vectors)), key=lambda j: (-s[j], j))[:k] for q, s in zip(ids, sims)}


def asked(table, ids):
    return table.where(table.vec_id.isin([*ids, 5000, 5001])).withColumnRenamed("vec_id", "query_id")


def listed(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_exact_search_equals_a_full_one(table, index, vectors):
    ids = [*range(0, 900, 100), 7, 101, 555]
    for k, probes in ((10, 1), (3, 4)):
        assert listed(vector_index.search(asked(table, ids), index, k=k, probes=probes)) == brute(vectors, ids, k)


def test_recall_of_a_search_in_the_nearest_lists(table, index, vectors):
    ids = [i for i in range(0, 900, 100) if i not in range(100, 400)]
    got, want = listed(vector_index.search(asked(table, ids), index, k=10, exact=False)), brute(vectors, ids, 10)
    assert sum(len(set(got[q]) & set(want[q])) for q in ids) >= 0.9 * 10 * len(ids)


def test_every_row_is_in_a_list_and_parts_are_bounded(spark, table, vectors, monkeypatch, tmp_path):
    monkeypatch.setattr(vector_index, "PART_ROWS", 50)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 2)
    index = vector_index.build(table, id_col="vec_id", embedding="embedding", lists=9)
    index.save(str(tmp_path / "index"))
    index = vector_index.load(spark, str(tmp_path / "index"))
    assert sorted(r["id"] for r in index.rows.select("id").collect()) == list(range(900))
    assert index.rows.groupBy("list", "part").count().agg({"count": "max"}).first()[0] <= 60
    ids = list(range(0, 900, 60))
    assert listed(vector_index.search(asked(table, ids), index, k=4, probes=2)) == brute(vectors, ids, 4)


def test_empty_tables(table, index):
    none = vector_index.build(table.where("false"), id_col="vec_id", embedding="embedding")
    assert vector_index.search(asked(table, [1, 2]), none).count() == 0
    assert vector_index.search(asked(table, []).where("false"), index).count() == 0
    zeros = vector_index.build(table.where("vec_id in (7, 5000)"), id_col="vec_id", embedding="embedding")
    assert listed(vector_index.search(asked(table, [1]), zeros)) == {1: [7]}
