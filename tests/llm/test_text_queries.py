"""The registered text queries on the smallest tables: SQL where there is some, else their contracts, and the pipeline."""

import random
import re

import duckdb
import pytest

import corpus_pipeline
from plantlens.llm import simhash
from plantlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = sorted(map(repr, (tuple(r[c] for c in sorted(got.columns)) for r in got.collect())))
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        columns = [c[0] for c in cur.description]
        at = [columns.index(c) for c in sorted(got.columns)]
        assert rows == sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())
    elif name not in ("op4_decontamination", "op13_ranked_search"):
        table = "pages" if "page_id" in got.columns else "documents"
        assert len(rows) == duck.execute(f"SELECT count(*) FROM {table}").fetchone()[0]


WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("ta", "so", "vi", "pe", "dor", "min")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) + ("." if i % 8 == 7 else "") for i in range(n)) + "."


def brute_classes(texts):
    prints = [simhash.fingerprint(t, 3) for t in texts]
    at = list(range(len(texts)))
    for i, p in enumerate(prints):
        for j, q in enumerate(prints):
            if (p ^ q).bit_count() <= 3:
                at = [min(at[i], at[j]) if c in (at[i], at[j]) else c for c in at]
    return at


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept, against a plain version of the stage; columns that clash pass through."""
    items = [(i, prose(900 + i, 30)) for i in range(6)]
    texts = [prose(i, 40 + i) for i in range(60)]
    texts += [texts[3], texts[3], texts[4].replace(".", "!", 1)] + [prose(200 + i, 40) + " " + t + " " + prose(300 + i, 40) for i, t in items]
    texts += [prose(400 + i, 40) + f" Write to jo{i}@mail.example or 10.0.0.{i} please." for i in range(12)]
    texts += [None, "", "two words.", "Please log in.\n" * 20, "again and again " * 30, prose(500, 60) + "\nReleased under the MIT License."]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "q", "b", 7) for i, t in enumerate(texts)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, quality string, base string, times long"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, str(tmp_path)), name)
        seen.append({r["doc_id"]: r.asDict() for r in docs.collect()})
    judged, single, clean, private, mix = seen
    expected = {i: t for i, t in enumerate(texts) if t and 10 <= len(t.split()) and not t.startswith(("Please", "again"))}
    assert {i: r["text"] for i, r in judged.items()} == {i: t.replace("\nReleased under the MIT License.", "") for i, t in expected.items()}
    ids = sorted(judged)
    classes = brute_classes([judged[i]["text"] for i in ids])
    assert set(single) == {min(i for i, c in zip(ids, classes) if c == k) for k in set(classes)}
    assert set(clean) == {i for i, r in single.items() if not any(t in r["text"] for _, t in items)}
    assert set(private) == set(clean)
    for i, r in private.items():
        found = re.sub(r"[a-z0-9]+@mail\.example", "[EMAIL]", clean[i]["text"])
        assert r["text"] == re.sub(r"10\.0\.0\.[0-9]+", "[IP]", found) and r["n_chars"] == len(r["text"])
    size = {s: sum(len(r["text"].split()) for r in private.values() if r["source"] == s) for s in ("s0", "s1", "s2")}
    share = dict(zip(sorted(size), fill([size[s] for s in sorted(size)], [5, 2, 1])))
    for s in size:
        taken = sum(len(r["text"].split()) * r["times"] for r in mix.values() if r["source"] == s)
        assert abs(taken - share[s]) <= 2 * max(len(r["text"].split()) for r in private.values())
    assert all(r["times"] in (1, 2) and r["quality"] == "q" and r["base"] == "b" and {k: v for k, v in r.items() if k != "times"} == {k: v for k, v in private[i].items() if k != "times"} for i, r in mix.items())


def fill(sizes, weights):
    """Targets that share 1.5 times all sizes by weight, at most twice a size each."""
    out, left, open_ = [0.0] * len(sizes), 1.5 * sum(sizes), set(range(len(sizes)))
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if level * weights[i] > 2 * sizes[i]}
        for i in full or open_:
            out[i] = 2 * sizes[i] if full else level * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def test_pipeline(spark, duck):
    out = corpus_pipeline.run(spark, SF).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixture"]
    ids = [r["doc_id"] for r in out]
    kept = {r["doc_id"] for r in QUERIES["op2_quality_rules"](spark, SF).where("kept").collect()}
    leaked = {r["doc_id"] for r in QUERIES["op4_decontamination"](spark, SF).collect()}
    assert ids and len(set(ids)) == len(ids) and set(ids) <= kept - leaked
    assert all(r["n_chars"] == len(r["text"]) and r["times"] in (1, 2) and "@mail" not in r["text"] for r in out)
    assert len({r["text"] for r in out}) == len(out)
