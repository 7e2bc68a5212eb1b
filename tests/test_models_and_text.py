"""Splits, spectrum, reduction, metrics, vectors, text and streams on small fixtures."""

import math
import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantlens.functions import domain
from plantlens.functions import text as tf
from plantlens.operators import evaluate, forecast, reduce, spectrum, split, text, vectors
from plantlens.plans import business
from plantlens.sources import readers
from plantlens.streaming import jobs
from tests.helpers import close, pdf, series


@pytest.mark.parametrize("n", [0, 4, 5, 11, 1000])
def test_random_split_is_exact_and_repeatable(spark, n):
    df = spark.range(n).withColumn("x", F.col("id") * 1.0)
    parts = {r["split"]: r["count"] for r in split.random(df, key="id").groupBy("split").count().collect()}
    assert parts.get("test", 0) == (math.ceil(0.2 * n) if n >= 5 else 0)
    again = split.random(df.repartition(5), key="id").filter("split = 'test'").select("id")
    assert again.exceptAll(split.random(df, key="id").filter("split = 'test'").select("id")).count() == 0


def test_nth_smallest_refines_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(split, "EXACT_BUCKET", 3)
    df = spark.range(5000).withColumn("h", F.col("id") * 7 % 5000)
    for n in (1, 17, 2500, 5000):
        assert split.nth_smallest(df, F.col("h"), F.col("id"), n)[0] == n - 1


def test_chronological_split_positions(spark):
    out = pdf(split.chronological(series(spark, [float(i) for i in range(50)]), keys=["unit"], ts="ts"), "ts")
    assert out["split"].tolist() == ["train"] * 35 + ["val"] * 5 + ["test"] * 10


@pytest.mark.parametrize("n", [8, 48, 97, 120])
def test_spectrum_equals_numpy(spark, n):
    v = np.random.default_rng(n).normal(0, 1, n)
    out = pdf(spectrum.magnitudes(series(spark, v.tolist()), keys=["unit"], ts="ts", cols=["value"]), "bin")
    want = np.abs(np.fft.fft(v))[1:n // 2]
    assert out["bin"].tolist() == list(range(1, n // 2))
    close(out["magnitude"], want, 1e-8)


def test_components_match_numpy_up_to_sign(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (80, 3)) @ np.diag([5.0, 2.0, 0.1]) + 100
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    out, ratios = reduce.pca(df, ["a", "b", "c"])
    values, _ = np.linalg.eigh(np.cov(x.T))
    want = np.sort(values)[::-1] / values.sum()
    close(ratios, want[:2], 1e-8)
    assert out.columns == ["PC1", "PC2"] and abs(out.agg(F.avg("PC1")).first()[0]) < 1e-6


def test_metrics_and_edge_cases(spark):
    df = spark.createDataFrame([("a", 1.0, 1.5), ("a", 3.0, 2.0), ("flat", 2.0, 2.0), ("off", 2.0, 3.0)], "g string, y double, p double")
    got = {r["g"]: r for r in evaluate.metrics(df, y="y", yhat="p", by=["g"]).collect()}
    assert abs(got["a"]["r2"] - (1 - (0.25 + 1.0) / 2.0)) < 1e-12
    assert got["flat"]["r2"] == 1.0 and got["off"]["r2"] == 0.0


def test_weights_are_equal_without_skill(spark):
    df = spark.createDataFrame([("a", -1.0), ("b", -2.0)], "model string, r2 double")
    assert {r["weight"] for r in evaluate.r2_weights(df).collect()} == {0.5}


def test_forecasters_save_load_and_beat_the_mean(spark, tmp_path):
    rows = [(float(i), 3.0 * i + (i % 5), 2.0 * i) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    model = forecast.fit(df, features=["x"], targets=["y", "z"])
    forecast.save(model, str(tmp_path / "m"))
    pred = forecast.long_predictions(forecast.predict(forecast.load(str(tmp_path / "m")), df), ["y", "z"])
    assert all(r["r2"] > 0.99 for r in evaluate.metrics(pred, y="y", yhat="yhat", by=["target"]).collect())


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (60, 8))
    x[7] = 0
    x[9] = x[8]
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    index = vectors.build_index(df, id_col="vec_id", embedding="embedding")
    queries = df.filter("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding")
    got = pdf(vectors.search(queries, index, k=4), "query_id", "rank")
    unit = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    sims = np.round(unit @ unit.T, 12)
    for q in range(5):
        want = sorted(range(60), key=lambda i: (-sims[q, i], i))[:4]
        assert got[got.query_id == q]["id"].tolist() == want


def test_classify_blank_vector(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.1])], "id int, v array<double>")
    cats = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "name string, c array<double>")
    out = {r["id"]: r["category"] for r in vectors.classify(df, cats, embedding="v", label="name", vector="c").collect()}
    assert out == {1: "", 2: "x"}


def test_embedding_is_the_mean_of_its_token_vectors(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "beta"), (4, "  "), (5, None)], "id int, t string")
    e = {r["id"]: np.array(r["embedding"]) for r in vectors.embed(df, id_col="id", text="t", dims=130).collect()}
    assert np.allclose(e[1], (e[2] + e[3]) / 2) and not e[4].any() and not e[5].any()
    assert set(np.unique(e[2])) <= {-1.0, 1.0}


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def test_error_rates_are_ratios_of_sums_and_handle_non_ascii(spark):
    df = spark.createDataFrame([("机组 排放 正常", "机组 排放 超常"), ("a b c d", "a c d")], "r string, h string")
    row = text.error_rates(df, ref="r", hyp="h").first()
    assert (row["char_edits"], row["word_edits"], row["words"]) == (3, 2, 7)
    assert abs(row["wer"] - 2 / 7) < 1e-12


def test_extract_sql_forms(spark):
    cases = [("x ```sql\nSELECT 1\n``` y", "SELECT 1"), ("then select a\nfrom t; and", "select a\nfrom t;"), ("  none ", "none")]
    df = spark.createDataFrame([(a,) for a, _ in cases], "a string")
    assert [r[0] for r in df.select(tf.extract_sql(F.col("a"))).collect()] == [b for _, b in cases]


def test_normalise_unicode_space_and_null(spark):
    df = spark.createDataFrame([("　 a \n b ",), (None,)], "t string")
    assert [r[0] for r in df.select(tf.normalise(F.col("t"))).collect()] == ["a b", ""]


@pytest.mark.parametrize("question,intent,unit", [
    ("1号机组排放情况", "unit_emissions", 1), ("过去24小时超标次数", "exceedance_count", None), ("#12 机组状态", "unit_status", 12),
    ("SO2平均浓度", "average", None), ("天气", "unknown", None)])
def test_intent(spark, question, intent, unit):
    row = spark.createDataFrame([(question,)], "q string").select(*[c.alias(n) for n, c in tf.intent(F.col("q")).items()]).first()
    assert (row["intent"], row["unit_no"]) == (intent, unit)


def test_keywords_of_blank_text(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "")], "id long, t string")
    out = {r["id"]: r["keywords"] for r in text.keywords(df, id_col="id", text="t", k=2).collect()}
    assert out[3] == [] and out[2] == ["c", "a"]


def test_keywords_with_and_without_hot_terms(spark, monkeypatch):
    rows = [(i, f"common w{i} w{i % 3}") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, t string")
    want = {r["id"]: r["keywords"] for r in text.keywords(df, id_col="id", text="t", k=3).collect()}
    monkeypatch.setattr(text, "HOT_TERMS", 4)
    assert {r["id"]: r["keywords"] for r in text.keywords(df, id_col="id", text="t", k=3).collect()} == want


@pytest.mark.parametrize("hot", [1, 30, 20_000])
def test_keywords_equal_brute_force(spark, monkeypatch, hot):
    import collections
    import math
    import random

    monkeypatch.setattr(text, "HOT_TERMS", hot)
    r = random.Random(4)
    blanks = [" ", "\t", "\x1c", "\u00a0", "\u2003", "\u3000", "\x85 "]
    rows = [(i, r.choice(blanks).join(r.choice(["the", "a", "Été", "ΟΔΟΣ", f"w{r.randrange(40)}", f"u{i}x{r.randrange(3)}"]) for _ in range(r.randrange(30)))) for i in range(60)]
    rows += [(7, "the the w1 again"), (7, "again"), (None, "w1 lost"), (90, None), (91, " \u00a0")]
    words = collections.defaultdict(collections.Counter)
    for i, t in rows:
        words[i].update((t or "").lower().split())
    df = collections.Counter(w for c in words.values() for w in c)

    def best(i):
        score = {w: round(n * (math.log((1 + len(rows)) / (1 + df[w])) + 1), 9) for w, n in words[i].items()}
        return sorted(score, key=lambda w: (-score[w], w))[:5] if i is not None else []

    frame = spark.createDataFrame(rows, "id long, t string").repartition(3)
    found = text.keywords(frame, id_col="id", text="t").collect()
    assert len(found) == len(rows) and all(x["keywords"] == best(x["id"]) for x in found)
    plan = text.keywords(frame.where("id < 7"), id_col="id", text="t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no row for each word of a text


def test_guarded_ratio_and_unit_without_facts(spark):
    df = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(domain.guarded_ratio(F.col("a"), F.col("b"))).collect()] == [0.0, 2.0]


def test_month_summary_matches_the_multiplied_join(spark):
    units = spark.createDataFrame([(1, 10, domain.COAL, 5.0), (2, 10, domain.GAS, 7.0), (3, 11, domain.WIND, 9.0)], "unit_id long, plant_id long, unit_type string, rating double")
    a = spark.createDataFrame([(1, 10.0, 90.0), (1, 30.0, 92.0), (2, 5.0, 91.0)], "unit_id long, so2 double, fgd_efficiency double")
    b = spark.createDataFrame([(1, 7.0, 80.0), (2, 9.0, 81.0), (2, 11.0, 83.0)], "unit_id long, nox double, scr_efficiency double")
    c = spark.createDataFrame([(2, 1.0)], "unit_id long, soot double")
    got = business.month_summary(a, b, c, units).first()
    x = units.toPandas()
    for t in (a, b, c):
        x = x.merge(t.toPandas(), on="unit_id", how="left")
    close([got["avg_so2"], got["avg_nox"], got["avg_soot"], got["avg_rating"], got["avg_fgd"]],
          [x.so2.mean(), x.nox.mean(), x.soot.mean(), x.rating.mean(), x.fgd_efficiency.mean()])
    assert (got["plants"], got["coal_units"]) == (2, 1)


def test_unit_table_unpivots_units_not_readings(spark):
    day = [datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [(1, day[0], 40.0, 10.0, None), (1, day[2], None, 45.0, 4.5), (1, day[1], 20.0, 60.0, 5.5), (1, None, 99.0, None, float("nan")),
            (2, day[1], None, None, None), (2, day[1], None, None, None), (None, day[0], 36.0, 50.0, 1.0), (None, day[0], 36.0, 50.0, 1.0), (3, None, 7.0, 8.0, 9.0)]
    facts = spark.createDataFrame(rows, "unit_id long, ts timestamp_ntz, so2 double, nox double, soot double").repartition(3)
    found = business.unit_table(facts)
    assert found.columns == ["unit_id", "pollutant", "limit", "current", "average", "maximum", "status"]
    got = {(r["unit_id"], r["pollutant"]): tuple(r)[2:] for r in found.collect()}
    assert found.count() == 12 and repr(got.pop((1, "soot"))) == "(5.0, 4.5, nan, nan, 'warning')"
    assert got == {
        (1, "so2"): (35.0, None, 53.0, 99.0, "normal"), (1, "nox"): (50.0, 45.0, 115 / 3, 60.0, "warning"),
        (2, "so2"): (35.0, None, None, None, "normal"), (2, "nox"): (50.0, None, None, None, "normal"), (2, "soot"): (5.0, None, None, None, "normal"),
        (3, "so2"): (35.0, None, 7.0, 7.0, "normal"), (3, "nox"): (50.0, None, 8.0, 8.0, "normal"), (3, "soot"): (5.0, None, 9.0, 9.0, "normal"),
        (None, "so2"): (35.0, 36.0, 36.0, 36.0, "danger"), (None, "nox"): (50.0, 50.0, 50.0, 50.0, "warning"), (None, "soot"): (5.0, 1.0, 1.0, 1.0, "normal")}
    assert business.unit_table(facts.limit(0)).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and plan.index("Generate") < plan.index("Exchange")  # no row for each reading and pollutant


def test_page_is_clamped(spark):
    df = spark.createDataFrame([(1, i, 1.0, 1.0, 1.0) for i in range(7)], "unit_id long, ts int, so2 double, nox double, soot double")
    row = business.list_emissions(df, page=99, page_size=3).collect()
    assert len(row) == 1 and row[0]["page"] == 3 and not row[0]["has_next"] and row[0]["has_prev"]


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    df = series(spark, [float(i) for i in range(48)], step=1800)
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    df.limit(24).write.parquet(src)
    stream = jobs.hourly_mean(jobs.read_stream(spark, src, df.schema), unit="unit", ts="ts", value="value", late="1 hour")
    jobs.run_available(stream, out, chk)
    first = spark.read.parquet(out).count()
    df.exceptAll(df.limit(24)).write.mode("append").parquet(src)
    stream = jobs.hourly_mean(jobs.read_stream(spark, src, df.schema), unit="unit", ts="ts", value="value", late="1 hour")
    jobs.run_available(stream, out, chk)
    got = pdf(spark.read.parquet(out), "hour")
    assert len(got) > first
    want = df.toPandas().set_index("ts")["value"].resample("h").mean()
    close(got["value"], want.iloc[:len(got)])
    assert isinstance(want.index[0], pd.Timestamp)


def test_predict_keeps_every_row(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)], "x double, y double")
    model = forecast.fit(df, features=["x"], targets=["y"])
    holes = spark.createDataFrame([(3.0,), (None,), (float("nan"),)], "x double")
    got = [r["y_pred"] for r in forecast.predict(model, holes).collect()]
    assert len(got) == 3 and got[0] == pytest.approx(6.0) and got[1:] == [None, None]


def test_validity_check_runs_nothing(spark, tmp_path):
    where = str(tmp_path / "rows")
    spark.sql(f"CREATE TABLE kept_rows (a INT) USING parquet LOCATION '{where}'")
    try:
        assert not text.statement_is_valid(spark, "WITH x AS (SELECT 1 AS a) INSERT INTO kept_rows SELECT a FROM x")
        assert spark.table("kept_rows").count() == 0
        assert text.statement_is_valid(spark, "WITH x AS (SELECT a FROM kept_rows) SELECT a, a FROM x ORDER BY a -- end")
        assert not text.statement_is_valid(spark, "SELECT missing FROM kept_rows")
        assert not text.statement_is_valid(spark, "SELECT 1) t UNION (SELECT 2")
    finally:
        spark.sql("DROP TABLE kept_rows")


def test_reader_takes_nan_for_missing(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("time\tv\n2024/01/01 00:00\tNaN\n2024/01/01 01:00\t-\n2024/01/01 02:00\t1.5\n")
    got = readers.read_series_tsv(spark, str(tmp_path / "a.tsv"), ["v"]).orderBy("ts").collect()
    assert [r["v"] for r in got] == [None, None, 1.5]


def test_word_distance_equals_the_edit_table_without_python(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "A", "größe", "达标", "😀", "\ufeff", "x#y", "0"]
    pairs = [(" ".join(rng.choices(words, k=rng.randint(0, 12))), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(300)]
    pairs += [(" ".join(rng.choices("abc", k=rng.randint(0, 9))), " ".join(rng.choices("abcd", k=rng.randint(0, 9)))) for _ in range(200)]
    pairs += [("", ""), ("", "a b"), ("a", None), (None, None), ("a " * 400 + "b", "b " + "a " * 399)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, r string, h string").select("i", text.word_distance(F.col("r"), F.col("h")).alias("n"))
    assert "Python" not in df._jdf.queryExecution().toString()
    got = {r["i"]: r["n"] for r in df.collect()}
    for i, (r, h) in enumerate(pairs):
        assert got[i] == (None if r is None or h is None else _edits(r.split(), h.split())), pairs[i]


def test_code_points_are_one_character_each_beyond_one_plane(spark):
    n = 200_000
    s = spark.range(1).select(text.code_points(F.sequence(F.lit(0), F.lit(n - 1))).alias("s")).first()["s"]
    assert len(s) == len(set(s)) == n
    last = spark.range(1).select(text.code_points(F.array(F.lit(1_048_575))).alias("s")).first()["s"]
    assert ord(last) == 0x10FFFF
