"""Words of text without blanks: the planted lexicon is found, paths equal brute force, keywords follow."""

import itertools
import math
import random

import pytest

from plantlens.operators import segment, text, vectors

PLANTED = ["排放", "浓度", "机组", "负荷", "超标", "二氧化硫", "发电厂", "运行", "监测", "正常"]


@pytest.fixture(scope="module")
def lines():
    r = random.Random(6)
    return ["".join(r.choice(PLANTED + ["的", "在", "了"]) for _ in range(12)) for _ in range(400)]


@pytest.fixture(scope="module")
def table(spark, lines):
    rows = [(i, t, "x") for i, t in enumerate(lines)] + [(900, None, "x"), (901, "", "x"), (902, "NOx 排放超标 today,Good 的机组", "x"), (903, "plain words", "x"), (904, "𠀀 龥", "x")]
    return spark.createDataFrame(rows, "id long, text string, word string").repartition(4)


@pytest.fixture(scope="module")
def words(table):
    return segment.lexicon(table, "text", min_count=40, min_cohesion=4.0, min_entropy=1.0)


def test_planted_words_are_found(words, lines):
    got = {r["word"]: r["n"] for r in words.collect()}
    longer = {w for w in got if len(w) > 1}
    assert longer == set(PLANTED)
    assert got["排放"] == sum(t.count("排放") for t in lines) + 1
    assert {w for w in got if len(w) == 1} >= {"的", "硫"}


def test_best_path_equals_brute_force():
    r = random.Random(1)
    model = segment.Segmenter({"a": 5, "b": 9, "c": 3, "ab": 4, "bc": 6, "abc": 2, "cab": 1, "bb": 7})

    def cost(path):
        return sum(model.cost.get(w, model.unknown if len(w) == 1 else math.inf) for w in path)

    for _ in range(80):
        run = "".join(r.choice("abcz") for _ in range(r.randrange(1, 9)))
        paths = [[run[a:b] for a, b in itertools.pairwise([0, *cut, len(run)])] for n in range(len(run)) for cut in itertools.combinations(range(1, len(run)), n)]
        assert math.isclose(cost(model.cut(run)), min(map(cost, paths)))
        assert "".join(model.cut(run)) == run
    assert model.cut("") == []


def test_segmented_texts_keep_other_words(table, words):
    got = {r["id"]: r["tokens"] for r in segment.segmented(table, "text", words).collect()}
    assert got[902] == ["nox", "排放", "超标", "today,good", "的", "机组"]
    assert got[900] == got[901] == [] and got[903] == ["plain", "words"] and got[904] == ["𠀀", "龥"]
    assert all("".join(got[i]) for i in range(400))
    assert set(itertools.chain(*[got[i] for i in range(400)])) == {*PLANTED, "的", "在", "了"}


def test_keywords_and_vectors_of_unspaced_text(table, words):
    cut = segment.segmented(table, "text", words).where("id in (3, 902, 900)")
    found = {r["id"]: r["keywords"] for r in text.keywords(cut, id_col="id", text="text", k=3, tokens="tokens").collect()}
    assert set(found[902]) <= {"nox", "排放", "超标", "today,good", "的", "机组"} and len(found[902]) == 3 and found[900] == []
    vector = {r["id"]: r["embedding"] for r in vectors.embed(cut, id_col="id", text="text", dims=8, tokens="tokens").collect()}
    assert any(vector[902]) and not any(vector[900])


def test_empty_tables(table):
    none = segment.lexicon(table.where("false"), "text")
    assert none.count() == 0
    assert segment.segmented(table.where("id = 902"), "text", none).first()["tokens"] == ["nox", *"排放超标", "today,good", *"的机组"]
