"""Token id files, importance resampling and ranked search against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest

from plantlens.llm import idfiles, ranking, resample

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def some_text(r, n):
    words = ["Alpha", "beta", "b2", "Été", "中文", "the", "the", "the", "x" * 70, "Ä", "of-of", "end.", "7"] + [f"w{i}" for i in range(60)]
    return r.choice([" ", "\n", " \n ", "  "]).join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    rows = [(i, some_text(r, r.randrange(80))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t."), (None, "the alpha of no id " * 6), (None, None), (7, rows[7][1]), (9, "another text of row nine the the"), (-3, "w1 " * 3000), (203, "<|endoftext|> a\tb\r\nc")]
    return rows + [(300, rows[3][1])] * 25


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "s", 1, 2) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, rank int, n long").repartition(4)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "the alpha b2 w1 w2 W3"), (2, "Été 中文"), (3, None), (4, "nothing known"), (5, "the"), (None, "w1"), (2, "w9 w9"), (6, "")], "item_id long, text string")


def token_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(token_ids, "model"):
        token_ids.model = Tokenizer.from_file(idfiles.tokenizer_path(None))
    return [*token_ids.model.encode(text or "", add_special_tokens=False).ids, 0]


def test_token_ids_round_trip(spark, docs, corpus, tmp_path):
    path = str(tmp_path / "ids")
    idfiles.write(docs, path)
    got = sorted(idfiles.documents(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    assert len(got) == len(corpus)
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]), zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"])))
        at += r["n_tokens"]
    keys = [(r["id"] is None, r["id"] or 0) for r in got]
    assert keys == sorted(keys)
    assert sorted(repr((r["id"], r["ids"])) for r in got) == sorted(repr((i, token_ids(t))) for i, t in corpus)
    raw = sorted((tmp_path / "ids" / "ids").glob("part-*"))[0].read_bytes()
    assert np.frombuffer(raw[: 2 * got[0]["n_tokens"]], "<u2").tolist() == got[0]["ids"]


def test_cut_texts_have_the_ids_of_whole_texts():
    r = random.Random(8)
    parts = ["word", "Été", "ñaß", "ªº", "a×b", "÷", "µ", "don't", "we'LL", "'s", "''", "x's!", "end.", "(a)", "!?", "7", "b2", "²", "Ⅷ", "a_b", "_", "中文", "жук", "e\u0301", "\u0250", "<|endoftext|>", "a<|endoftext|>", "<|", "\x1c", "\x85", "ʰ", "\U0001f600", "İ", "word"]
    gaps = [" ", " ", " ", " ", "\n", "\t", "\r", "\xa0", "\u2003", "", "\x0b"]
    texts = ["".join(r.choice(parts) + r.choice(gaps) for _ in range(r.randrange(30))) for _ in range(3000)]
    texts += ["", " ", "\n", "a ", " a", "a  b", "a\n\nb ", "a \u2003 b"]
    for at in range(0, len(texts), 700):
        got = idfiles.encoded(texts[at : at + 700], "<u2", idfiles.tokenizer_path(None))
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [token_ids(t)[:-1] for t in texts[at : at + 700]]
    assert idfiles.encoded([], "<u2", idfiles.tokenizer_path(None)) == []


def test_words_are_not_encoded_as_texts(monkeypatch):
    r, n, ids = random.Random(9), [], idfiles._ids
    monkeypatch.setattr(idfiles, "_ids", lambda model, texts, dtype: n.append(len(texts)) or ids(model, texts, dtype))
    words = ["".join(r.choices("abcdeéñß", k=9)) + r.choice(["", "", ".", "$$$"]) for _ in range(4000)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, 4000, 100)]
    got = idfiles.encoded(texts, "<u2", idfiles.tokenizer_path(None))
    assert sum(n) < 100
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [token_ids(t)[:-1] for t in texts]


def test_pieces_that_were_let_go_are_encoded_again(monkeypatch):
    monkeypatch.setattr(idfiles, "HELD", 40)
    r, path = random.Random(10), idfiles.tokenizer_path(None)
    words = ["".join(r.choices("abcéñ", k=4)) for _ in range(150)] + [f"n{i}!" for i in range(60)]
    for size in (3, 60, 5, 200, 5):
        texts = [" ".join(r.choice(words) for _ in range(size)) for _ in range(4)]
        assert [np.frombuffer(x, "<u2").tolist() for x in idfiles.encoded(texts, "<u2", path)] == [token_ids(t)[:-1] for t in texts]


def test_lookup_by_key(spark, docs, corpus, tmp_path):
    path = str(tmp_path / "ids")
    idfiles.write(docs, path)
    wanted = [7, 300, -3, 200, 9, 10**12, -10**12, 204, None, 7]
    got = idfiles.lookup(spark, path, spark.createDataFrame([(k,) for k in wanted], "k long")).collect()
    assert sorted((r["id"], r["ids"]) for r in got) == sorted((i, token_ids(t)) for i, t in corpus if i in set(wanted) and i is not None)


def test_token_ids_of_empty_tables_and_bad_end(spark, docs, tmp_path):
    path = str(tmp_path / "ids")
    idfiles.write(docs.where("false"), path)
    assert idfiles.documents(spark, path).count() == 0
    assert idfiles.lookup(spark, path, docs.select("doc_id")).count() == 0
    with pytest.raises(ValueError):
        idfiles.write(docs, str(tmp_path / "other"), end_id=50256)


def test_perfect_hash_is_minimal_and_knows_strangers():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(-(2**62), 2**62, 20_000))
    found = idfiles.PerfectHash.build(keys)
    assert sorted(found.slots(keys)) == list(range(len(keys)))
    assert len(idfiles.PerfectHash.build(keys[:0]).slots(keys[:5])) == 5
    again = idfiles.PerfectHash(found.sizes, found.bits, found.left)
    assert (again.slots(keys) == found.slots(keys)).all()


def test_perfect_hash_keeps_keys_that_no_level_places(monkeypatch):
    monkeypatch.setattr(idfiles, "LEVELS", 1)
    keys = np.arange(500)
    found = idfiles.PerfectHash.build(keys)
    assert len(found.left) and sorted(found.slots(keys)) == list(range(500))


def brute_resampled(corpus, target):
    def features(text):
        w = re.findall(WORD, lowered(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for counts, texts in ((s, [x for _, x in corpus]), (t, target)):
        for x in texts:
            np.add.at(counts, features(x)[1], 1)
    gain = [math.floor(1000 * math.log((y + 1) * (s.sum() + 10000) / ((x + 1) * (t.sum() + 10000)))) for x, y in zip(s.tolist(), t.tolist())]
    rows = []
    for i, x in corpus:
        n, f = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return rows


def test_hasher(corpus, monkeypatch):
    monkeypatch.setattr(resample, "HELD_WORDS", 40)
    hasher = resample.Hasher()
    for start in range(0, len(corpus), 9):
        texts = [resample.words_of(t) for _, t in corpus[start : start + 9]]
        got = sorted(zip(*[x.tolist() for x in hasher.features(texts)]))
        assert got == sorted((zlib.crc32(b" ".join(w[i : i + k])), n) for n, w in enumerate(texts) for k in (1, 2, 3) for i in range(len(w) - k + 1))


def test_resampled(spark, docs, items, corpus):
    got = resample.resampled(docs, items, percent=30, segments=5).collect()
    want = brute_resampled(corpus, [r["text"] for r in items.collect()])
    assert sorted(repr(tuple(r)[:5]) for r in got) == sorted(map(repr, want))
    eligible = sorted((-w[4], w[0] is None, w[0] or 0, w[2]) for w in want if w[1] >= 20)
    drawn = sorted((r["rank"], -r["score"], r["id"] is None, r["id"] or 0, r["n_features"]) for r in got if r["rank"] is not None)
    n = 30 * len(eligible) // 100
    assert [d[0] for d in drawn] == list(range(1, n + 1)) and [d[1:] for d in drawn] == eligible[:n]


def test_resampled_empty_tables(spark, docs, items):
    assert resample.resampled(docs.where("false"), items).count() == 0
    assert resample.resampled(docs, items.where("false")).count() == docs.count()


@pytest.mark.parametrize("segments", [1, 3, 40])
def test_ranks_split_ties(spark, segments):
    r = random.Random(2)
    rows = [(r.randrange(5), r.randrange(3)) for _ in range(400)] + [(2, 2)] * 300
    got = resample.ranks(spark.createDataFrame(rows, "a long, b long").repartition(6), ["a", "b"], segments).collect()
    assert sorted(x["rank"] for x in got) == list(range(1, 701))
    assert [(x["a"], x["b"]) for x in sorted(got, key=lambda x: x["rank"])] == sorted(rows)


def brute_ranked(corpus, items, k=10):
    texts = [(i, re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))) for i, t in corpus]
    texts = [(i, t) for i, t in texts if t]
    n_docs, total = len(texts), sum(len(t) for _, t in texts)
    queries = {}
    for q, t in items:
        if q is not None:
            queries.setdefault(q, set()).update(re.findall(WORD, lowered(t)))
    out = []
    for q, terms in queries.items():
        w = {x: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(x in t for _, t in texts) + 1))) for x in terms}
        scored = []
        for i, t in texts:
            m = 10 + 90 * len(t) * n_docs // total
            s = sum(w[x] * (1_000_000_000 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in terms if x in t)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("shard, first, block", [(8192, 64, 200_000), (16, 2, 200_000), (40, 1, 3)])
def test_search_equals_brute_force(spark, docs, items, corpus, monkeypatch, shard, first, block):
    for name, value in (("SHARD", shard), ("FIRST", first), ("BLOCK_TERMS", block)):
        monkeypatch.setattr(ranking, name, value)
    got = ranking.search(docs, items).collect()
    want = brute_ranked(corpus, [tuple(r) for r in items.collect()])
    assert any(w[3] for w in want) and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_search_of_empty_tables(docs, items):
    assert ranking.search(docs.where("false"), items).count() == 0
    assert ranking.search(docs, items.where("item_id = 3")).count() == 0
    assert ranking.search(docs, items.where("false")).count() == 0


def test_lists_read_no_further_than_they_must():
    r = np.random.default_rng(3)
    n, terms = 500, 6
    dense = np.where(r.random((terms, n)) < 0.4, r.integers(-50, 1000, (terms, n)), 0)
    term, doc = np.nonzero(dense)
    lists = ranking.Lists(n, term, doc, dense[term, doc], terms)
    ids = r.permutation(n)
    for some in ([0], [1, 4], [0, 1, 2, 3, 4, 5]):
        total = dense[some].sum(0)
        want = sorted((-total[d], ids[d]) for d in range(n) if total[d] > 0)[:10]
        found, scores = lists.best(np.array(some), ids, 10)
        assert [(-s, ids[d]) for d, s in zip(found, scores)] == want
