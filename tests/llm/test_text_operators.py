"""The text operators against brute force on small fixtures, and their edge cases."""

import collections
import gzip
import hashlib
import html as entities
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens.llm import chunks, graph, html, leaks, mixing, pii, ppm, quality, simhash, tokens, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda omicron rho sigma tau upsilon phi chi psi omega the of and to".split()


def prose(seed, n):
    r = random.Random(seed)
    out = [r.choice(WORDS) + (str(r.randrange(40)) if r.random() < 0.4 else "") for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(out)) + "."


@pytest.fixture(scope="module")
def corpus():
    rows = [(i, prose(i, 20 + 7 * i % 90)) for i in range(40)]
    rows += [(40, rows[3][1]), (41, rows[3][1].replace("alpha", "omega", 1)), (42, None), (43, ""), (44, " \n\t"), (45, "one"), (46, "É x " * 4000), (None, "no id " * 3), (3, rows[3][1])]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 4}" if i != 5 else None, None) for i, t in corpus], "doc_id long, text string, source string, id string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (9, 1), (20, 21), (21, 20), (7, 7), (None, 1)] + [(100 + i, 101 + i) for i in range(50)], "x long, y long").repartition(7)
    got = dict(map(tuple, graph.components(links).collect()))
    assert got == {5: 1, 4: 1, 3: 1, 9: 1, 21: 20} | {101 + i: 100 for i in range(50)}


def test_simhash(docs, corpus, empty):
    got = simhash.near_duplicates(docs, shingle=3).collect()
    prints = [(i, simhash.fingerprint(t, 3)) for i, t in corpus]
    assert sorted((r["id"] or -1, r["print"] % 2**64) for r in got) == sorted((i or -1, p) for i, p in prints)
    root = {i: i for i, _ in prints if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, p in prints:
        for j, q in prints:
            if i is not None and j is not None and (p ^ q).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert all(r["component"] == find(r["id"]) for r in got if r["id"] is not None)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.near_duplicates(empty).count() == 0


def test_links_find_all_pairs_within_three_bits(spark):
    r = random.Random(1)
    base = r.getrandbits(64)
    prints = list({base ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for _ in range(80)} | {r.getrandbits(64) for _ in range(80)})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    got = {tuple(x) for x in simhash.links(spark.createDataFrame([(p,) for p in signed], "print long")).collect()}
    assert got == {(a, b) for p, a in zip(prints, signed) for q, b in zip(prints, signed) if a < b and (p ^ q).bit_count() <= 3}


def test_links_broadcast_no_keys(spark):
    """64 keys a print are sized as one row, so a side that looks small may fill the driver."""
    prints = spark.range(100).select(F.xxhash64("id").alias("print")).union(spark.range(100).select(F.xxhash64("id").bitwiseXOR(F.lit(6)).alias("print")))
    found = simhash.links(prints)
    got = {tuple(x) for x in found.collect()}
    values = [r["print"] for r in prints.collect()]
    assert got == {(a, b) for a in values for b in values if a < b and ((a ^ b) % 2**64).bit_count() <= 3} and len(got) >= 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_keep_first_keeps_one_row_of_each_class(spark, docs, corpus, empty):
    prints = [simhash.fingerprint(t, 3) for _, t in corpus]
    classes = list(range(len(corpus)))
    for i, p in enumerate(prints):
        for j, q in enumerate(prints):
            if (p ^ q).bit_count() <= 3:
                classes = [min(classes[i], classes[j]) if c in (classes[i], classes[j]) else c for c in classes]
    want = [min((corpus[i][0] is None, corpus[i][0] or 0) for i in range(len(corpus)) if classes[i] == c) for c in sorted(set(classes))]
    got = simhash.keep_first(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted(want)
    assert got[0].asDict().keys() == set(docs.columns)
    # Rows without an id link others, and one stays where no row of a class has an id.
    rows = [(None, prose(7, 200)), (None, prose(7, 200)), (5, prose(8, 200)), (None, prose(8, 200)), (5, prose(9, 200)), (5, prose(9, 200))]
    left = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(repr(tuple(r)) for r in left) == sorted(map(repr, {rows[0], rows[2], rows[4]}))
    assert simhash.keep_first(empty).count() == 0


def test_quality(spark, empty):
    good = "\n".join(prose(i, 20) for i in range(3))
    rows = [(1, good), (2, "Home | News | About | Contact | Help | Map | Jobs | More | All | End |"), (3, "BUY!! NOW!! CHEAP!! ALL!! OF!! IT!! IS!! HERE!! FOR!! YOU!!"), (4, None), (5, ""),
            (6, good + "\nReleased under the MIT License."), (7, "same " * 60), (8, "a b c d e f g h i j. " + prose(8, 30)), (9, "x y z w v " * 2 + prose(9, 80))]
    df = spark.createDataFrame([(i, t, 7, "q") for i, t in rows], "doc_id long, text string, n_chars long, n_words string")
    got = {r["doc_id"]: r["quality"] for r in quality.assess(df).collect()}
    assert [i for i, q in got.items() if q["kept"]] == [1, 6, 8, 9]
    assert got[6]["clean"] == good and got[4]["n_words"] == 0 and got[7]["n_repeat_words"] == 60 and got[9]["n_repeat_words"] == 10
    out = {r["doc_id"]: r for r in quality.recounted(quality.cleaned(df)).collect()}
    assert set(out) == {1, 6, 8, 9} and out[6]["n_chars"] == len(good) and out[6]["n_words"] == "q"
    assert quality.assess(empty).count() == 0


def test_cleaned_counts_boilerplate_as_loss(spark):
    site = "\n".join(f"{x} {i}." for i in range(8) for x in ("Cookies help us", "Please log in", "Subscribe now to", "Copyright by site"))
    good = "\n".join(prose(i, 20) for i in range(3))
    notice = "By going on you accept the terms of use of this page, its privacy policy and our own cookies, " + " ".join(f"rule{i}" for i in range(24)) + ", all rights reserved."
    rows = [(1, site + "\nOne short line."), (2, site + "\n" + prose(1, 30)), (3, good + "\nPlease log in."), (4, good + "\n" + notice), (5, notice + "\nOne short line of text."),
            (6, "Released in all its many parts and for all of their users under the MIT License.\n" + prose(2, 12)), (7, "Plain words of it.\nBUY NOW !!!!\nfour or more words here"), (8, prose(3, 60) + " It says copyright once.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in quality.cleaned(df).collect()}
    assert set(out) == {3, 4, 6, 8} and out[3] == out[4] == good and out[8] == rows[7][1] and out[6] == prose(2, 12)


def test_quality_verdict_can_be_filtered(docs, spark):
    """A filter on the verdict is not pushed below its steps; thirty lines of boilerplate are no text."""
    judged = quality.assess(docs).select("doc_id", "quality.*")
    rows = judged.collect()
    assert judged.where("kept").count() == sum(r["kept"] for r in rows)
    assert judged.where("not base_failed and n_words > 30").count() == sum(not r["base_failed"] and r["n_words"] > 30 for r in rows)
    site = "\n".join(f"Please log in and accept cookies number {i} of this page." for i in range(30))
    df = spark.createDataFrame([(1, site, "x"), (2, prose(1, 40), "y")], "doc_id long, text string, quality string")
    assert [tuple(r) for r in quality.cleaned(df).collect()] == [(2, prose(1, 40), "y")]


def test_quality_counts_equal_brute_force(docs, corpus):
    for r in quality.assess(docs).collect():
        t = r["text"] or ""
        w, q = re.findall(r"[^\x20\x09-\x0D]+", t), r["quality"]
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = collections.Counter(win)
        inside = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(5)}
        assert (q["n_words"], q["word_chars"], q["n_repeat_words"]) == (len(w), sum(map(len, w)), len(inside))


LABELLED = "<html><head><title>t x</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu one</a></li></ul></nav><div class=ad>Buy &amp; save</div><article><h1>Title</h1><p>Some <b>bold</b>er  text\n here &amp; there<p>Second&nbsp;one of words</article><section class='comments'><p>Nice page, I liked the words here</p></section><footer>(c) me</footer></body></html>"


def test_html(spark):
    rows = [(i, "u", LABELLED) for i in range(30)] + [(100, None, None), (101, "u", ""), (102, "u", "plain words only"), (103, "u", "<p>unclosed <b>tag"), (104, "u", "<" * 50)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = {r["id"]: r["text"] for r in html.extracted(df).collect()}
    assert got[0] == "Title\nSome bolder text here & there\nSecond one of words"
    assert got[100] == got[101] == "" and got[102] == "plain words only" and got[103] == "unclosed tag"
    assert html.extracted(df.limit(0)).count() == 0
    model = html.fit(df)
    assert all((w > 0) == (f[0] == "w") for f, w in model.items())


def test_region_is_the_best_of_all_runs():
    model = {"w p": 1.0, "t p": -2.5}
    r = random.Random(3)
    for _ in range(60):
        found = [r.choice([("open", "p", "", False), ("text", "p", "a b", False), ("text", "p", "a", False)]) for _ in range(12)]
        score = [-2.5 if k == "open" else len(t.split()) for k, _, t, _ in found]
        best = max([0.0] + [sum(score[a:b]) for a in range(12) for b in range(a + 1, 13)])
        a, b = html.region(found, model)
        assert math.isclose(sum(score[a:b]), best)


def test_leaks(spark, empty):
    items = [(i, prose(1000 + i, 24 + i)) for i in range(12)]
    bench = spark.createDataFrame(items + [(90, None), (91, "...")], "item_id long, text string")
    text = {i: prose(i, 150) for i in range(40)}
    for i in range(12):
        w = text[i].split()
        text[i] = " ".join(w[: 11 * i % 150] + items[i][1].upper().split() + w[11 * i % 150 :])
    rows = [*text.items(), (50, None), (51, ""), (None, items[2][1])]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, item int").repartition(3)
    got = {(r["id"], r["item"]) for r in leaks.leaks(df, bench).collect()}
    want = set()
    for i, t in rows:  # brute force: every item against every window
        w = leaks.words(t)
        for k, x in items:
            it = leaks.item(k, x)
            best = max((leaks.verdict(it, w[a : a + len(it.words) + 16]) for a in range(0, max(1, len(w)), 8)), default=(0, 0))
            if best[0] >= leaks.COVERED:
                want.add((i, k))
    assert want == {(i, i) for i in range(12)} | {(None, 2)} and want <= got and len(got - want) == 0
    assert leaks.leaks(empty, bench).count() == 0 and leaks.leaks(df, bench.limit(0)).count() == 0
    assert {r["doc_id"] for r in leaks.decontaminated(df, bench).collect()} == set(range(12, 40)) | {50, 51}


def test_latent_space_is_fitted_on_all_passages(spark, monkeypatch):
    bench = [(i, prose(900 + i, 30)) for i in range(4)]
    df = spark.createDataFrame([(i, prose(i, 20 + i % 40)) for i in range(4500)] + [(None, None), (9, "")], "doc_id long, text string").repartition(3)
    seen = []

    def fit(docs, items, idf, seed=42):
        vectors = latent(docs, items, idf, seed)
        seen.append((docs.count(), idf, leaks.product(docs, idf, np.eye(len(idf)))))
        return vectors

    latent = leaks.latent
    monkeypatch.setattr(leaks, "latent", fit)
    leaks.leaks(df, spark.createDataFrame(bench, "item_id long, text string")).count()
    (n, idf, (found, mass)), = seen
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, t in bench for w in leaks.words(t)}))}
    cells, want, weight = 0, np.zeros((len(idf), len(idf))), 0.0
    df_of = np.zeros(len(idf))
    for r in df.collect():
        w = leaks.words(r["text"])
        cut = np.zeros((-(-len(w) // leaks.CELL), len(idf)))
        for i, x in enumerate(w):
            if x in vocabulary:
                cut[i // leaks.CELL, vocabulary[x]] += 1
        cells += len(cut)
        df_of += (cut > 0).sum(0)
        weight += float((cut * idf**2).sum())
        both = cut.copy()
        both[:-1] += cut[1:]
        want += both.T @ both
    assert n == 4502 and np.allclose(idf, np.log((1 + cells) / (1 + df_of)) + 0.05)
    assert math.isclose(mass, weight) and np.allclose(found, idf[:, None] * want * idf, rtol=1e-4)


def test_common_subsequence():
    r = random.Random(5)
    for _ in range(100):
        a, b = [r.randrange(4) for _ in range(r.randrange(12))], [r.randrange(4) for _ in range(r.randrange(12))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert leaks.common(a, b) == t[-1][-1]


def test_mixing(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 40)
    r = random.Random(2)
    rows = [(i, "w " * r.randrange(200), f"s{i % 5 if i % 3 else 0}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.copies(df).collect()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    weight, aim, open_ = dict(zip(sorted(size), (5, 2, 1, 5, 2))), {}, set(size)
    while open_:
        rate = (1.5 * sum(size.values()) - sum(aim.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if rate * weight[s] > 2 * size[s]}
        if not over:
            aim |= {s: rate * weight[s] for s in open_}
            break
        aim |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    taken = collections.Counter()
    for x in got:
        assert math.isclose(x["target"], aim[x["source"]]) and 0 <= x["times"] <= 2
        taken[x["source"]] += x["size"] * x["times"]
    assert len(got) == 900 and all(abs(taken[s] - aim[s]) <= 0.02 * aim[s] + 2 for s in size)
    assert sorted((x["id"], x["times"]) for x in got) == sorted((x["id"], x["times"]) for x in mixing.copies(df.repartition(2)).collect())
    assert mixing.copies(docs).count() == docs.count() and mixing.copies(empty).count() == 0
    assert {"times"} == set(mixing.mixed(df).columns) - set(df.columns)


def test_pii(spark, empty):
    rows = [(1, "Write to a.b@mail.example.com, call +1 (523) 555-1055 or é 10.0.0.255 and 4111 1111 1111 1111."), (2, None), (3, ""), (4, "300.1.1.1 1.2.3.4.5 a@b@c.d +12 4111111111111112"), (5, "9" * 3000 + " x@y." + "a.b" * 500)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kind int")
    got = {r["doc_id"]: r for r in pii.spans(df, pii.Model([], {})).select("doc_id", pii.listed(pii.F.col("base")).alias("b")).collect()}
    assert got[1]["b"] == "email:9:29,phone:36:53,ip:59:69,card:74:93" and got[2]["b"] == got[3]["b"] == ""
    assert got[4]["b"] == "ip:10:17,email:22:27" or got[4]["b"] == "ip:10:17,email:20:23,email:22:27" or "ip:10:17" in got[4]["b"]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}
    for i, t in rows:
        for kind, p in patterns.items():
            want = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if kind == "email" or all(int(x) < 256 for x in m[0].split("."))]
            assert [x for x in got[i]["b"].split(",") if x.startswith(kind)] == want
    assert pii.redacted(df, pii.Model([], {})).where("doc_id = 1").first()["text"] == "Write to [EMAIL], call [PHONE] or é [IP] and [CARD]."
    assert pii.spans(empty, pii.fit(empty)).count() == 0


def test_pii_model_adds_what_looks_alike(spark):
    r = random.Random(4)

    def card():
        d = "4" + "".join(str(r.randrange(10)) for _ in range(14))
        return next(d + str(c) for c in range(10) if sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d + str(c)))) % 10 == 0)

    rows = [(i, f"pay with {card()} please" if i % 2 else f'set token = "{r.getrandbits(128):032x}" now') for i in range(300)] + [(900, "pay with 4111111111111112 please")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["s"] for x in pii.spans(df, pii.fit(df)).select("doc_id", pii.listed(pii.F.col("spans")).alias("s")).collect()}
    assert "number:9:25" in got[900] and "secret:" in got[0]


def _loose_case(r, kind):
    """Forms written here apart from those that the trees are fitted on: (text, span looked for)."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randrange(2, 4)))
    if kind == "contact":
        x = r.choice(["{}.{} [at] {} [dot] org", "{}{}(at){}(dot)net", "{}_{} (at) {}.de", "{}{} at {} dot com"]).format(word(), word(), word())
    elif kind == "number":
        x = r.choice([f"({r.randrange(201, 990)}) 555-{d(4)}", f"{r.randrange(201, 990)}-555-{d(4)}", f"{r.randrange(201, 990)}.555.{d(4)}", f"040 {r.randrange(2, 10)}{d(7)}"])
        x = x.lstrip("(")
    elif kind == "secret":
        x = r.choice(["password: ", "pwd=", "passwd = "]) + r.choice([word()[:4] + d(4), (word() + word())[:6].capitalize() + d(2), d(2) + word() + "X" + d(2)])
    else:
        x = r.choice([":".join(f"{r.getrandbits(16):04x}" for _ in range(8)), f"2001:db8:{r.getrandbits(16):x}::{r.getrandbits(15) + 1:x}:{r.getrandbits(8):x}"])
    return x


def test_pii_recall_of_loose_kinds(spark):
    r = random.Random(11)
    rows, want = [], {}
    kinds = ["contact", "number", "secret", "host"]
    for i in range(800):
        kind = kinds[i % 4]
        case = _loose_case(r, kind)
        front = prose(i, 12 + i % 20) + (" (" if kind == "number" and ")" in case else " ")
        rows.append((i, front + case + r.choice([" ", ", ", ". "]) + prose(i + 5000, 15)))
        want[i] = (kind, len(front), len(front) + len(case))
    clean = ["on 2021-03-14 and 2020-11-02", "between 1998-2004 and", "order 48213377 shipped", "at 12:30:45:10 the", "password: required here", "token = response.body then", "isbn 978-3-16-148410-0 is",
             "polka at a dot on", "release 1.20.300.4500 of", "some 3 450 000 people", "id 9038471625534 stored", "ratio 1:2:3:4 for"]
    rows += [(10_000 + i, f"{prose(i, 9)} {clean[i % len(clean)]} {prose(i + 700, 9)}") for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["s"] for x in pii.spans(df, pii.fit(df)).select("doc_id", pii.listed(pii.F.col("spans")).alias("s")).collect()}
    found = dict.fromkeys(kinds, 0)
    for i, (kind, start, end) in want.items():
        spans = [(int(a), int(b)) for _, a, b in (x.split(":") for x in got[i].split(",") if x)]
        found[kind] += any(2 * (min(end, b) - max(start, a)) > end - start for a, b in spans)
    assert all(n >= 0.9 * 200 for n in found.values()), found
    wrong = [t for i, t in rows if i >= 10_000 and got[i]]
    assert len(wrong) <= 0.1 * 240, sorted({clean[(i - 10_000) % len(clean)] for i, _ in rows if i >= 10_000 and got[i]})


def test_pii_fit_of_few_and_empty_texts(spark):
    few = spark.createDataFrame([(1, None), (None, ""), (3, "one text, password: kilo4711 and no more")], "doc_id long, text string")
    model = pii.fit(few)
    assert set(model.thresholds) == set(pii.LOOSE)
    got = [r["s"] for r in pii.spans(few, model).orderBy("doc_id").select(pii.listed(pii.F.col("spans")).alias("s")).collect()]
    assert got == ["", "", "secret:10:28"]


def test_pii_card_and_phone_spans(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("0123456789 -+().x") for _ in range(r.randrange(10, 160))) for _ in range(300)]
    texts += [" ".join("4111111111111111 5500 0000 0000 0004 378282246310005 +44 20 7946 0958 +1(212)555-0100".split(" ")[k:]) for k in range(8)]

    def luhn(d):
        return sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0

    checks = {"card": (r"[0-9]([\x20-]?[0-9])+", lambda d: 14 <= len(d) <= 19 and luhn(d)), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda d: 10 <= len(d) <= 15)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["b"] for x in pii.spans(df, pii.Model([], {})).select("doc_id", pii.listed(pii.F.col("base")).alias("b")).collect()}
    for i, t in enumerate(texts):
        for kind, (p, ok) in checks.items():
            want = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if ok(re.sub("[^0-9]", "", m[0]))]
            assert [x for x in got[i].split(",") if x.startswith(kind)] == want


def test_warc(spark, tmp_path):
    big = "<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 120
    rows = [(5, "http://a", big), (2, "http://b\r\nX: 1", big), (9, None, big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (2, "u", big), (None, "u", big)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    got = sorted((r["id"] if r["id"] is not None else -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.deduplicated(df, f"file://{tmp_path}/w").collect())
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        again = len(raw) >= 100 and i != 2
        want.append((i if i is not None else -1, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want)
    for f in (tmp_path / "w").glob("*.gz"):
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n")
    assert warc.deduplicated(df.limit(0)).count() == 0


def test_token_counts(spark, docs, corpus, empty):
    enc = tokens.encoder(tokens.TOKENIZERS)
    want = sorted((i if i is not None else -1, len(enc.encode_ordinary(t or ""))) for i, t in corpus)
    for size in (16, 1 << 18):
        got = sorted((r["id"] if r["id"] is not None else -1, r["n_tokens"]) for r in tokens.document_tokens(docs, block_tokens=size).collect())
        assert got == want
    assert tokens.document_tokens(empty).count() == 0


def test_separator_scan(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(tokens, "SUPER", 3)
    r = random.Random(6)
    rows, want = [], []
    for file in range(6):
        ids = [0 if r.random() < 0.03 * file else 5 for _ in range(400)]
        lengths = [len(x) for x in "".join("s" if i == 0 else "t" for i in ids).split("s")]
        want += [(file, k, n) for k, n in enumerate(lengths) if k + 1 < len(lengths) or n]
        rows += [(file, b, bytearray(np.array(ids[b * 7 : b * 7 + 7], "<u2").tobytes())) for b in range(-(-400 // 7))]
    got = tokens.lengths(spark.createDataFrame(rows, "file long, block long, tokens binary").repartition(5), separator=0)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_ppm(spark, docs, corpus, empty):
    order = ppm.ORDER
    rows = [(i, (t or "")[:400]) for i, t in corpus] + [(2000, "ж\x00 q")]
    count = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    stream = lambda t: b"\xff" * order + t.encode() + b"\xff"
    words = collections.Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            s = stream(t)
            words.update(s_ for s_ in t.encode().lower().split())
            words["end"] += 1
            for j in range(order, len(s)):
                for k in range(order + 1):
                    count[k][s[j - k : j]][s[j]] += 1
    n_all = sum(words.values())

    def score(t):
        s, total = stream(t), 0.0
        for j in range(order, len(s)):
            gone: set = set()
            for k in range(order, -1, -1):
                seen = {a: n for a, n in count[k][s[j - k : j]].items() if a not in gone}
                every = sum(seen.values()) + len(seen)
                if s[j] in seen:
                    total += math.log10(seen[s[j]] / every)
                    break
                total += math.log10(len(seen) / every) if every else 0
                gone |= set(count[k][s[j - k : j]])
            else:
                total -= math.log10(256 - len(gone))
        return total

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ppm.scored(df, chunk_bytes=3000).collect()
    text = {i: t for i, t in rows}
    assert len(got) == len(rows) and all(r["train_tokens"] == n_all for r in got)
    for r in got:
        toks = [*text[r["id"]].encode().lower().split(), "end"]
        base = sum(math.log10((words[w] + 0.1) / (n_all + 0.1 * (len(words) + 1))) for w in toks)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score(text[r["id"]]), rel_tol=1e-9, abs_tol=1e-9)
        assert (r["n_tokens"], r["n_known"]) == (len(toks), sum(words[w] > 0 for w in toks))
    assert ppm.scored(empty).count() == 0


def test_code_lengths_sum_to_one():
    import numpy as np

    gram, n = ppm._counts(["abracadabra", "abc bca", "cab"])
    low = np.zeros((256, 256), np.int64)
    np.add.at(low, (gram >> 8 & 255, gram & 255), n)
    for ctx in {int(g) >> 8 for g in gram}:
        same = (gram & 0xFFFFFF00) == (ctx << 8 & 0xFFFFFF00)
        near = gram[(gram >> 8 & 65535) == (ctx & 65535)]
        every = np.concatenate([near, np.setdiff1d(ctx << 8 | np.arange(256), near)])
        counts = np.concatenate([n[(gram >> 8 & 65535) == (ctx & 65535)], np.zeros(len(every) - len(near), np.int64)])
        logp = ppm.code_lengths(every, counts, low)
        assert same.any() and math.isclose((10.0 ** logp[(every >> 8) == ctx]).sum(), 1.0, rel_tol=1e-9)


def test_chunks(spark, empty):
    shared = prose(77, 60)
    rows = [(i, prose(i, 120)) for i in range(20)]
    rows[4] = (4, prose(4, 50) + " " + shared + " " + prose(104, 40))
    rows[9] = (9, "An insertion. " + prose(9, 30) + "\n" + shared + prose(109, 5))
    rows += [(30, None), (31, ""), (32, rows[2][1]), (33, "short one"), (34, "short one"), (None, rows[7][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, first int").repartition(3)
    got = {r["id"]: r for r in chunks.repeated_passages(df).collect()}
    assert {i for i, r in got.items() if r["n_passages"]} == {2, 32, 4, 9, 7, None}
    assert got[9]["first_id"] == got[4]["first_id"] == 4 and got[32]["first_id"] == 2 and got[30]["n_chunks"] == got[31]["n_chunks"] == 0
    assert all(r["n_words"] == len((dict(rows)[i] or "").split()) for i, r in got.items())
    assert chunks.repeated_passages(empty).count() == 0


def test_cuts_resist_insertions():
    import numpy as np

    def pieces(raw):
        at = (np.flatnonzero(chunks.gear(np.frombuffer(b"\xff" * 16 + raw, np.uint8)) < 2**32 // chunks.MEAN_MORE) + 1 - 16)
        ends = chunks.cuts(0, len(raw), [int(x) for x in at if 0 < x < len(raw)])
        assert ends[-1] == len(raw) and all(b - a <= chunks.MOST for a, b in zip([0, *ends], ends))
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    text = prose(5, 900).encode()
    a, b = pieces(text), pieces(text[:2000] + b"something new" + text[2000:])
    assert len(set(a) - set(b)) <= 6


def test_html_text_is_unescaped_once():
    assert html.main_text("<article><p>a &amp;lt; b</p></article>", {}) == entities.unescape("a &amp;lt; b")


@pytest.mark.parametrize("page,want", [
    ("<article><p>first words here</p><svg-icon></svg-icon><p>second words here</p><object-viewer>third words here</object-viewer></article>", "first words here\nsecond words here\nthird words here"),
    ("<body><div class='content with-sidebar'><p>all of the text stays</p><div class=sidebar><p>other links</p></div></div>", "all of the text stays"),
    ("<body class='page no-sidebar'><div class='page no-sidebar'><p>all of the text stays</p></div>", "all of the text stays"),
    ("<article><p>a sentence with <a class='social-link' href=x>one inline link</a> goes on</p></article>", "a sentence with one inline link goes on"),
    ("<article><p>one two three four</p><div class='ad-box'>buy this</div><ul class='comment-list'><li>I like it</li></ul><div id='site-footer'>us</div><p>five six seven</p></article>", "one two three four\nfive six seven"),
    ("<div class='search'><p>all words lie in a named element</p></div>", "all words lie in a named element"),
    ("<div><p>x y z</p><svg><text>drawn</text></svg><svg", "x y z"),
    ("<nav>only a menu</nav>", ""),
])
def test_html_names_and_custom_elements(page, want):
    assert html.main_text(page, dict.fromkeys(("t div", "t p", "t article", "t other", "t a", "t ul", "t li"), -0.1)) == want


def test_deduplicated_texts_equal_brute_force(spark):
    rng = random.Random(11)

    def words(n):
        return " ".join("".join(rng.choices("abcdefghéß達", k=rng.randint(2, 9))) for _ in range(n))

    shared, other, short = words(90), words(120), words(6)
    texts = [(3, words(40) + " " + shared), (1, words(70) + " " + shared + " " + words(30)), (None, shared + " " + words(20)), (None, words(60)),
             (7, words(30) + " " + other + " " + words(25) + " " + other), (5, words(50) + " " + short), (6, short + " " + words(50)), (8, ""), (9, None), (4, words(80)), (4, shared)]
    df = spark.createDataFrame([(*t, 0, 0) for t in texts], "doc_id long, text string, row int, removed int").repartition(3)
    found = chunks.deduplicated(df).collect()
    assert sorted(str(r["id"]) for r in found) == sorted(str(i) for i, _ in texts)
    # chunks of each text by the cutting rule alone, first holders by id, runs of later copies
    cut = {}
    for i, (_, t) in enumerate(texts):
        one = spark.createDataFrame([(0, t)], "doc_id long, text string")
        cut[i] = [(r["bytes"], r["words"], r["hi"], r["lo"]) for r in sorted(chunks.chunks(one).collect(), key=lambda r: r["seq"]) if r["bytes"]]
    order = {i: (texts[i][0] is None, texts[i][0] or 0, 0) for i in cut}
    by_text = {}
    for r in found:
        by_text.setdefault(r["id"], []).append(r)
    for i, (key, t) in enumerate(texts):
        if key in (None, 4):
            continue  # which of two rows with one id is first is not said
        firsts = {}
        for j in cut:
            for q, c in enumerate(cut[j]):
                firsts[c[2:]] = min(firsts.get(c[2:], (order[j], j, q)), (order[j], j, q))
        at, run, spans = 0, [], []
        for q, (size, n, *digest) in enumerate([*cut[i], (0, 0, None, None)]):
            later = digest[0] is not None and firsts[tuple(digest)] != (order[i], i, q)
            if later:
                run.append((at, size, n))
            elif run:
                if sum(n for *_, n in run) >= 25:
                    spans.append((run[0][0], run[-1][0] + run[-1][1]))
                run = []
            at += size
        (row,) = by_text[key]
        want, gone = chunks._without(t, spans) if t else (t, [])
        assert row["text"] == want and [(r["start"], r["end"]) for r in row["removed"]] == gone, key
    for r in found:
        t = dict(texts)[r["id"]] if r["id"] not in (None, 4) else None
        if t:
            pieces, at = [], 0
            for a, b in r["removed"]:
                pieces.append(t[at:a])
                at = b
            assert "".join([*pieces, t[at:]]) == r["text"]
    one = {r["id"]: r for r in found}
    assert one[1]["removed"] == [] and one[5]["removed"] == [] and one[6]["removed"] == []
    assert len(one[3]["removed"]) == 1 and len(one[3]["text"]) < 0.6 * len(texts[0][1])
    assert len(one[7]["removed"]) == 1 and one[8]["text"] == "" and one[9]["text"] is None
    assert sum(shared in (r["text"] or "") for r in found) == 1
    assert chunks.deduplicated(df.limit(0)).count() == 0
    # the spans of the query are those, and the texts of both agree
    spans = {r["id"]: [tuple(x) for x in r["removed"]] for r in chunks.repeated_passages(df).collect() if r["id"] not in (None, 4)}
    assert spans == {i: [tuple(x) for x in by_text[i][0]["removed"]] for i in spans} and spans[7] and spans[3]


@pytest.mark.parametrize("copies", [60, 120])
def test_a_group_of_copies_gives_a_row_for_each_chunk(spark, copies):
    text = prose(3, 100)
    df = spark.createDataFrame([(i, text) for i in range(copies)], "doc_id long, text string").repartition(4)
    all_ = chunks.chunks(df).where("bytes > 0").cache()
    size = all_.count()
    assert size % copies == 0 and size // copies > 5
    found = chunks._repeats(all_).collect()
    assert len(found) == len({(r["uid"], r["seq"]) for r in found}) == size  # not their pairs
    assert {r["first"] for r in found} == {0} and sum(not r["later"] for r in found) == size // copies


def test_frequent_and_rare_chunks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chunks, "HOT", 10)  # so that a small table has chunks of both kinds
    copied, passage, alone = prose(5, 40), prose(6, 40), prose(8, 60)
    rows = [(i, copied) for i in range(40)] + [(100 + i, prose(100 + i, 60) + (" " + passage) * (i % 3)) for i in range(30)]
    df = spark.createDataFrame([*rows, (None, copied), (None, rows[45][1]), (7, rows[50][1]), (8, f"{alone} {alone}")], "doc_id long, text string").repartition(3)
    all_ = chunks.chunks(df).where("bytes > 0").cache()
    held, groups = all_.collect(), {}
    hot = set(all_.stat.freqItems(["hi"], 1 / chunks.HOT).first()[0])
    assert {r["hi"] in hot for r in held} == {True, False}
    for r in sorted(held, key=lambda r: (r["id"] is None, r["id"], r["uid"], r["seq"])):
        groups.setdefault((r["hi"], r["lo"]), []).append(r)
    want = sorted((r["uid"], r["seq"], -1 if g[0]["id"] is None else g[0]["id"], len({x["uid"] for x in g}) > 1, r is not g[0]) for g in groups.values() for r in g if len({x["uid"] for x in g}) > 1 or r is not g[0])
    got = sorted((r["uid"], r["seq"], -1 if r["first"] is None else r["first"], r["other"], r["later"]) for r in chunks._repeats(all_).collect())
    assert got == want and len(got) < len(held) and any(later and not other for *_, other, later in got)


def test_frequent_and_rare_chunks_are_dealt_out_apart_and_once(spark, monkeypatch):
    monkeypatch.setattr(chunks, "HOT", 10)
    rows = [*[(1, "x")] * 3, (None, prose(2, 60)), (None, prose(2, 60)), (7, prose(3, 60)), (7, prose(3, 60)), (8, None), (9, ""), *[(20 + i, prose(5, 40)) for i in range(30)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = chunks._repeats(chunks.chunks(df).where("bytes > 0"))
    per_row = found.groupBy("uid").agg(F.count("*").alias("n"), F.count_if("later").alias("later"))
    plan = per_row._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("Union")
    assert "Exchange" not in above and below.count("Exchange hashpartitioning(uid") == 2  # each part's own, no other for readers
    got = sorted((r["n"], r["later"]) for r in per_row.collect())
    n, same, copied = (chunks.chunks(df.where(w).limit(1)).where("bytes > 0").count() for w in ("doc_id is null", "doc_id = 7", "doc_id = 20"))
    assert got == sorted([(1, 0), (1, 1), (1, 1), (n, 0), (n, n), (same, 0), (same, same), (copied, 0), *[(copied, copied)] * 29])
    every = {r["id"]: r["n_shared"] for r in chunks.repeated_passages(df).collect()}
    assert every == {1: 1, None: n, 7: same, 8: 0, 9: 0, **{20 + i: copied for i in range(30)}}
