"""Personal data: strict patterns that always count, and spans that boosted trees pick among loose candidates.

Generators of high recall propose spans, which may overlap. Boosted trees score their format and context, and of each
kind those above its calibrated threshold are added. The trees are fitted by Spark ML on a bounded number of made-up
cases and look-alikes put into sampled texts, so their labels owe nothing to the strict patterns. They are applied as
column expressions inside each row, so documents are neither shuffled nor handed to Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import staged

PLANTS = 8000  # cases and look-alikes that the trees are fitted on, about
HOST = 150  # characters of a sampled text on each side of a case
CONTEXT = 40  # characters before a span that count as its context
PRECISION = 0.95  # wanted of a kind's spans on the cases kept for calibration
TREES, DEPTH = 12, 4

# Starts are tied to the start of a run (or the end of the last match), which changes no match but keeps long runs linear.
BASE: dict[str, str] = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE: dict[str, str] = {
    "secret": r"(?i)(?<![a-z])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)[\"']?\x20?[:=]\x20?[\"']?[a-z0-9_/+=.!@#$%^&*~-]{6,}+[\"']?",
    "number": r"(?<![0-9A-Za-z.])[0-9](?:[\x20.()-]{0,2}[0-9]){6,}+",
    "contact": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[(\[](?:at|AT)[)\]]\x20?|\x20(?:at|AT)\x20(?=[A-Za-z0-9-]++\x20(?:dot|DOT)\x20[A-Za-z]))"
               r"[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]++)*+",
    "host": r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}(?:[.:]{1,2}[0-9A-Fa-f]{1,4}){3,7}+",
}
KINDS = [*BASE, *LOOSE]
FEATURES = ["kind", "length", "digits", "letters", "marks", "runs", "before", "after", "word_before", "keyword",
            "longest", "colons", "dots", "mixed", "checked", "ending", "dated"]
_CALLS = r"(?i)\b(mail|e-mail|phone|tel|telephone|call|calling|dial|fax|mobile|cell|ring|text|ssn)\b[^.!?]{0,12}$"
_PAYS = r"(?i)\b(pay|paid|card|visa|mastercard|amex|credit|debit|charge|charged)\b[^.!?]{0,12}$"
_ENDING = r"(?i)\b(com|org|net|edu|gov|info|io|eu|de|fr|uk|es|it|nl|at|ch)$"
_DATED = r"^((19|20)[0-9]{2}[-. ]+([01]?[0-9][-. ]+[0-3]?[0-9]([^0-9]|$)|(19|20)[0-9]{2}$)|[0-3]?[0-9][-. ]+[01]?[0-9][-. ]+(19|20)[0-9]{2}$)|^97[89]"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return s + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    if kind == "ip":
        part = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return lambda m: m.rlike(rf"^{part}(\.{part}){{3}}$")
    if kind == "card":
        return lambda m: F.when(F.length(_digits(m)).between(14, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return lambda m: F.length(_digits(m)).between(10, 15)
    return lambda m: F.lit(True)


_SPAN = "array<struct<start:int,kind:int,end:int,found:string>>"


def find(text: Column, kind: str) -> Column:
    """Spans of a kind's leftmost matches that do not overlap, failing ones dropped: what lies between them gives places."""
    pattern, valid, number = (BASE | LOOSE)[kind], _valid(kind), KINDS.index(kind)
    none = F.array().cast(_SPAN)
    pairs = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.coalesce(F.length(p["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), p["hit"].alias("found"))
        good = F.coalesce(p["hit"].isNotNull() & valid(p["hit"]), F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span).cast(_SPAN))).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    needs = {"email": text.contains("@"), "phone": text.contains("+"), "contact": text.rlike(r"@|[(\[](at|AT)[)\]]|\x20(at|AT)\x20[A-Za-z0-9-]+\x20(dot|DOT)\x20"), "secret": text.rlike("[:=]")}
    return F.when(needs.get(kind, text.rlike("[0-9]")) & text.rlike(pattern), spans).otherwise(none)


def features(text: Column, s: Column) -> list[Column]:
    m = s["found"]
    before = F.substring(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))
    last, nxt = F.right(before, F.lit(1)), F.substring(text, s["end"] + 1, F.lit(1))

    def sort_of(c: Column) -> Column:
        return F.when(c.rlike(r"[\x20\x09-\x0D]"), 1).when(c.rlike("[A-Za-z]"), 2).when(c.rlike("[0-9]"), 3).when(c == "", 0).otherwise(4)

    value = F.regexp_extract(m, r"[:=][\x20\"']*([^\"']+)", 1)
    mixed = (s["kind"] == KINDS.index("secret")) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    longest = F.array_max(F.transform(F.split(m, "[^0-9]+"), F.length))
    return [
        s["kind"], F.length(m), F.length(_digits(m)), F.length(F.regexp_replace(m, "[^A-Za-z]", "")), F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")),
        F.regexp_count(m, F.lit("[0-9]+")), sort_of(last), sort_of(nxt), F.length(F.regexp_extract(before, r"([A-Za-z]+)[^A-Za-z]*$", 1)), F.when(before.rlike(_CALLS), 1).when(before.rlike(_PAYS), 2).otherwise(0),
        longest, F.length(F.regexp_replace(m, "[^:]", "")), F.length(F.regexp_replace(m, "[^.]", "")), mixed.cast("int"),
        F.when(F.length(_digits(m)).between(14, 19), luhn(_digits(m))).otherwise(False).cast("int"), m.rlike(_ENDING).cast("int"), m.rlike(_DATED).cast("int"),
    ]


def _candidates(text: Column) -> Column:
    return F.concat(*[find(text, k) for k in LOOSE])


def _featured(text: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["found"].alias("found"),
                                                 F.array(*[f.cast("double") for f in features(text, s)]).alias("f")))


def _tree(node, x: Column) -> Column:
    """A fitted tree as nested conditions on the array x."""
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.get(x, F.lit(split.featureIndex())) <= float(split.threshold()), _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))


class Model:
    """Boosted trees over ``FEATURES`` and a threshold on their margin for each kind (none: nothing is added)."""

    def __init__(self, trees: list[tuple[float, object]], thresholds: dict[str, float]) -> None:
        self.trees, self.thresholds = trees, thresholds

    def margin(self, x: Column) -> Column:
        total = F.lit(0.0)
        for weight, root in self.trees:
            total = total + F.lit(weight) * _tree(root, x)
        return total

    def keeps(self, s: Column) -> Column:
        least = F.lit(None).cast("double")
        for kind, margin in self.thresholds.items():
            least = F.when(s["kind"] == KINDS.index(kind), F.lit(float(margin))).otherwise(least)
        return F.coalesce(self.margin(s["f"]) >= least, F.lit(False))


# What may stand in front of a case, and forms of cases and look-alikes. In forms 0 is any digit, 9 any but zero, H a digit
# of base 16, X a letter, Y a letter or nothing, U a capital and Z the end of a site's name; all else stands as it is.
_LEADS = {
    "bare": "|||at |see |under |number |is ",
    "calls": "call |phone: |Tel. |my mobile is |fax |dial |phone |Telephone: ",
    "any": "|||at |call |see |phone: |under |Tel. |is |my mobile is |dial ",
    "pays": "pay with |card: |my visa |credit card |charged to |paid by card ",
    "put": "password: |password = |Password=|passwd: |pwd=|secret: |token = |token = \"|api_key=|api-key: |access_key: '",
}
_ENDS = ["com", "org", "net", "de", "fr", "io", "edu", "info", "it", "nl"]
_TRUE = {
    "any": ["XXXYYYY.XXYYY[at]XXXXYYY[dot]Z", "XXXYYY_XXX (at) XXXXYYYY (dot) Z", "XXXXYYYY(at)XXXX-XXXY.Z", "XXXXYYY at XXXYYYYYY dot Z", "XXX.XXXYY [AT] XXXXYYY [DOT] Z", "XXXXYYYY00(at)XXXYYYY(dot)Z",
            "(900) 900-0000", "900-900-0000", "900.900.0000", "(030) 9000-0000", "030 90000000", "01 90 00 00 00", "0171 9000000", "0900-900000",
            "HHHH:HHHH:HHHH:HHHH:HHHH:HHHH:HHHH:HHHH", "2001:db8:HHHH:HHH::HHHH:HH", "2a02:HHHH:HH::HHHH:HHHH:HHH", "fd00:HHHH:HHHH::HHH:HH", "2001:db8:HHHH::HHHH:HH"],
    "calls": ["9000000000", "01700000000", "900-0000", "900 0000"],
    "pays": ["9000000000000000", "9000 0000 0000 0000"],
    "put": ["XXXXYYY90", "XXYYY90XXYY", "UXXXXY000!", "XXXX_90_XX", "00XXXXU00", "HHHHHHH9", "HHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHH", "HHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHH", "UUUUUUUU900000UUUU"],
}
_FALSE = {
    "any": ["XXXXYYY at XXXYYYYY dot XXXXYY", "XXXXYYY at X dot XX", "1900-01-20", "2000-12-01 10", "2010.11.20", "1990-1999", "1900-2000", "03.11.2000", "12.10.1990", "3-12-2000", "978-9-00-000000-0",
            "1.90.900.9000", "90:90:90:90", "9:9:9:9", "9.9.9.9.9", "9.90.9000.9"],
    "bare": ["XXXYYY@XXXYYY", "9@90", "XXYYY[at]XXYYYY", "9000000", "90000000", "900000000", "9000000000", "900000000000", "9000000000000", "9000000000000000", "9.00000000", "9 000 000", "90 000 000", "900.000.000"],
    "put": ["required", "optional", "undefined", "incorrect", "protected", "XXXXXXYYYY", "XXXYYY.XXXXYYYY", "XXXYYY_XXXXYYY", "os.environ.XXXYY"],
}


def _forms(docs: DataFrame) -> tuple[DataFrame, dict[float, int]]:
    """The forms above, one a row (some 80): label, number, leads, form; and how many each label has."""
    rows, sizes = [], {}
    for label, forms in ((1.0, _TRUE), (0.0, _FALSE)):
        flat = [(lead, form) for lead, held in forms.items() for form in held]
        sizes[label] = len(flat)
        rows += [F.struct(F.lit(label).alias("label"), F.lit(i).alias("number"), F.lit(_LEADS[lead]).alias("leads"), F.lit(form).alias("form")) for i, (lead, form) in enumerate(flat)]
    return docs.sparkSession.range(1).select(F.inline(F.array(*rows))), sizes


def _filled(form: Column, h: Column) -> Column:
    """A form with each placeholder drawn from the hash h and its place."""
    def one(c: Column, i: Column) -> Column:
        draw = F.xxhash64(h, i)
        letter = F.substring(F.lit("abdegiklmnoprstucfhvwz"), F.pmod(draw, F.lit(22)).cast("int") + 1, F.lit(1))
        return (F.when(c == "0", F.pmod(draw, F.lit(10)).cast("string")).when(c == "9", (1 + F.pmod(draw, F.lit(9))).cast("string"))
                .when(c == "H", F.substring(F.lit("0123456789abcdef"), F.pmod(draw, F.lit(16)).cast("int") + 1, F.lit(1)))
                .when(c == "X", letter).when(c == "U", F.upper(letter)).when(c == "Y", F.when(F.pmod(F.xxhash64(draw), F.lit(2)) == 0, letter).otherwise(""))
                .when(c == "Z", F.get(F.array(*[F.lit(e) for e in _ENDS]), F.pmod(draw, F.lit(len(_ENDS))).cast("int"))).otherwise(c))

    return F.array_join(F.transform(F.split(form, ""), one), "")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plants: int = PLANTS, seed: int = 42) -> DataFrame:
    """About ``plants`` made-up cases in parts of sampled texts: h, text, start, end, label.

    Texts are sampled by hash; where there are fewer than ``plants``, each holds several cases, one to a row. Null and
    empty texts hold cases like others; no documents, no cases.
    """
    rows = docs.count()
    share = max(1, min(1_000_000, plants * 1_000_000 // max(rows, 1)))
    d = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("host"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"))
    d = d.where(F.pmod("h", F.lit(1_000_000)) < share)
    d = d.select("host", F.explode(F.sequence(F.lit(1), F.lit(max(1, plants // max(rows, 1))))).alias("i"), "h").select("host", F.xxhash64("h", "i").alias("h"))
    forms, sizes = _forms(docs)
    label = F.pmod(F.xxhash64(F.lit("label"), "h"), F.lit(2)).cast("double")
    d = d.select("h", "host", label.alias("label"), F.pmod(F.xxhash64(F.lit("form"), "h"), F.when(label == 1, sizes[1.0]).otherwise(sizes[0.0])).cast("int").alias("number"))
    d = d.join(F.broadcast(forms), ["label", "number"])
    leads = F.split("leads", "[|]")
    tails = F.array(*[F.lit(x) for x in (" ", " ", ". ", ", ", "\n", "; ")])
    at = F.pmod(F.xxhash64(F.lit("place"), "h"), F.length("host") + 1).cast("int")
    d = d.select("h", "label", F.concat(F.substring("host", F.greatest(at - HOST + 1, F.lit(1)), F.least(at, F.lit(HOST))), F.lit(" "),
                                        F.get(leads, F.pmod(F.xxhash64(F.lit("lead"), "h"), F.size(leads)).cast("int"))).alias("front"),
                 _filled(F.col("form"), F.col("h")).alias("case"),
                 F.concat(F.get(tails, F.pmod(F.xxhash64(F.lit("tail"), "h"), F.lit(6)).cast("int")), F.substring("host", at + 1, F.lit(HOST))).alias("rest"))
    return d.select("h", F.concat("front", "case", "rest").alias("text"), F.length("front").alias("start"), (F.length("front") + F.length("case")).alias("end"), "label")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plants: int = PLANTS, seed: int = 42) -> Model:
    """Trees and thresholds from about ``plants`` cases and look-alikes put into sampled texts (``planted``).

    A candidate that covers over half of a case has the case's label; what the texts hold of their own has no known
    label and is left out. Four fifths of the cases fit, one fifth sets each kind's least margin at which the spans
    above are right in ``PRECISION`` of cases; a kind without such a margin takes the trees' own line, a margin of 0.
    """
    d = staged(planted(docs, id_col, text_col, plants, seed), "cases")
    d = d.select("h", "start", "end", "label", F.explode(_featured(F.col("text"), _candidates(F.col("text")))).alias("s"))
    over = F.least("end", "s.end") - F.greatest("start", "s.start")
    rows_ = staged(d.where(2 * over > F.col("end") - F.col("start")).select("label", (F.pmod(F.xxhash64("h"), F.lit(5)) == 0).alias("check"), "s.kind", F.col("s.f").alias("f")), "candidates")
    if len(rows_.where("not check").select("label").distinct().take(2)) < 2:
        return Model([], {})
    columns = [n if n != "kind" else "kind_" for n in FEATURES]
    assembled = rows_.where("not check").select("label", *[F.col("f")[i].alias(n) for i, n in enumerate(columns)])
    assembled = VectorAssembler(inputCols=columns, outputCol="features").transform(assembled).select("label", "features")
    fitted = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=seed).fit(assembled)
    model = Model([(float(w), t._call_java("rootNode")) for w, t in zip(fitted.treeWeights, fitted.trees)], dict.fromkeys(LOOSE, 0.0))
    scored = rows_.where("check").select("kind", "label", F.round(model.margin(F.col("f")), 2).alias("margin")).groupBy("kind", "margin").agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
    for kind in LOOSE:
        good = n = 0
        for r in sorted((r for r in scored if r["kind"] == KINDS.index(kind)), key=lambda r: -r["margin"]):
            good, n = good + r["good"], n + r["n"]
            if good >= PRECISION * n:
                model.thresholds[kind] = r["margin"] - 0.005
    return model


def spans(docs: DataFrame, model: Model, text_col: str = "text", into: tuple[str, str] = ("base", "spans")) -> DataFrame:
    """``docs`` with two columns ``into``, base and spans: sorted arrays of (start, kind, end, found), code points, end exclusive.

    spans holds all of base and what the model adds beyond it; spans may overlap. Null and empty texts have none. Other
    columns pass through whatever they are called and hold, save that none may be called as the two.
    """
    if set(into) & set(docs.columns):
        raise ValueError(f"the input has a column named {into[0]} or {into[1]} already")
    names = docs.columns
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    d = d.select("*", F.sort_array(F.concat(*[find(F.col("__text"), k) for k in BASE])).alias("__base"))
    if model.thresholds:
        d = d.select("*", _candidates(F.col("__text")).alias("__loose"))
        fresh = F.filter("__loose", lambda s: ~F.exists("__base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
        d = d.select("*", F.filter(_featured(F.col("__text"), fresh), model.keeps).alias("__more"))
        added = F.transform("__more", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["found"].alias("found")))
        all_ = F.sort_array(F.concat("__base", added.cast(_SPAN)))
    else:
        all_ = F.col("__base")
    return d.select(*[F.col("__row").getField(c).alias(c) for c in names], F.col("__base").alias(into[0]), all_.alias(into[1]))


def listed(spans_: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def n_of(spans_: Column, kind: str) -> Column:
    return F.size(F.filter(spans_, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of overlapping spans the first one names the place."""
    names = F.array(*[F.lit(k.upper()) for k in KINDS])
    text = F.col(f"`{text_col}`").cast("string")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.get(names, s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("__spans_found", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step,
                       lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    found = spans(docs, model, text_col, ("__base_found", "__spans_found"))
    return found.select(*[F.when(F.size("__spans_found") > 0, done).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
