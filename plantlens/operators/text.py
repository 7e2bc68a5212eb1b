"""Text jobs: keywords, sentiment, pair builders, error rates, SQL corpus checks."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantlens.functions import text as tf
from plantlens.session import scratch_path, staged

# Prompt texts of the pair builders.
NL2SQL_INSTRUCTION = "根据以下数据库模式，将自然语言查询转换为SQL查询。\n\n数据库模式:\n{schema}\n\n自然语言查询: {question}"
NL2SQL_RESPONSE = "SQL查询:\n{sql}"
FORECAST_INSTRUCTION = "根据以下环境和运行数据，预测未来24小时的污染物排放水平。\n\n数据:\n{context}"
TRAINING_TEMPLATE = "指令: {instruction}\n\n回答: {response}"
ANSWER_MARKER = "回答: "
FORECAST_RESPONSE = "预测结果:\n{prediction}"

POSITIVE = ("good", "great", "improve", "clean", "success", "正常", "达标", "改善")
NEGATIVE = ("bad", "poor", "fail", "pollution", "exceed", "超标", "污染", "故障")


HOT_TERMS = 20_000
HELD_TERMS = 200_000  # terms a task counts before it passes them on
_SLACK = 1e-6  # scores are compared at nine digits, so closer ones may tie


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """Some rows of (id, lower-case text or words) and their words; Python's blanks are those of ``tf.WHITESPACE``."""
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            yield part, [x.split() if isinstance(x, str) else [w for w in x or [] if w is not None] for x in part.column(1).to_pylist()]


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): how many of some rows hold a term."""
    counts: Counter = Counter()

    def held() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    for _, rows in documents(batches):
        for words in rows:
            counts.update(set(words))
        if len(counts) > HELD_TERMS:
            yield held()
            counts.clear()
    yield held()


def _candidates(k: int, hot: dict[str, int], n_docs: int, most: float):
    """For each row of (id, words): the terms that may be among its ``k`` best, as (id, term, tf, df), df only if the term is hot."""

    def idf(df: float) -> float:
        return math.log((1.0 + n_docs) / (1.0 + df)) + 1

    weight = {t: idf(n) for t, n in hot.items()}
    low, high = idf(max(most, 1.0)), idf(1.0)

    def best(words: list[str]) -> list[tuple[str, int, int | None]]:
        counts = Counter(words)
        known = sorted((-n * weight[t], t, n) for t, n in counts.items() if t in weight)
        rest = [(t, n) for t, n in counts.items() if t not in weight]
        sure = sorted([-s for s, _, _ in known[:k]] + [n * low for _, n in rest], reverse=True)
        least = (sure[k - 1] if len(sure) >= k else 0.0) - _SLACK
        out: list[tuple[str, int, int | None]] = [(t, n, None) for t, n in rest if n * high >= least]
        alike: Counter = Counter()
        for s, t, n in known:
            if -s < least:
                break
            alike[n, hot[t]] += 1
            if alike[n, hot[t]] <= k:  # these tie, so the first terms win
                out.append((t, n, hot[t]))
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in documents(batches):
            at, found = [], []
            for i, words in enumerate(rows):
                own = best(words)
                at += [i] * len(own)
                found += own
            terms, tfs, dfs = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(dfs, pa.int64())], names=["id", "term", "tf", "df"])

    return search


def keywords(df: DataFrame, *, id_col: str, text: str, k: int = 5, tokens: str | None = None) -> DataFrame:
    """Top-k terms per document by TF-IDF (ties by term), as id, keywords array; blank text gives [].

    Terms are the text's words between blanks, or the array column ``tokens`` (see ``segment`` for text without blanks).
    Rows with one id are one document.

    A term that holds more than one in HOT_TERMS of all document terms is hot; there can be at most HOT_TERMS such terms,
    so their counts go to the tasks. A document's terms are counted within its row, and only those leave it that can still
    be among the best: the weight of a term that is not hot is known to lie above that of all hot ones and below that of a
    term in one document. These are joined with their counts by shuffle, where none can dominate a task.
    """
    words = F.col(tokens) if tokens else tf.tokens(F.col(text))
    key = F.col(id_col)
    repeated = staged(df.groupBy(key.alias("id")).agg(F.count("*").alias("n")).where("n > 1 or id is null").select(F.col("id").alias("__id")), "repeated")
    single, pairs = df, None
    if not repeated.isEmpty():
        same = key.eqNullSafe(F.col("__id"))
        single = df.join(repeated, same, "left_anti")
        several = df.join(repeated, same, "left_semi").select(key.alias("id"), F.explode(words).alias("term"))
        pairs = staged(several.groupBy("id", "term").agg(F.count("*").alias("tf")), "terms")
    rows = single.select(key.alias("id"), (words if tokens else F.lower(text)).alias("words"))
    held = rows.mapInArrow(_holders, "term string, n long")
    if pairs is not None:
        held = held.unionByName(pairs.where("term is not null").select("term", F.lit(1).cast("long").alias("n")))
    weights = staged(held.groupBy("term").agg(F.sum("n").alias("df")), "weights")
    n_docs, n_pairs = df.count(), weights.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    most = n_pairs / HOT_TERMS
    hot = {r["term"]: r["df"] for r in weights.where(F.col("df") > most).collect()}  # HOT_TERMS at most
    schema = f"id {df.schema[id_col].dataType.simpleString()}, term string, tf long, df long"
    found = rows.mapInArrow(_candidates(k, hot, n_docs, most), schema)
    if pairs is not None:
        known = F.broadcast(weights.where(F.col("df") > most))
        found = found.unionByName(pairs.join(known, "term", "left").select("id", "term", "tf", "df"))
    found = staged(found, "candidates")
    cold = found.where("df is null").drop("df").join(weights.where(F.col("df") <= most), "term")
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1
    scored = found.where("df is not null").unionByName(cold).select("id", "term", (F.col("tf") * idf).alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc(F.round("score", 9)), "term")
    top = (
        scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_t"))
        .select(F.col("id").alias(id_col), F.col("_t.term").alias("keywords"))
    )
    return df.join(top, id_col, "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def sentiment(df: DataFrame, text: str, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE,
              out: str = "sentiment") -> DataFrame:
    """Three-way label from counts of lexicon words in the text."""
    words = tf.tokens(F.col(text))

    def hits(lexicon: Sequence[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(list(lexicon))))

    balance = hits(positive) - hits(negative)
    return df.withColumn(out, F.when(balance > 0, "正面").when(balance < 0, "负面").otherwise("中性"))


def nl2sql_pairs(df: DataFrame, schema_text: str, *, question: str = "natural_language", sql: str = "sql_query") -> DataFrame:
    """Instruction / response rows for questions with SQL; rows with an empty side are skipped."""
    kept = df.filter(tf.not_blank(F.col(question)) & tf.not_blank(F.col(sql)))
    return kept.select(
        tf.fill_template(NL2SQL_INSTRUCTION, schema=F.lit(schema_text), question=F.col(question)).alias("instruction"),
        tf.fill_template(NL2SQL_RESPONSE, sql=F.col(sql)).alias("response"),
    )


def forecast_pairs(df: DataFrame, *, context: str = "context", prediction: str = "prediction", keep: Sequence[str] = ()) -> DataFrame:
    kept = df.filter(tf.not_blank(F.col(context)) & tf.not_blank(F.col(prediction)))
    return kept.select(
        *keep,
        tf.fill_template(FORECAST_INSTRUCTION, context=F.col(context)).alias("instruction"),
        tf.fill_template(FORECAST_RESPONSE, prediction=F.col(prediction)).alias("response"),
    )


def training_text(df: DataFrame, template: str = TRAINING_TEMPLATE) -> DataFrame:
    return df.withColumn("text", tf.fill_template(template, instruction=F.col("instruction"), response=F.col("response")))


def nl2sql_dataset(df: DataFrame, schema_text: str) -> DataFrame:
    """natural_language, sql_query, db_schema for complete rows."""
    kept = df.filter(tf.not_blank(F.col("natural_language")) & tf.not_blank(F.col("sql_query")))
    return kept.select("natural_language", "sql_query", F.lit(schema_text).alias("db_schema"))


def speech_dataset(df: DataFrame, *, text: str = "text", domain: str = "domain", keep: Sequence[str] = ()) -> DataFrame:
    kept = df.filter(tf.not_blank(F.col(text)))
    label = F.coalesce(F.col(domain), F.lit("general")) if domain in df.columns else F.lit("general")
    return kept.select(*keep, F.col(text).alias("text"), label.alias("domain"))


_FIRST_POINT, _LAST_POINT = 0x10000, 0x10FFFF  # supplementary planes: no surrogates, no byte order mark


def code_points(numbers: Column) -> Column:
    """A string with one character for each number from 0 to 1,048,575 of an array; equal numbers give equal characters."""
    encoded = F.transform(numbers, lambda i: F.lpad(F.hex((i + _FIRST_POINT).cast("long")), 8, "0"))
    return F.decode(F.unhex(F.array_join(encoded, "")), "UTF-32")


def word_distance(ref: Column, hyp: Column) -> Column:
    """Edits between the words of two normalised texts, upper and lower case apart; null if either is.

    Words become characters, numbered within the pair, and the built-in edit distance compares those. Words that only
    one text has can match nothing, so each side needs one character for all of them, and a pair may share 1,048,574
    different words (beyond that an error: the edit table would have 10^12 cells).
    """
    r, h = (F.filter(F.split(t, " "), lambda w: w != "") for t in (ref, hyp))
    pair = F.struct(r.alias("ref"), h.alias("hyp"), F.array_intersect(r, h).alias("both"))

    def coded(p: Column, side: str, alone: int) -> Column:
        return code_points(F.transform(p[side], lambda w: F.when(F.array_contains(p["both"], w), F.array_position(p["both"], w) + 1).otherwise(F.lit(alone))))

    def distance(p: Column) -> Column:
        beyond = F.size(p["both"]) > _LAST_POINT - _FIRST_POINT - 1
        error = F.raise_error(F.lit("a pair of texts shares more words than there are characters")).cast("int")
        return F.when(beyond, error).otherwise(F.levenshtein(coded(p, "ref", 0), coded(p, "hyp", 1)))

    return F.get(F.transform(F.array(pair), distance), F.lit(0)).cast("long")


def error_rates(df: DataFrame, *, ref: str, hyp: str, by: Sequence[str] = ()) -> DataFrame:
    """Corpus character and word error rates: ratios of sums, not means of ratios."""
    r, h = tf.normalise(F.col(ref)), tf.normalise(F.col(hyp))
    rows = df.select(*by, r.alias("r"), h.alias("h")).select(
        *by, F.levenshtein("r", "h").alias("char_edits"), F.length("r").alias("chars"),
        word_distance(F.col("r"), F.col("h")).alias("word_edits"), F.size(tf.tokens(F.col("r"))).alias("words"),
    )
    sums = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("char_edits", "chars", "word_edits", "words")])
    return sums.select(
        *by, "char_edits", "chars", "word_edits", "words",
        F.when(F.col("chars") > 0, F.col("char_edits") / F.col("chars")).alias("cer"),
        F.when(F.col("words") > 0, F.col("word_edits") / F.col("words")).alias("wer"),
    )


def evaluate_generations(df: DataFrame, *, reference: str, generated: str, marker: str = ANSWER_MARKER, by: Sequence[str] = ()) -> DataFrame:
    """Answer part of stored generations against references: exact-match share and error rates."""
    answer = df.withColumn("_answer", tf.after_marker(F.col(generated), marker))
    same = tf.normalise(F.col("_answer")) == tf.normalise(F.col(reference))
    match = answer.groupBy(*by).agg(F.count("*").alias("n"), F.avg(same.cast("int")).alias("exact_match"))
    rates = error_rates(answer, ref=reference, hyp="_answer", by=by)
    if by:
        return match.join(rates, list(by))
    row = match.first()
    return rates.withColumns({"n": F.lit(row["n"]), "exact_match": F.lit(row["exact_match"])})


def statement_is_valid(spark: SparkSession, sql: str) -> bool:
    """Whether a query analyses against the registered views; nothing is executed.

    It is analysed as a subquery, where a command cannot stand, after EXPLAIN, which does not run what it explains, has
    parsed it on its own.
    """
    query = sql.rstrip().rstrip(";")
    try:
        spark.sql(f"EXPLAIN {query}")
        spark.sql(f"SELECT * FROM (\n{query}\n)").schema  # noqa: B018 - forces analysis only
        return True
    except (AnalysisException, ParseException):
        return False


STATEMENT_BATCH = 5_000
VERDICT = "s string, ok boolean"


def validate_corpus(df: DataFrame, *, response: str, fixed: str | None = None) -> DataFrame:
    """Extract SQL from answers and mark it valid; where it is not, retry the ``fixed`` column.

    Analysis needs the catalog, so each distinct statement visits the driver once, in batches; the verdicts
    are kept as a table. Text that is no SELECT or WITH statement is invalid without analysis.
    """
    spark = df.sparkSession
    rows = df.withColumn("sql", tf.extract_sql(F.col(response)))
    if fixed:
        rows = rows.withColumn("fixed_sql", tf.extract_sql(F.col(fixed)))
    columns = ["sql", "fixed_sql"] if fixed else ["sql"]
    distinct = None
    for c in columns:
        part = rows.select(F.col(c).alias("s")).filter(F.col(c).rlike(r"(?is)^\s*(select|with)\s"))
        distinct = part if distinct is None else distinct.unionByName(part)
    path = scratch_path(spark, "verdicts")

    def record(batch: list[str]) -> None:
        spark.createDataFrame([(x, statement_is_valid(spark, x)) for x in batch], VERDICT).write.mode("append").parquet(path)

    batch: list[str] = []
    for r in distinct.distinct().toLocalIterator():
        batch.append(r["s"])
        if len(batch) == STATEMENT_BATCH:
            record(batch)
            batch = []
    record(batch)
    verdicts = spark.read.schema(VERDICT).parquet(path)

    def checked(frame: DataFrame, column: str, out: str) -> DataFrame:
        v = verdicts.select(F.col("s").alias(column), F.col("ok").alias(out))
        return frame.join(v, column, "left").withColumn(out, F.coalesce(out, F.lit(False)))

    rows = checked(rows, "sql", "is_valid")
    if fixed:
        rows = checked(rows, "fixed_sql", "_fixed_ok")
        use = ~F.col("is_valid") & F.col("_fixed_ok")
        rows = rows.withColumns({
            "sql": F.when(use, F.col("fixed_sql")).otherwise(F.col("sql")), "is_valid": F.col("is_valid") | F.col("_fixed_ok"),
        }).drop("_fixed_ok", "fixed_sql")
    return rows


def validity_ratio(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("total"), F.count_if("is_valid").alias("valid"),
                       F.avg(F.col("is_valid").cast("int")).alias("ratio"))


def run_sql(spark: SparkSession, sql: str) -> tuple[DataFrame, list[str]]:
    """Run a statement; returns the rows as a frame with its column names. Errors are raised."""
    out = spark.sql(sql.rstrip().rstrip(";"))
    return out, out.columns
