"""Quality rules, lines first: failing lines go, and a text that loses too much of itself goes with them.

Everything is a column expression; nothing leaves the row, so no shuffle is needed and a long text costs its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import GAP, WORD, text_words

SYMBOLS = r"[#*$%&|<>]"
END = r"[.!?…:;][\"'”’»)\]]*([\x20\x09-\x0D]|\z)"  # a sentence ends somewhere in the line
BOILERPLATE = (
    r"(?i)(\b(licen[sc]ed under|under the .{1,40} licen[sc]e|all rights reserved|copyright|\(c\) ?[0-9]{4}|privacy policy|terms of (use|service)"
    r"|cookies?|enable javascript|subscribe (to|now)|sign up|log ?in|read more|click here)\b|spdx-licen[sc]e-identifier)"
)
LICENCE = r"(?i)(\b(licen[sc]ed under|under the .{1,40} licen[sc]e)\b|spdx-licen[sc]e-identifier)"
WINDOW = 5
LEAST_WORDS = 10
DENSE = 20  # a line of more than 40 words is boilerplate if it has a phrase of it in as many words


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def line_fails(line: Column, words: Column) -> Column:
    """The name of the first rule that a line with ``words`` words (1 at least) fails, else null."""
    shout, menu = _count(line, "!"), _count(line, r"(^|[\x20\x09])[|·»›>]+(?=[\x20\x09]|$)")
    return (
        F.when((menu >= 2) & (5 * menu >= words), "navigation")
        .when((_count(line, SYMBOLS) * 5 > words) & (words >= 3), "symbols")
        .when((shout * 3 > words) & (shout >= 3), "shouting")
        .when((words <= 40) & line.rlike(BOILERPLATE), F.when(line.rlike(LICENCE), "licence").otherwise("boilerplate"))
        .when((words > 3) & ~line.rlike(END), "punctuation")
        .when((words > 40) & (_count(line, BOILERPLATE) * DENSE >= words), "notice")
    )


def words_of(some: Callable[[Column], Column]) -> Column:
    """The words of the judged lines that fail by one of some rules."""
    return F.aggregate("__judged", F.lit(0).cast("long"), lambda s, x: s + F.when(some(x["rule"]), x["words"]).otherwise(0))


def repeated_words(hashes: str, n: str) -> list[tuple[str, Column]]:
    """Columns, one on the other, that end in ``n_repeat_words``: words inside windows met twice or more.

    ``hashes`` holds the hash of each word. Windows are compared by a 64-bit hash of their five word hashes. Only a
    text with a repeated window is sorted.
    """
    window = F.transform(
        F.slice(F.col(hashes), F.lit(1), F.greatest(F.col(n) - (WINDOW - 1), F.lit(0)).cast("int")),
        lambda h, i: F.xxhash64(h, *[F.get(F.col(hashes), i + k) for k in range(1, WINDOW)]),
    )
    placed = F.when(F.size(F.array_distinct("__win")) < F.size("__win"), F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    again = F.filter(
        F.transform("__placed", lambda e, k: F.when((e["h"] == F.get("__placed", k - 1)["h"]) | (e["h"] == F.get("__placed", k + 1)["h"]), e["i"])),
        lambda i: i.isNotNull(),
    )
    steps = F.transform("__again", lambda v, k: F.least(F.coalesce(F.get("__again", k + 1) - v, F.lit(WINDOW)), F.lit(WINDOW)))
    total = F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))
    return [("__win", window), ("__placed", placed), ("__again", F.sort_array(again)), ("n_repeat_words", total)]


def assess(docs: DataFrame, text_col: str = "text", max_loss: float = 0.5, into: str = "quality") -> DataFrame:
    """``docs`` with one more column, ``into``: a struct of counts, flags and the cleaned text; no row is dropped.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_kept_words (words of the lines
    that pass), clean (those lines joined by line feeds, lines without a word included), kept. A text is kept if
    base_failed is false, the cleaned text has ten words, and failing lines hold at most ``max_loss`` of its words; lines
    that name a licence are removed but not counted as lost. Null and blank texts have zero counts and fail
    for want of words. Repeated rows are judged alike; other columns pass through whatever they are called and hold, save
    that none may be called as ``into``.
    """
    if into in docs.columns:
        raise ValueError(f"the input has a column named {into} already")
    names = docs.columns
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    d = d.select("*", text_words(F.col("__text")).alias("__words"), F.split("__text", "\n").alias("__lines"))
    d = d.select(
        "*", F.size("__words").cast("long").alias("n_words"), F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
        F.aggregate("__words", F.lit(0).cast("long"), lambda s, w: s + F.length(w)).alias("word_chars"), _count(F.col("__text"), SYMBOLS).alias("n_symbols"),
        F.filter("__lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__full"),
        F.transform("__lines", lambda x: F.struct(x.alias("line"), _count(x, WORD).alias("words"))).alias("__counted"),
    )
    judged = F.transform("__counted", lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"), F.when(x["words"] > 0, line_fails(x["line"], x["words"])).alias("rule")))
    d = d.select("*", (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long").alias("n_dup_lines"), judged.alias("__judged"))
    d = d.select("*", F.filter("__judged", lambda x: x["rule"].isNull()).alias("__passed"), words_of(lambda r: r != "licence").alias("__lost"))
    for name, column in repeated_words("__hashes", "n_words"):
        d = d.select("*", column.alias(name))
    d = d.select(
        "*", F.aggregate("__passed", F.lit(0).cast("long"), lambda s, x: s + x["words"]).alias("n_kept_words"),
        F.array_join(F.transform("__passed", lambda x: x["line"]), "\n").alias("clean"),
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
    )
    kept = ~F.col("base_failed") & (F.col("n_kept_words") >= LEAST_WORDS) & (F.col("__lost") <= F.col("n_words") * max_loss)
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_kept_words", "clean"]
    # A generator, as a filter on the verdict would else be pushed below its steps and repeat them inside each other.
    verdict = F.explode_outer(F.array(F.struct(*fields, kept.alias("kept"))))
    return d.select("__row", verdict.alias("__verdict")).select(*[F.col("__row").getField(c).alias(c) for c in names], F.col("__verdict").alias(into))


def cleaned(docs: DataFrame, text_col: str = "text", max_loss: float = 0.5) -> DataFrame:
    """The kept rows with their cleaned text, columns as before."""
    judged = assess(docs, text_col, max_loss, "__quality").where("__quality.kept")
    return judged.select(*[F.col("__quality.clean").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def recounted(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """``docs`` with the length of the text in ``count_col``, where there is such a column."""
    return docs.withColumn(count_col, F.length(text_col).cast("long")) if count_col in docs.columns else docs
