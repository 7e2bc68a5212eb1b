"""Words of text written without blanks: a lexicon learnt from character runs, and the best path through it.

A string of characters is a word if its parts meet far more often than by chance (cohesion) and if many different
characters stand before and behind it (branching entropy). Counting and scoring are joins and aggregations over all
texts; the lexicon is a model of bounded size, and a text is cut along the most probable path of a unigram lattice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.functions import text as tf
from plantlens.session import staged

HAN = "㐀-䶿一-鿿"  # characters of text without blanks, as the inside of a character class
LEXICON_WORDS = 200_000  # words of the model, the most frequent; tasks hold them
NEAR = "\x02"  # stands for the border of a run as a neighbour


def runs(text: Column, chars: str = HAN) -> Column:
    """The unbroken runs of such characters in a text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"([{chars}]+)"), F.lit(1))


def _grams(counted: DataFrame, longest: int) -> DataFrame:
    """(gram, size, left, right, n): every string of at most ``longest`` characters with its neighbours, counted by run."""
    at = counted.select("n", F.concat(F.lit(NEAR), "run", F.lit(NEAR)).alias("line"), F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    wide = at.select("n", "line", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("line") - 1 - F.col("at")))).alias("size"))
    return wide.select(F.substring("line", F.col("at") + 1, F.col("size")).alias("gram"), "size", F.substring("line", F.col("at"), F.lit(1)).alias("left"),
                       F.substring("line", F.col("at") + 1 + F.col("size"), F.lit(1)).alias("right"), "n")


def _entropy(neighbours: DataFrame, side: str) -> DataFrame:
    n = F.col("n").cast("double")
    each = neighbours.groupBy("gram", side).agg(F.sum("n").alias("n"))
    return each.groupBy("gram").agg((F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n)).alias(f"{side}_entropy"))


def lexicon(df: DataFrame, text: str, *, chars: str = HAN, longest: int = 4, min_count: int = 5, min_cohesion: float = 20.0, min_entropy: float = 0.8,
            most_words: int = LEXICON_WORDS) -> DataFrame:
    """(word, n, cohesion, left_entropy, right_entropy): words of two characters or more, and every single character.

    Cohesion is the least ratio, over the ways to cut a word in two, of its count to what chance would give. Runs
    that repeat are counted once with their number. Null texts have no runs. Of words beyond ``most_words`` the most
    frequent stay; single characters, which always do, have no figures.
    """
    counted = staged(df.select(F.explode(runs(F.col(text), chars)).alias("run")).groupBy("run").agg(F.count("*").alias("n")), "runs")
    grams = staged(_grams(counted, longest).groupBy("gram", "size", "left", "right").agg(F.sum("n").alias("n")), "grams")
    counts = staged(grams.groupBy("gram", "size").agg(F.sum("n").alias("n")), "gram-counts")
    total = counts.where("size = 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    often = counts.where((F.col("size") > 1) & (F.col("n") >= min_count))
    cuts = often.select("gram", "n", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    parts = cuts.select("gram", "n", F.substring("gram", F.lit(1), F.col("cut")).alias("a"), F.substring("gram", F.col("cut") + 1, F.col("size")).alias("b"))
    of = counts.select(F.col("gram").alias("part"), F.col("n").alias("n_part"))
    parts = parts.join(of.withColumnsRenamed({"part": "a", "n_part": "n_a"}), "a").join(of.withColumnsRenamed({"part": "b", "n_part": "n_b"}), "b")
    chance = F.col("n").cast("double") * total / (F.col("n_a").cast("double") * F.col("n_b"))
    bound = parts.groupBy("gram", "n").agg(F.min(chance).alias("cohesion")).where(F.col("cohesion") >= min_cohesion)
    beside = grams.join(bound.select("gram"), "gram")
    free = bound.join(_entropy(beside, "left"), "gram").join(_entropy(beside, "right"), "gram").where(F.least("left_entropy", "right_entropy") >= min_entropy)
    words = free.orderBy(F.desc("n"), "gram").limit(most_words).select(F.col("gram").alias("word"), "n", "cohesion", "left_entropy", "right_entropy")
    none = F.lit(None).cast("double")
    singles = counts.where("size = 1").select(F.col("gram").alias("word"), "n", none.alias("cohesion"), none.alias("left_entropy"), none.alias("right_entropy"))
    return staged(words.unionByName(singles), "lexicon")


class Segmenter:
    """The most probable cut of a run into words of a lexicon; of equal ones that with the longest last word.

    A character the lexicon lacks is a word of its own, less probable than any listed one.
    """

    def __init__(self, words: dict[str, int]) -> None:
        total = float(sum(words.values())) or 1.0
        self.cost = {w: -float(np.log(n / total)) for w, n in words.items() if n > 0}
        self.longest = max(map(len, words), default=1)
        self.unknown = float(np.log(total)) + 10.0

    def cut(self, run: str) -> list[str]:
        best, start = [0.0] + [np.inf] * len(run), [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            for at in range(max(0, end - self.longest), end):
                cost = self.cost.get(run[at:end], self.unknown if end - at == 1 else np.inf)
                if best[at] + cost < best[end] - 1e-12:
                    best[end], start[end] = best[at] + cost, at
        out, end = [], len(run)
        while end:
            out.append(run[start[end] : end])
            end = start[end]
        return out[::-1]


def segmented(df: DataFrame, text: str, words: DataFrame, *, chars: str = HAN, out: str = "tokens") -> DataFrame:
    """``df`` with an array of lower-case words: runs of ``chars`` cut along the lexicon, all else at blanks.

    Blank and null texts have none. The lexicon (word, n) goes to the tasks; ``lexicon`` bounds its size.
    """
    listed = words.select("word", "n").limit(LEXICON_WORDS + 200_000).toPandas()
    model = Segmenter(dict(zip(listed["word"], listed["n"].astype(int))))

    @F.pandas_udf("array<string>")
    def cut(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held: dict[str, list[str]] = {}

        def one(run: str) -> list[str]:
            if run not in held:
                if len(held) > 100_000:
                    held.clear()
                held[run] = [run] if run.startswith(" ") else model.cut(run)
            return held[run]

        for parts in rows:
            yield parts.map(lambda p: [w for run in p for w in one(run)])

    # A text becomes its pieces: runs between marks, and what lies between them cut at blanks.
    marked = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"([{chars}]+)", " $1 ")
    pieces = F.filter(F.split(tf.normalise(marked), " "), lambda p: p != "")
    plain = F.transform(pieces, lambda p: F.struct(p.alias("piece"), p.rlike(f"^[{chars}]+$").alias("run")))
    d = df.withColumn("__pieces", plain)
    d = d.withColumn("__cut", F.when(F.exists("__pieces", lambda p: p["run"]), _cut_runs(cut)))
    whole = F.transform("__pieces", lambda p: F.lower(p["piece"]))
    return d.withColumn(out, F.coalesce("__cut", whole)).drop("__pieces", "__cut")


def _cut_runs(cut) -> Column:
    """Every piece cut if it is a run; others are handed through as they are, marked by a leading blank."""
    return F.transform(cut(F.transform("__pieces", lambda p: F.when(p["run"], p["piece"]).otherwise(F.concat(F.lit(" "), F.lower(p["piece"]))))), lambda w: F.trim(w))
