"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


WHITESPACE = r"(?U)[\s\x1C-\x1F]+"


def normalise(text: Column) -> Column:
    """Collapse whitespace runs (any Unicode space) to one space and strip; a missing text becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " "))


def not_blank(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) > 0


def tokens(text: Column) -> Column:
    """Lower-case whitespace tokens; [] for blank text."""
    clean = F.lower(normalise(text))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def truncate_tokens(text: Column, limit: int = 512) -> Column:
    """Keep the first ``limit`` whitespace tokens."""
    return F.array_join(F.slice(F.split(normalise(text), " "), 1, limit), " ")


def first_keywords(csv: Column, k: int = 5) -> Column:
    """Split a comma list, trim the parts and keep the first ``k``."""
    parts = F.transform(F.split(csv, ","), lambda p: F.trim(p))
    return F.slice(parts, 1, k)


def sentiment_label(answer: Column) -> Column:
    """Map a free answer to one of three labels."""
    return F.when(answer.contains("正面"), "正面").when(answer.contains("负面"), "负面").otherwise("中性")


def extract_sql(response: Column) -> Column:
    """SQL from a model answer: fenced block, else first SELECT ... ;, else the whole text."""
    fenced = F.trim(F.regexp_extract(response, r"(?s)```sql\s*(.*?)\s*```", 1))
    statement = F.trim(F.regexp_extract(response, r"(?is)(SELECT\s.*?;)", 1))
    empty = F.lit("")
    return F.coalesce(F.nullif(fenced, empty), F.nullif(statement, empty), F.trim(response))


def after_marker(text: Column, marker: str) -> Column:
    """Everything after the first ``marker``, trimmed; the whole text when it is absent."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.trim(F.substring(text, at + len(marker), F.length(text)))).otherwise(text)


def fill_template(template: str, **fields: Column) -> Column:
    """A template with {name} slots filled from columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(F.coalesce(fields[name].cast("string"), F.lit("")))
    return F.concat(*parts)


UNIT_NUMBER = r"#?(\d+)\s*号?\s*机组"


def intent(question: Column) -> dict[str, Column]:
    """Keyword routing of a question: pollutant, unit number and kind of answer wanted."""
    q = F.lower(question)

    def says(*words: str) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | q.contains(w)
        return hit

    pollutant = (
        F.when(says("so2", "二氧化硫"), "so2")
        .when(says("nox", "氮氧化物"), "nox")
        .when(says("烟尘", "灰尘", "dust"), "dust")
    )
    unit = F.nullif(F.regexp_extract(q, UNIT_NUMBER, 1), F.lit("")).cast("long")
    # a later topic overrides an earlier one, so the chain runs from the last topic to the first
    kind = (
        F.when(says("趋势", "变化"), "trend")
        .when(says("最低", "最少"), "ranking_lowest")
        .when(says("最高", "最多"), "ranking_highest")
        .when(says("超标") & says("次数"), "exceedance_count")
        .when(says("机组") & unit.isNotNull() & says("排放"), "unit_emissions")
        .when(says("机组") & unit.isNotNull() & says("状态"), "unit_status")
        .when(pollutant.isNotNull() & says("平均"), "average")
        .otherwise("unknown")
    )
    return {"pollutant": pollutant, "unit_no": unit, "intent": kind}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays; 0 when either has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def unit_vector(a: Column) -> Column:
    """The array scaled to length one; a zero vector stays zero."""
    norm = F.array(F.sqrt(dot(a, a)))  # bound once by the outer function, not summed anew for every element
    return F.get(F.transform(norm, lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))), F.lit(0))
