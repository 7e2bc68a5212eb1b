"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a row of words and tags. Words score positive, by the element they stand in, and tags score negative; the
weights are log-odds counted on labelled pages, those whose authors marked the article. One scan finds the contiguous
region with the highest sum, and its text without page furniture is the result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_PAGES = 2000  # labelled pages that weights are counted on, about; chosen by hash
WORD_DEFAULT, TAG_DEFAULT = 0.5, -1.0
WORD_RANGE, TAG_RANGE = (0.01, 1.0), (-8.0, -0.02)

_RAW = "script|style|noscript|template|textarea|title|svg|iframe|select|object|math|canvas|video|audio"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>]|\Z)(?:[^>]*/>|[^>]*>.*?(?:</\1\s*>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)|[^<]+|<", re.S | re.I)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img input ins kbd label link mark meta q s samp small span strike strong sub sup time tt u var wbr br button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = frozenset("nav aside footer header form menu dialog button label fieldset".split())
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ROLE = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|side-?bar|nav\w*|menu\w*|breadcrumbs?|footer|header|masthead|comments?|disqus|repl(?:y|ies)|respond"
    r"|cookies?|notices?|consent|banner|popup|modal|newsletter|subscribe\w*|shar(?:e|ing)|social|related|recommend\w*|widget|toolbar|pagination|login|signup|search", re.I)
_PART = re.compile(r"[a-z0-9]+|[^a-z0-9_\s-]+", re.I)
# First parts of names that speak of what an element has or lacks, or how it is laid out, not of what it is.
_ABOUT = frozenset("with without no not has have is hide show hidden toggle under below above after before next left right full beside col row grid layout page body content main article post entry".split())


def _role_word(name: str) -> bool:
    """Whether a class, id or role names page furniture: it is a role word, or a compound of one, but not like ``with-sidebar``."""
    if _ROLE.fullmatch(name):
        return True
    parts = _PART.findall(name)
    return len(parts) > 1 and parts[0].lower() not in _ABOUT and bool(_ROLE.fullmatch(parts[0]) or _ROLE.fullmatch(parts[-1]))


def _furniture(name: str, attrs: str) -> bool:
    """Elements that are furniture by their kind, and block or unknown elements that a class, id or role names so."""
    if name in _FURNITURE:
        return True
    if not attrs or name in ("html", "body", "article", "main") or name in _INLINE:
        return False
    return any(_role_word(word) for found in _NAMED.findall(attrs) for word in "".join(found).split())


def tokens(page: str, named: bool = True) -> list[tuple[str, str, str, bool]]:
    """(kind, name, text, skipped): kind is open, close or text; a text's name is the element it stands in.

    Scripts, styles, comments and the like give no token. skipped marks what lies inside page furniture; if ``named`` is
    false, classes, ids and roles do not make an element furniture.
    """
    out, stack, skip, depth = [], ["html"], "", 0
    for m in _TOKEN.finditer(page):
        name = m[3]
        if name is None:
            t = m[0]
            if t[0] != "<" or t == "<":
                out.append(("text", stack[-1], t, bool(skip)))
            continue
        name, closing = name.lower(), bool(m[2])
        if skip and (name in ("article", "main") or closing and name in ("body", "html")):
            skip = ""
        if skip:
            if name == skip:
                depth += -1 if closing else 1
                if depth == 0:
                    skip = ""
            out.append(("close" if closing else "open", name, "", True))
        else:
            if not closing and name not in _VOID and _furniture(name, m[4] if named else ""):
                skip, depth = name, 1
            out.append(("close" if closing else "open", name, "", bool(skip)))
        if name in _BLOCK or name == "a":
            if closing:
                if name in stack[1:]:
                    del stack[len(stack) - 1 - stack[::-1].index(name) :]
            elif name not in _VOID:
                if name == stack[-1] == "p" or name != "a" and stack[-1] == "p":
                    stack.pop()
                stack.append(name)
                del stack[1:-40]
    return out


def _feature(kind: str, name: str) -> str:
    if name not in _BLOCK and name not in _INLINE:
        name = "other"
    return f"w {name}" if kind == "text" else f"t {name}"


def count_labelled(page: str) -> Counter:
    """(feature, inside) counts of a page with an article element, words inside furniture left out; else none."""
    found = tokens(page)
    ends = [i for i, (k, n, _, _) in enumerate(found) if n == "article" and k == "close"]
    start = next((i for i, (k, n, _, _) in enumerate(found) if n == "article" and k == "open"), None)
    counts: Counter = Counter()
    if start is None or not ends or ends[-1] < start:
        return counts
    for i, (kind, name, text, skipped) in enumerate(found):
        n = len(text.split()) if kind == "text" else 1
        if n:
            counts[_feature(kind, name), start < i < ends[-1] and not skipped] += n
    return counts


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds of each feature, kept positive for words and negative for tags."""
    out = {}
    for f in {f for f, _ in counts}:
        odds = log((counts.get((f, True), 0) + 1) / (counts.get((f, False), 0) + 1))
        low, high = WORD_RANGE if f[0] == "w" else TAG_RANGE
        out[f] = min(high, max(low, odds))
    return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", fit_pages: int = FIT_PAGES) -> dict[str, float]:
    """Weights from about ``fit_pages`` pages picked by hash; features are the known elements, so few rows are collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                total += count_labelled(page.as_py() or "")
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in total], pa.string()), pa.array([i for _, i in total], pa.bool_()), pa.array(list(total.values()), pa.int64())], names=["f", "inside", "n"])

    rows = pages.count()
    share = max(1, min(1_000_000, fit_pages * 1_000_000 // max(rows, 1)))
    some = pages.where(F.pmod(F.xxhash64(F.col(id_col), F.length(html_col)), F.lit(1_000_000)) < share)
    found = some.select(F.col(html_col).cast("string").alias("html")).mapInArrow(count, "f string, inside boolean, n long").groupBy("f", "inside").agg(F.sum("n").alias("n")).collect()
    return weights({(r["f"], r["inside"]): r["n"] for r in found})


def region(found: list[tuple[str, str, str, bool]], model: dict[str, float]) -> tuple[int, int]:
    """Ends of the best run of tokens, by one scan; the first of equals, empty if no run scores above zero."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, name, text, skipped) in enumerate(found):
        if kind == "text":
            score = 0.0 if skipped else len(text.split()) * model.get(_feature(kind, name), WORD_DEFAULT)
        else:
            score = model.get(_feature(kind, name), TAG_DEFAULT)
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, at = total, (start, i + 1)
    return at


def main_text(page: str | None, model: dict[str, float]) -> str:
    """The region's blocks, white space folded, one per line. Null, empty and wordless pages give an empty text.

    A page all of whose words lie in elements that only a class, id or role names furniture is read without those names.
    """
    if not page:
        return ""
    return _text(tokens(page), model) or _text(tokens(page, named=False), model)


def _text(found: list[tuple[str, str, str, bool]], model: dict[str, float]) -> str:
    start, end = region(found, model)
    blocks, held = [], []
    for kind, name, text, skipped in found[start:end]:
        if kind == "text":
            if not skipped:
                held.append(text)
        elif name == "br":
            held.append(" ")
        elif name in _BLOCK:
            blocks.append("".join(held))
            held = []
    blocks.append("".join(held))
    folded = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in folded if b)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", fit_pages: int = FIT_PAGES) -> DataFrame:
    """(id, url, text) of every row. Pages are read whole; repeated and null ids keep their rows; a table without
    labelled pages is scored with default weights; an empty table gives an empty table."""
    model = fit(pages, id_col, html_col, fit_pages)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p.as_py(), model) for p in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["id", "url", "text"])

    three = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return three.mapInArrow(extract, "id long, url string, text string")
