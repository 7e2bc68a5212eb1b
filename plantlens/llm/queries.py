"""The named queries of the text operators, each over its whole table, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.llm import chunks, html, idfiles, leaks, mixing, pii, ppm, quality, ranking, resample, simhash, tokens, warc
from plantlens.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint of three-word shingles and the smallest id it is linked to."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, bits=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op2_quality_rules", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM again) GROUP BY 1),
lines AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE n > 0 GROUP BY 1),
facts AS (SELECT *, len(regexp_extract_all(line, '!')) AS shout, len(regexp_extract_all(line, '[#*$%&|<>]')) AS sym,
  len(list_filter(string_split_regex(line, '[\x20\x09]'), lambda x: regexp_full_match(x, '[|·»›>]+'))) AS menu,
  n <= 40 AND regexp_matches(line, '(?i)(\b(licen[sc]ed under|under the .{1,40} licen[sc]e|all rights reserved|copyright|\(c\) ?[0-9]{4}|privacy policy|terms of (use|service)|cookies?|enable javascript|subscribe (to|now)|sign up|log ?in|read more|click here)\b|spdx-licen[sc]e-identifier)') AS boiler,
  n > 40 AND 20 * len(regexp_extract_all(line, '(?i)(\b(licen[sc]ed under|under the .{1,40} licen[sc]e|all rights reserved|copyright|\(c\) ?[0-9]{4}|privacy policy|terms of (use|service)|cookies?|enable javascript|subscribe (to|now)|sign up|log ?in|read more|click here)\b|spdx-licen[sc]e-identifier)')) >= n AS notice,
  regexp_matches(line, '(?i)(\b(licen[sc]ed under|under the .{1,40} licen[sc]e)\b|spdx-licen[sc]e-identifier)') AS licence,
  regexp_matches(line, '[.!?…:;]["''”’»)\]]*([\x20\x09-\x0D]|\z)') AS ends FROM lines WHERE n > 0),
judged AS (SELECT doc_id, n, (menu >= 2 AND 5 * menu >= n) OR (sym * 5 > n AND n >= 3) OR (shout * 3 > n AND shout >= 3) AS junk,
  junk OR boiler OR (n > 3 AND NOT ends) OR notice AS fails, NOT junk AND boiler AND licence AS exempt FROM facts),
sums AS (SELECT doc_id, sum(n) FILTER (NOT fails) AS n_ok, sum(n) FILTER (fails AND NOT exempt) AS n_lost FROM judged GROUP BY 1),
base AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_ok, 0) AS n_ok, coalesce(n_lost, 0) AS n_lost
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN sums USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_ok >= 10 AND n_lost <= n_words * 0.5 AS kept FROM base""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.assess(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *[F.col(f"quality.{f}").alias(f) for f in fields])


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    taken = mixing.copies(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


@query("op7_warc", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record reads after writing deduplicated archives."""
    found = warc.deduplicated(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted between the separators of flat token files."""
    return tokens.document_tokens(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the passages that it shares with others and the spans of later copies that are removed."""
    return chunks.repeated_passages(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("op9_lm_scoring")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-model and byte-model scores of every document."""
    return ppm.scored(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html.extracted(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.spans(docs, pii.fit(docs))
    counts = [pii.n_of(F.col("base"), k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds a passage of, with the shares of item and answer found."""
    found = leaks.leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "covered", "answered")


@query("op11_token_id_output")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in indexed files of token ids, read back through the index."""
    found = idfiles.stored(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


@query("op12_importance_resampling", rf"""
WITH d AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d),
f AS (SELECT kind, r, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]),
  list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS feature FROM w),
n AS (SELECT kind, r, feature, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * strlen(feature), 2), lambda i: ('0x' || substr(hex(encode(feature)), i, 2))::BIGINT)),
  lambda c, x: xor(c >> 8, {_crc_table()}[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT feature FROM n)),
k AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t FROM n JOIN b USING (feature) GROUP BY 1),
a AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM k),
g AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM k, a),
x AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM n JOIN b USING (feature) JOIN g USING (bucket) WHERE kind = 0 GROUP BY 1),
y AS (SELECT id AS doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN x USING (r) WHERE kind = 0),
z AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 5 * count(*) // 100 FROM y WHERE n_words >= 20) THEN place END AS rank FROM z""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark, its score, and its rank if drawn."""
    found = resample.resampled(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


@query("op13_ranked_search", r"""
WITH p AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS l FROM p WHERE len(terms) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM p) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 100 - 90 + (90 * len(terms) * n_docs) // l AS m FROM p, s WHERE len(terms) > 0),
sc AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM sc JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    found = ranking.search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("query").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
