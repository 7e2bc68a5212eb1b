"""Text, vector and corpus jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plantlens.functions import text as tf
from plantlens.operators import segment, sentiment, split, text, vector_index, vectors
from plantlens.plans import catalog, datasets
from plantlens.plans.queries.base import norm, query
from plantlens.plans.queries.models import _HASH
from plantlens.session import scratch_path
from plantlens.sources import schemas


@query("T01_preprocess", "i:conv_id,turn s:clean", f"SELECT conv_id, turn, {norm('text')} AS clean FROM conversations")
def t01(spark, d):
    return catalog.table(spark, d, "conversations").select("conv_id", "turn", tf.normalise(F.col("text")).alias("clean"))


_TOKENS = f"tok AS (SELECT doc_id, unnest(string_split(lower({norm('text')}), ' ')) AS term FROM documents WHERE {norm('text')} <> '')"


def _bit(start: int, i: int) -> str:
    return f"avg(((('0x' || substr(md5(term), {start}, 15))::BIGINT >> {i}) & 1) * 2 - 1)"


@query("T02_embeddings", "i:doc_id,dims f4:first,last,other",
       f"""WITH {_TOKENS}, e AS (SELECT doc_id, {_bit(1, 0)} AS first, {_bit(1, 59)} AS last, {_bit(16, 0)} AS other FROM tok GROUP BY 1)
       SELECT d.doc_id, 64 AS dims, coalesce(first, 0) AS first, coalesce(last, 0) AS last, coalesce(other, 0) AS other FROM documents d LEFT JOIN e USING (doc_id)""")
def t02(spark, d):
    out = vectors.embed(catalog.corpus(spark, d), id_col="doc_id", text="text")
    e = F.col("embedding")
    return out.select("doc_id", F.size(e).alias("dims"), e[0].alias("first"), e[59].alias("last"), e[60].alias("other"))


_KEYWORDS = f"""{_TOKENS}, tf_ AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2), df_ AS (SELECT term, count(*) AS df FROM tf_ GROUP BY 1),
  sc AS (SELECT doc_id, term, round(tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1), 9) AS s FROM tf_ JOIN df_ USING (term)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, term) AS r FROM sc), kw AS (SELECT doc_id, string_agg(term, ' ' ORDER BY r) AS keywords, count(*) AS n FROM rk WHERE r <= 5 GROUP BY 1)"""


@query("T03_keywords", "i:doc_id s:keywords", f"WITH {_KEYWORDS} SELECT d.doc_id, coalesce(keywords, '') AS keywords FROM documents d LEFT JOIN kw USING (doc_id)")
def t03(spark, d):
    out = text.keywords(catalog.corpus(spark, d), id_col="doc_id", text="text")
    return out.withColumn("keywords", F.array_join("keywords", " "))


_JOINED = """seg AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS r FROM (SELECT DISTINCT c_mktsegment AS name FROM customer)),
  j AS (SELECT o_orderkey, x.name AS a, n_name AS b, y.name AS c FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN seg x ON x.r = o_orderkey // 5 % 5 JOIN seg y ON y.r = o_orderkey % 5)"""


def _joined(spark, d):
    """Orders with a segment, their nation and another segment written as one string without blanks."""
    orders, customer, nation = (catalog.table(spark, d, t) for t in ("orders", "customer", "nation"))
    number = (F.row_number().over(Window.orderBy("c_mktsegment")) - 1).alias("r")  # five rows
    names = customer.select("c_mktsegment").distinct().select("c_mktsegment", number)
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).drop("c_mktsegment")
    rows = rows.join(names.withColumnsRenamed({"c_mktsegment": "a", "r": "i"}), F.floor(F.col("o_orderkey") / 5) % 5 == F.col("i"))
    rows = rows.join(names.withColumnsRenamed({"c_mktsegment": "c", "r": "j"}), F.col("o_orderkey") % 5 == F.col("j"))
    return rows.select("o_orderkey", F.concat("a", "n_name", "c").alias("text"))


@query("T02_words_without_blanks", "i:o_orderkey s:words", f"WITH {_JOINED} SELECT o_orderkey, lower(a || ' ' || b || ' ' || c) AS words FROM j")
def t02_words(spark, d):
    """Segment and nation names found in strings without blanks by a lexicon learnt from these strings."""
    rows = _joined(spark, d).withColumn("text", F.lower("text"))
    words = segment.lexicon(rows, "text", chars="a-z0-9_", longest=14, min_cohesion=3.0, min_entropy=0.6)
    return segment.segmented(rows, "text", words, chars="a-z0-9_").select("o_orderkey", F.array_join("tokens", " ").alias("words"))


_CENTROID = """el AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  mean_ AS (SELECT label, i, avg(x) AS x FROM el GROUP BY 1, 2), cen AS (SELECT label, list(x ORDER BY i) AS c FROM mean_ GROUP BY 1),
  sim AS (SELECT vec_id, e.label AS own, cen.label, round(list_dot_product(embedding::DOUBLE[], c) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(c, c))), 12) AS s FROM embeddings e, cen)"""


@query("T04_classify", "i:vec_id s:category f:similarity",
       f"WITH {_CENTROID} SELECT vec_id, category, similarity FROM (SELECT vec_id, label AS category, s AS similarity, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS r FROM sim) WHERE r = 1")
def t04(spark, d):
    emb = catalog.table(spark, d, "embeddings")
    return vectors.classify(emb, vectors.centroids(emb, "label", "embedding"), embedding="embedding", label="label", vector="centroid")


_WORDS_P, _WORDS_N = ("the", "of", "la", "der"), ("and", "que", "und", "le")


def _hits(words) -> str:
    return f"len(list_filter(string_split(lower({norm('text')}), ' '), lambda w: w IN ({', '.join(repr(w) for w in words)})))"


_MOOD = "CASE WHEN p > n THEN '正面' WHEN p < n THEN '负面' ELSE '中性' END"


@query("T05_sentiment", "i:doc_id s:sentiment", f"SELECT doc_id, {_MOOD} AS sentiment FROM (SELECT doc_id, {_hits(_WORDS_P)} AS p, {_hits(_WORDS_N)} AS n FROM documents)")
def t05(spark, d):
    return text.sentiment(catalog.corpus(spark, d), "text", _WORDS_P, _WORDS_N)


@query("T05_sentiment_model", "i:doc_id f4:score s:sentiment")
def t05_model(spark, d):
    """Every text's label by a model of the labelled ones, whose quality stands for sentiment."""
    docs = catalog.corpus(spark, d).select("doc_id", "text")
    known = docs.join(catalog.table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return sentiment.classify(docs, sentiment.fit(known, text="text", label="quality"), text="text").select("doc_id", "score", "sentiment")


_LEX = (text.POSITIVE, text.NEGATIVE)


@query("T06_process_texts", "i:doc_id s:processed i:dims,keywords_n s:sentiment",
       f"WITH {_KEYWORDS} SELECT d.doc_id, md5({norm('d.text')}) AS processed, 16 AS dims, coalesce(n, 0) AS keywords_n, sentiment FROM documents d LEFT JOIN kw USING (doc_id) JOIN (SELECT doc_id, {_MOOD} AS sentiment FROM (SELECT doc_id, {_hits(_LEX[0])} AS p, {_hits(_LEX[1])} AS n FROM documents)) USING (doc_id)")
def t06(spark, d):
    out = datasets.process_texts(catalog.corpus(spark, d), id_col="doc_id", text_col="text", size=16)
    return out.select("doc_id", F.md5("processed_text").alias("processed"), F.size("embedding").alias("dims"), F.size("keywords").alias("keywords_n"), "sentiment")


@query("T07_vector_table", "i:id f:norm,first s:label",
       "SELECT vec_id AS id, 1.0 AS norm, embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS first, label FROM embeddings")
def t07(spark, d):
    path = scratch_path(spark, "vectors")
    vectors.build_index(catalog.table(spark, d, "embeddings"), id_col="vec_id", embedding="embedding", metadata=["label"]).write.parquet(path)
    return spark.read.parquet(path).select("id", F.sqrt(tf.dot(F.col("embedding"), F.col("embedding"))).alias("norm"), F.col("embedding")[0].alias("first"), F.col("metadata")["label"].alias("label"))


@query("T08_similarity_search", "i:query_id,id,rank f:similarity",
       f"WITH {_CENTROID} SELECT * FROM (SELECT label AS query_id, vec_id AS id, s AS similarity, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM sim) WHERE rank <= 5")
def t08(spark, d):
    emb = catalog.table(spark, d, "embeddings")
    queries = vectors.centroids(emb, "label", "embedding").select(F.col("label").alias("query_id"), F.col("centroid").alias("embedding"))
    return vectors.search(queries, vectors.build_index(emb, id_col="vec_id", embedding="embedding"), k=5)


_PAIR_SIM = "round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 12)"


@query("T08_index_search", "i:query_id,id,rank f:similarity",
       f"WITH sim AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_PAIR_SIM} AS s FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) SELECT * FROM (SELECT query_id, id, s AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM sim) WHERE rank <= 10")
def t08_index(spark, d):
    """Through stored inverted lists: the ten nearest of all rows for every row whose id is divisible by 100."""
    emb = catalog.table(spark, d, "embeddings")
    path = scratch_path(spark, "vector-index")
    vector_index.build(emb, id_col="vec_id", embedding="embedding").save(path)
    queries = emb.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_index.search(queries, vector_index.load(spark, path), k=10)


@query("L06_top_k_similar", "i:id f:similarity",
       """WITH el AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT list(x ORDER BY i) AS c FROM (SELECT i, avg(x) AS x FROM el GROUP BY 1))
       SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[], c) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(c, c))) AS similarity FROM embeddings, m ORDER BY round(similarity, 12) DESC, vec_id LIMIT 10""")
def l06(spark, d):
    emb = catalog.table(spark, d, "embeddings")
    centre = vectors.centroids(emb.withColumn("all", F.lit(0)), "all", "embedding").first()["centroid"]
    query_vector = F.array(*[F.lit(x) for x in centre])
    return emb.select(F.col("vec_id").alias("id"), tf.cosine(F.col("embedding"), query_vector).alias("similarity")).orderBy(
        F.desc(F.round("similarity", 12)), "id").limit(10)


def _pairs(spark, d):
    """User turns with the assistant turn that follows them."""
    talk = catalog.table(spark, d, "conversations")
    ask = talk.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("context"))
    reply = talk.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return ask.join(reply, ["conv_id", "turn"])


_PAIRS = """pairs AS (SELECT a.conv_id, a.turn, a.text AS context, b.text AS prediction FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""
_BOTH = "length(trim(coalesce(context, ''))) > 0 AND length(trim(coalesce(prediction, ''))) > 0"


@query("T09_instruction_pairs", "i:conv_id,turn s:instruction,response",
       f"WITH {_PAIRS} SELECT conv_id, turn, replace(replace('{text.FORECAST_INSTRUCTION}', chr(10), chr(10)), '{{context}}', context) AS instruction, replace('{text.FORECAST_RESPONSE}', '{{prediction}}', prediction) AS response FROM pairs WHERE {_BOTH}")
def t09(spark, d):
    return text.forecast_pairs(_pairs(spark, d), keep=["conv_id", "turn"])


@query("T09_nl2sql_pairs", "s:instruction,response",
       f"WITH {_PAIRS} SELECT replace(replace('{text.NL2SQL_INSTRUCTION}', '{{schema}}', 'supplier(s_suppkey, s_name)'), '{{question}}', context) AS instruction, replace('{text.NL2SQL_RESPONSE}', '{{sql}}', prediction) AS response FROM pairs WHERE {_BOTH}")
def t09_nl2sql(spark, d):
    rows = _pairs(spark, d).withColumnsRenamed({"context": "natural_language", "prediction": "sql_query"})
    return text.nl2sql_pairs(rows, "supplier(s_suppkey, s_name)")


@query("T10_training_text", "i:conv_id,turn s:text", f"WITH {_PAIRS} SELECT conv_id, turn, '指令: ' || context || chr(10) || chr(10) || '回答: ' || prediction AS text FROM pairs")
def t10(spark, d):
    return text.training_text(_pairs(spark, d).withColumnsRenamed({"context": "instruction", "prediction": "response"}))


@query("T11_nl2sql_dataset", "s:natural_language,sql_query,db_schema", f"WITH {_PAIRS} SELECT context AS natural_language, prediction AS sql_query, 'schema' AS db_schema FROM pairs WHERE {_BOTH}")
def t11(spark, d):
    return text.nl2sql_dataset(_pairs(spark, d).withColumnsRenamed({"context": "natural_language", "prediction": "sql_query"}), "schema")


@query("T11_speech_dataset", "i:doc_id s:digest,domain", "SELECT doc_id, md5(text) AS digest, CASE WHEN lang = 'en' THEN 'general' ELSE lang END AS domain FROM documents WHERE length(trim(coalesce(text, ''))) > 0")
def t11_speech(spark, d):
    docs = catalog.table(spark, d, "documents").withColumn("domain", F.nullif("lang", F.lit("en")))
    return text.speech_dataset(docs, keep=["doc_id"]).withColumn("digest", F.md5("text"))


_CORRUPT = r"([^ ]*er[^ ]*)"


@query("T12_error_rates", "i:char_edits,chars,word_edits,words f:cer,wer",
       f"""WITH t AS (SELECT {norm('text')} AS r, regexp_replace({norm('text')}, '{_CORRUPT}', '{chr(92)}1#', 'g') AS h FROM benchmark),
       s AS (SELECT sum(levenshtein(r, h)) AS char_edits, sum(length(r)) AS chars, sum(len(list_filter(string_split(h, ' '), lambda w: contains(w, '#')))) AS word_edits, sum(len(string_split(r, ' '))) AS words FROM t)
       SELECT *, char_edits / chars AS cer, word_edits / words AS wer FROM s""")
def t12(spark, d):
    rows = catalog.corpus(spark, d, "benchmark").withColumn("hyp", F.regexp_replace(tf.normalise(F.col("text")), _CORRUPT, "$1#"))
    return text.error_rates(rows, ref="text", hyp="hyp")


@query("T13_corpus_split", "i:doc_id s:split",
       f"WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY {_HASH.format(key='doc_id')}, doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN r <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM k")
def t13(spark, d):
    return split.random(catalog.table(spark, d, "documents").select("doc_id", "text"), key="doc_id", features=[])


@query("T14_truncate", "i:doc_id,tokens s:digest",
       f"SELECT doc_id, least(512, len(string_split({norm('text')}, ' '))) AS tokens, md5(array_to_string(string_split({norm('text')}, ' ')[1:512], ' ')) AS digest FROM documents")
def t14(spark, d):
    cut = tf.truncate_tokens(F.col("text"))
    return catalog.corpus(spark, d).select("doc_id", F.size(F.split(cut, " ")).alias("tokens"), F.md5(cut).alias("digest"))


@query("T15_generation_evaluation", "i:n f:exact_match i:char_edits,chars", """
  WITH g AS (SELECT role AS reference, CASE WHEN turn % 2 = 0 THEN role ELSE 'x' || role END AS answer FROM conversations)
  SELECT count(*) AS n, avg(CASE WHEN answer = reference THEN 1.0 ELSE 0.0 END) AS exact_match, sum(levenshtein(reference, answer)) AS char_edits, sum(length(reference)) AS chars FROM g""")
def t15(spark, d):
    talk = catalog.table(spark, d, "conversations")
    answer = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(F.concat(F.lit("x"), "role"))
    rows = talk.select(F.col("role").alias("reference"), F.concat("text", F.lit("\n" + text.ANSWER_MARKER), answer).alias("generated"))
    return text.evaluate_generations(rows, reference="reference", generated="generated")


_ANSWERS = """CASE conv_id % 4 WHEN 0 THEN '```sql\\nSELECT STEAMER_NAME FROM TB_STEAMER WHERE STEAMER_ID = ' || turn || '\\n```'
  WHEN 1 THEN 'SELECT missing_column FROM TB_STEAMER;' WHEN 2 THEN 'SELECT broken FROM TB_STEAMER;' ELSE text END"""


@query("T16_validate_corpus", "i:total,valid f:ratio", "SELECT count(*) AS total, count(*) FILTER (WHERE conv_id % 4 < 2) AS valid, avg(CASE WHEN conv_id % 4 < 2 THEN 1.0 ELSE 0.0 END) AS ratio FROM conversations")
def t16(spark, d):
    schemas.register(spark, {"TB_STEAMER": catalog.units(spark, d).withColumnsRenamed({"unit_id": "STEAMER_ID", "unit_name": "STEAMER_NAME"})})
    rows = catalog.table(spark, d, "conversations").withColumn("response", F.expr(_ANSWERS)).withColumn(
        "fixed", F.when(F.col("conv_id") % 4 == 1, "SELECT STEAMER_NAME FROM TB_STEAMER;").otherwise(F.col("response")))
    return text.validity_ratio(text.validate_corpus(rows, response="response", fixed="fixed"))


@query("T17_run_sql", "s:type i:n", "SELECT CASE s_suppkey % 4 WHEN 0 THEN '燃煤机' WHEN 1 THEN '燃气机' WHEN 2 THEN '风电' ELSE '光电' END AS type, count(*) AS n FROM supplier GROUP BY 1")
def t17(spark, d):
    schemas.register(spark, {"TB_STEAMER": catalog.units(spark, d).withColumnsRenamed({"unit_id": "STEAMER_ID", "unit_type": "STEAMER_TYPE"})})
    return text.run_sql(spark, "SELECT STEAMER_TYPE AS type, count(*) AS n FROM TB_STEAMER GROUP BY STEAMER_TYPE;")[0]
