"""Requests made of `conversations`, routed, validated, billed and answered."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import encode, rank, requests, respond
from ..sources import dialects
from .common import plain, shared, table

#: name, task, dimension, token limit, place in the configuration.
MODELS = (("embed-small", "embed", 3, 20, 0), ("rank-small", "rerank", None, 20, 1), ("embed-large", "embed", 64, 512, 2))
MODELS_SQL = "SELECT * FROM (VALUES ('embed-small', 'embed', 3, 20, 0), ('rank-small', 'rerank', CAST(NULL AS INT), 20, 1), ('embed-large', 'embed', 64, 512, 2)) AS m(name, task, dimension, max_input_tokens, place)"

# one row a turn; small whole numbers decide what is wrong with it
_BASE = """
SELECT conv_id * 100 + turn AS request_id, text, role, CAST(1 + turn % 2 AS INT) AS version,
  CASE CAST((conv_id + turn) % 9 AS INT) WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'rank-small' WHEN 3 THEN 'nobody' ELSE 'embed-small' END AS model,
  CAST((conv_id * 7 + turn) % 13 AS INT) AS k, CAST((conv_id * 3 + turn) % 11 AS INT) AS j
FROM {conversations}"""


def _requests(spark, sf_dir):
    return shared(spark, sf_dir, _BASE, "conversations")


def _models(spark):
    return spark.sql(MODELS_SQL)


_SQL = f"r AS ({plain(_BASE, 'conversations')}), m AS ({MODELS_SQL})"


def validate_cohere(spark, sf_dir):
    k, j, s = F.col("k"), F.col("j"), lambda v: F.lit(v).cast("string")
    null_text = F.lit(None).cast("string")
    content = F.array(F.struct(F.when(k == 8, "image_url").otherwise("text").alias("type"), F.when(k == 9, null_text).otherwise(F.col("text")).alias("text")))
    inputs = F.when(k.isin(8, 9, 10), F.array(F.struct(F.when(k == 10, F.array_repeat(F.element_at(content, 1), 2)).otherwise(content).alias("content"))))
    made = _requests(spark, sf_dir).select(
        "request_id", "version", "model",
        F.when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array("text", null_text)).when(~k.isin(8, 9, 10), F.array("text", "role")).alias("texts"),
        inputs.alias("inputs"),
        F.when(k == 0, F.array(F.lit("x"))).alias("images"),
        F.when(j == 1, "image").when(j == 2, "Search_Query").when(j > 7, "search_query").alias("input_type"),
        F.when(j == 3, F.array(F.lit("float"), F.lit("int8"))).when(j == 9, F.array(F.lit("float"))).alias("embedding_types"),
        F.when(j == 4, 256).when(j == 8, 3).alias("output_dimension"), F.when(j == 5, 5).when(j == 10, 20).alias("max_tokens"),
        F.when(j == 6, "start").when(j == 7, "MIDDLE").when(j == 8, "none").alias("truncate"),
        F.greatest(F.when(F.char_length("text") > encode.LIMIT, 0).otherwise(-1), F.lit(-1)).alias("first_truncated"),
    )
    checked = requests.route(made, _models(spark), "embed").withColumn("v", requests.validate_embed())
    late = requests.refuse_truncation("cohere")
    return checked.select("request_id", F.when((F.col("v.status") == 200) & late.isNotNull(), 400).otherwise(F.col("v.status")).alias("status"), F.coalesce("v.message", late).alias("message"))


# two models embed, so version 1 has no default
VALIDATE_COHERE = f"""
WITH {_SQL}, t AS (SELECT r.*, CASE WHEN trim(coalesce(model, '')) <> '' THEN model END AS asked FROM r), c AS (
SELECT request_id, CASE
  WHEN asked IS NULL THEN '400 model is required'
  WHEN asked = 'rank-small' THEN '400 model ''rank-small'' does not support embed'
  WHEN asked = 'nobody' THEN '404 model ''nobody'' not found'
  WHEN k = 0 THEN '400 image inputs are not supported'
  WHEN k IN (8, 9, 10) AND version = 1 THEN '400 inputs is a v2 field: use texts'
  WHEN k = 10 THEN '400 inputs[0] must hold exactly one text content part'
  WHEN k = 8 THEN '400 inputs[0]: only text content is supported'
  WHEN k = 9 THEN '400 inputs[0] has no text'
  WHEN k = 1 THEN '400 texts must not be empty'
  WHEN k = 2 THEN '400 texts[1] is null'
  WHEN j = 1 THEN '400 image inputs are not supported'
  WHEN j = 2 THEN '400 invalid input_type ''Search_Query'', expected one of [search_document, search_query, classification, clustering]'
  WHEN j = 3 THEN '400 embedding type ''int8'' is not supported, only float'
  WHEN j = 4 THEN '400 output_dimension 256 is not available: model ''embed-small'' produces 3 dimensions'
  WHEN j = 5 THEN '400 max_tokens below the model limit (20) is not supported'
  WHEN j = 6 THEN '400 truncate START is not supported, use END or NONE'
  WHEN j = 7 THEN '400 invalid truncate ''MIDDLE'', expected NONE, START or END'
  WHEN j = 8 AND length(text) > 20 THEN '400 texts[0] exceeds the model limit of 20 tokens and truncate is NONE'
  ELSE '200 ' END AS x FROM t)
SELECT request_id, CAST(x[1:3] AS INTEGER) AS status, nullif(x[5:], '') AS message FROM c"""


def validate_rerank(spark, sf_dir):
    k = F.col("k")
    made = _requests(spark, sf_dir).select(
        "request_id", "version", F.when(F.col("model") == "embed-small", F.when(F.col("j") == 0, "embed-small").otherwise("rank-small")).when(F.col("model") == "rank-small", F.lit(None)).otherwise(F.col("model")).alias("model"),
        F.when(k != 0, F.col("role")).alias("query"), F.when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array("text", F.lit(None).cast("string"))).when(k != 3, F.array("text", "role", "text")).alias("documents"),
        F.when(k == 4, F.array(F.lit("title"))).alias("rank_fields"), F.when(k == 5, 19).when(k == 6, 20).alias("max_tokens_per_doc"), F.when(k == 7, 0).when(k == 8, 2).when(k == 9, 100).alias("top_n"),
    )
    checked = requests.route(made, _models(spark), "rerank").withColumn("v", requests.validate_rerank())
    return checked.select("request_id", "v.status", "v.message", F.when(F.col("v.status") == 200, requests.effective_top_n()).otherwise(0).alias("top_n"))


VALIDATE_RERANK = f"""
WITH {_SQL}, n AS (SELECT *, CASE WHEN model = 'embed-small' THEN CASE WHEN j = 0 THEN 'embed-small' ELSE 'rank-small' END WHEN model = 'rank-small' THEN NULL ELSE model END AS given FROM r),
t AS (SELECT *, CASE WHEN trim(coalesce(given, '')) <> '' THEN given WHEN version = 1 THEN 'rank-small' END AS asked FROM n), c AS (
SELECT request_id, k, CASE
  WHEN asked IS NULL THEN '400 model is required'
  WHEN asked = 'embed-small' THEN '400 model ''embed-small'' does not support rerank'
  WHEN asked = 'nobody' THEN '404 model ''nobody'' not found'
  WHEN k = 0 THEN '400 query is required'
  WHEN k IN (1, 3) THEN '400 documents must not be empty'
  WHEN k = 2 THEN '400 documents[1] has no text'
  WHEN k = 4 THEN '400 rank_fields is not supported: pass the text to rank as a string or in a text field'
  WHEN k = 5 THEN '400 max_tokens_per_doc below the model limit (20) is not supported'
  WHEN k = 7 THEN '400 top_n must be at least 1'
  ELSE '200 ' END AS x FROM t)
SELECT request_id, CAST(x[1:3] AS INTEGER) AS status, nullif(x[5:], '') AS message, CAST(CASE WHEN x = '200 ' THEN CASE WHEN k = 8 THEN 2 ELSE 3 END ELSE 0 END AS INTEGER) AS top_n FROM c"""


def validate_openai(spark, sf_dir):
    k = F.col("k")
    made = _requests(spark, sf_dir).select(
        "request_id", F.lit(2).alias("version"), "model", F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array("text", F.lit(""))).when(k == 2, F.array(F.lit(None).cast("string"))).otherwise(F.array("text")).alias("input"),
        F.when(k == 3, "int8").when(k == 4, "base64").alias("encoding_format"), F.when(k == 5, 2).when(k == 6, 3).alias("dimensions"), F.when(F.char_length("text") > encode.LIMIT, 0).otherwise(-1).alias("first_truncated"),
    )
    checked = requests.route(made, _models(spark), "embed").withColumn("v", requests.validate_openai())
    late = requests.refuse_truncation("openai")
    status = F.when((F.col("v.status") == 200) & late.isNotNull(), 400).otherwise(F.col("v.status"))
    return checked.select("request_id", status.alias("status"), F.coalesce("v.message", late).alias("message"), "v.code")


VALIDATE_OPENAI = f"""
WITH {_SQL}, c AS (
SELECT request_id, CASE
  WHEN trim(coalesce(model, '')) = '' THEN '400 model is required'
  WHEN model = 'rank-small' THEN '400 model ''rank-small'' does not support embeddings'
  WHEN model = 'nobody' THEN '404 The model ''nobody'' does not exist'
  WHEN k = 0 THEN '400 input must not be empty'
  WHEN k = 1 THEN '400 input[' || (CASE WHEN text = '' THEN 0 ELSE 1 END) || '] must be a non-empty string'
  WHEN k = 2 OR text = '' THEN '400 input[0] must be a non-empty string'
  WHEN k = 3 THEN '400 encoding_format must be float or base64, got ''int8'''
  WHEN k = 5 THEN '400 dimensions 2 is not available: model ''embed-small'' produces 3 dimensions'
  WHEN length(text) > 20 THEN '400 input[0] exceeds the maximum context length of 20 tokens'
  ELSE '200 ' END AS x FROM r)
SELECT request_id, CAST(x[1:3] AS INTEGER) AS status, nullif(x[5:], '') AS message, CASE WHEN x[1:3] = '404' THEN 'model_not_found' END AS code FROM c"""


def model_routing(spark, sf_dir):
    out = requests.route(_requests(spark, sf_dir), _models(spark), "rerank")
    return out.select("request_id", "requested", "name", "exists")


ROUTING = f"""
WITH {_SQL}, t AS (SELECT *, CASE WHEN trim(coalesce(model, '')) <> '' THEN model WHEN version = 1 THEN 'rank-small' END AS requested FROM r)
SELECT request_id, requested, m.name, requested IN (SELECT name FROM m) AND requested IS NOT NULL AS exists FROM t LEFT JOIN m ON m.name = requested AND m.task = 'rerank'"""


def models_list(spark, sf_dir):
    """Embedders first, each kind in the order of the configuration; names of both kinds are kept, equal ones too."""
    from pyspark.sql import Window

    m = _models(spark)
    both = m.where("task = 'embed'").withColumn("kind", F.lit(0)).unionAll(m.where("task = 'rerank'").withColumn("kind", F.lit(1)))
    w = Window.orderBy("kind", "place")  # a configuration's few rows
    return both.select((F.row_number().over(w) - 1).alias("place"), F.col("name").alias("id"), F.lit("model").alias("object"))


def duplicate_models(spark, sf_dir):
    m = _models(spark).select("name").unionAll(_models(spark).where("place = 1").select("name"))
    return m.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def billing_units(spark, sf_dir):
    """Tokens of an embedding request and units of a rerank request over a conversation's texts as documents."""
    t = table(spark, sf_dir, "conversations")
    return t.groupBy("conv_id").agg(F.sum(encode.stand_in_tokens(F.col("text"))).cast("long").alias("input_tokens"), (F.count("*") * encode.PER_DOCUMENT).alias("rerank_tokens"), rank.search_units(F.count("*") * 60).alias("search_units"))


def embed_fake(spark, sf_dir):
    """The stand-in's vectors and totals, the first truncated text by turn."""
    t = encode.embed(table(spark, sf_dir, "conversations"), "text").withColumn("cut", encode.stand_in_truncated(F.col("text")))
    return t.groupBy("conv_id").agg(
        F.sum(F.get("vector", F.lit(0)).cast("double")).alias("first_components"), F.sum(encode.stand_in_tokens(F.col("text"))).cast("long").alias("prompt_tokens"), F.coalesce(F.min(F.when(F.col("cut"), F.col("turn"))), F.lit(-1)).alias("first_truncated")
    )


def bearer_check(spark, sf_dir):
    """Requests whose key is known; the role is the key, the scheme's case and space around the key vary."""
    made = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 4 == 0, F.concat(F.lit("bearer  "), "role", F.lit(" "))).when(F.col("turn") % 4 == 1, F.concat(F.lit("Bearer "), "role")).when(F.col("turn") % 4 == 2, F.col("role")).alias("header")
    )
    keys = spark.sql("SELECT sha2(k, 256) AS digest FROM VALUES ('user'), ('system') AS t(k)")
    return requests.authorized(made, keys, "header").select("conv_id", "turn", "header")


BEARER = """
WITH a AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'bearer  ' || role || ' ' WHEN 1 THEN 'Bearer ' || role WHEN 2 THEN role END AS header FROM conversations)
SELECT * FROM a WHERE lower(substring(header, 1, 7)) = 'bearer ' AND sha256(trim(substring(header, 8))) IN (sha256('user'), sha256('system'))"""


def api_keys(spark, sf_dir):
    """Configured keys and those of an environment variable, trimmed, empty ones dropped, equal ones kept."""
    configured = spark.sql("SELECT k AS api_key FROM VALUES ('a'), ('b') AS t(k)")
    env = spark.sql("SELECT ' b, ,c ,' AS v").select(F.explode(scalars.split_list(F.col("v"))).alias("api_key")).where("api_key <> ''")
    return configured.unionAll(env)


def response_parse(spark, sf_dir):
    """Scores from responses of either dialect, listed by rank, back in document order."""
    t = table(spark, sf_dir, "conversations").select("conv_id", F.char_length("text").alias("n"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("place"))
    # the response, as a server would render it: longest text first
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), (F.col("place") - 1).alias("index"), F.col("n"))))
    grouped = t.groupBy("conv_id").agg(items.alias("items"), F.count("*").alias("documents"))
    named = F.to_json(F.struct(F.transform("items", lambda x: F.struct(x["index"].alias("index"), x["n"].alias("relevance_score"))).alias("results")))
    bare = F.to_json(F.transform("items", lambda x: F.struct(x["index"].alias("index"), x["n"].alias("score"))))
    bodies = grouped.select("conv_id", "documents", F.when(F.col("conv_id") % 2 == 0, named).otherwise(bare).alias("body"))
    parsed = dialects.scores(bodies, "body", "documents")
    return parsed.select("conv_id", F.posexplode("scores").alias("place", "score")).select("conv_id", "place", F.col("score").cast("double").alias("score"))


def embedding_responses(spark, sf_dir):
    """Vectors from responses of eight, listed last first, back in order."""
    t = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - F.pmod("vec_id", F.lit(8))).alias("response"), F.pmod("vec_id", F.lit(8)).alias("index"), "embedding")
    data = F.reverse(F.array_sort(F.collect_list(F.struct("index", "embedding"))))
    bodies = t.groupBy("response").agg(F.to_json(F.struct(data.alias("data"))).alias("body"))
    found = dialects.embeddings(bodies, "body").select("response", F.posexplode("vectors").alias("place", "vector"))
    return found.select("response", "place", F.size("vector").alias("width"), F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"), F.round(F.element_at("vector", -1).cast("double"), 6).alias("last"))


EMBEDDING_RESPONSES = """
SELECT vec_id - vec_id % 8 AS response, CAST(row_number() OVER (PARTITION BY vec_id - vec_id % 8 ORDER BY vec_id) - 1 AS INTEGER) AS place, CAST(len(embedding) AS INTEGER) AS width,
  round(CAST(embedding[1] AS DOUBLE), 6) AS "first", round(CAST(embedding[-1] AS DOUBLE), 6) AS "last" FROM embeddings"""


def malformed_bodies(spark, sf_dir):
    """Bodies cut off behind their middle are no JSON; whole ones are, whatever else they hold."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.array("role").alias("texts"), F.col("turn").alias("unknown"))).alias("whole"))
    cut = F.when(F.col("turn") % 3 == 1, F.substring("whole", 1, 8)).otherwise(F.col("whole"))
    out = requests.parse(t.select("conv_id", "turn", cut.alias("body")), requests.EMBED)
    return out.select("conv_id", "turn", "malformed", F.when(~F.col("malformed"), F.get("texts", F.lit(0))).alias("text"))


def error_statuses(spark, sf_dir):
    """Statuses and bodies of kinds of failure, one a turn."""
    kind = F.get(F.array(*[F.lit(k) for k in ("overloaded", "illegal_argument", "illegal_state", "unauthorized", "other")]), F.pmod("turn", F.lit(5)).cast("int"))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", respond.status_of(kind).alias("status"))
    body = respond.openai_error_body(F.col("status"), F.col("turn").cast("string"), F.when(F.col("status") == 401, "invalid_api_key"))
    return t.select("conv_id", "turn", "status", body.alias("body"))


ERRORS = """
WITH e AS (SELECT conv_id, turn, CAST(CASE turn % 5 WHEN 0 THEN 503 WHEN 1 THEN 400 WHEN 2 THEN 503 WHEN 3 THEN 401 ELSE 500 END AS INTEGER) AS status FROM conversations)
SELECT conv_id, turn, status, '{"error":{"message":"' || turn || '","type":"' || CASE WHEN status >= 500 THEN 'server_error' ELSE 'invalid_request_error' END || '","param":null,"code":' || CASE WHEN status = 401 THEN '"invalid_api_key"' ELSE 'null' END || '}}' AS body FROM e"""


def rerank_responses(spark, sf_dir):
    """Whole response bodies of the stand-in's ranking of a conversation's texts, two best each."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").alias("score"))
    n = t.groupBy("conv_id").agg(F.count("*").alias("n"))
    best = rank.ranked(t, "conv_id", "turn", "score", 2).join(n, "conv_id")
    return respond.rerank_body(best, "conv_id", "turn", "score", F.col("n"), F.col("n") * encode.PER_DOCUMENT, F.lit(2))


RESPONSES = """
WITH r AS (SELECT conv_id, turn, length(text) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, '{"id":' || conv_id || ',"results":[' || string_agg('{"index":' || turn || ',"relevance_score":' || score || '}', ',' ORDER BY rank) || '],"meta":{"api_version":{"version":"2"},"billed_units":{"search_units":' || (max(n) + 99) // 100 || '},"tokens":{"input_tokens":' || max(n) * 10 || '}}}' AS body
FROM r WHERE rank <= 2 GROUP BY conv_id"""

QUERIES = {
    "validate_cohere": (validate_cohere, VALIDATE_COHERE), "validate_rerank": (validate_rerank, VALIDATE_RERANK), "validate_openai": (validate_openai, VALIDATE_OPENAI), "model_routing": (model_routing, ROUTING),
    "models_list": (models_list, f"SELECT CAST(row_number() OVER (ORDER BY task, place) - 1 AS INTEGER) AS place, name AS id, 'model' AS object FROM ({MODELS_SQL})"),
    "duplicate_models": (duplicate_models, f"SELECT name, count(*) AS n FROM (SELECT name FROM ({MODELS_SQL}) UNION ALL SELECT 'rank-small') GROUP BY name HAVING count(*) > 1"),
    "billing_units": (billing_units, "SELECT conv_id, CAST(sum(least(length(text), 20)) AS BIGINT) AS input_tokens, count(*) * 10 AS rerank_tokens, CAST((count(*) * 60 + 99) // 100 AS BIGINT) AS search_units FROM conversations GROUP BY conv_id"),
    "embed_fake": (embed_fake, "SELECT conv_id, CAST(sum(length(text)) AS DOUBLE) AS first_components, CAST(sum(least(length(text), 20)) AS BIGINT) AS prompt_tokens, coalesce(min(turn) FILTER (WHERE length(text) > 20), -1) AS first_truncated FROM conversations GROUP BY conv_id"),
    "bearer_check": (bearer_check, BEARER),
    "api_keys": (api_keys, "SELECT unnest(['a', 'b', 'b', 'c']) AS api_key"),
    "response_parse": (response_parse, "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS place, CAST(length(text) AS DOUBLE) AS score FROM conversations"),
    "embedding_responses": (embedding_responses, EMBEDDING_RESPONSES),
    "malformed_bodies": (malformed_bodies, "SELECT conv_id, turn, turn % 3 = 1 AS malformed, CASE WHEN turn % 3 <> 1 THEN role END AS text FROM conversations"),
    "error_statuses": (error_statuses, ERRORS),
    "rerank_responses": (rerank_responses, RESPONSES),
}
