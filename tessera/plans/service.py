"""Whole routes: request bodies in, response bodies out, each row with its own status.

Rows of requests are (request_id, version, body), models are (name, task, dimension, max_input_tokens). The scorer and
the encoder are columns of the stand-in unless others are given. A request's texts are spread over rows between parsing and
the response, so one large request does not hold up a task until its response is put together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import encode, rank, requests, respond

Vector = Callable[[Column], Column]


def _checked(bodies: DataFrame, models: DataFrame, task: str, schema: str, rules: Callable[[], Column]) -> DataFrame:
    """Parsed, routed and validated, with the verdict in `v`; a malformed body fails first."""
    parsed = requests.parse(bodies, schema)
    routed = requests.route(parsed, models, task).withColumn("v", rules())
    malformed = F.struct(F.lit(400).alias("status"), F.lit("invalid request body").alias("message"))
    return routed.withColumns({"status": F.when(F.col("malformed"), malformed["status"]).otherwise(F.col("v.status")), "message": F.when(F.col("malformed"), malformed["message"]).otherwise(F.col("v.message"))})


def _texts(good: DataFrame, texts: Column, vector: Vector) -> DataFrame:
    """Vectors and totals of each request's texts."""
    rows = good.select("request_id", F.posexplode(texts).alias("idx", "text"))
    cut = encode.stand_in_truncated(F.col("text"))
    rows = rows.select("request_id", "idx", "text", respond.check_finite(vector(F.col("text"))).alias("vector"), encode.stand_in_tokens(F.col("text")).alias("n"), F.when(cut, F.col("idx")).alias("cut"))
    item = F.array_sort(F.collect_list(F.struct("idx", "text", "vector")))
    return rows.groupBy("request_id").agg(item.alias("items"), F.sum("n").cast("long").alias("tokens"), F.coalesce(F.min("cut"), F.lit(-1)).alias("first_truncated"))


def embed(bodies: DataFrame, models: DataFrame, vector: Vector = encode.stand_in_vector) -> DataFrame:
    """(request_id, status, body)."""
    checked = _checked(bodies, models, "embed", requests.EMBED, requests.validate_embed)
    texts = F.coalesce("texts", F.transform("inputs", lambda x: F.get(x["content"], F.lit(0))["text"]))
    done = _texts(checked.where("status = 200"), texts, vector)
    out = checked.join(done, "request_id", "left")
    late = requests.refuse_truncation("cohere")
    status = F.when((F.col("status") == 200) & late.isNotNull(), 400).otherwise(F.col("status"))
    body = respond.embed_body(F.col("request_id"), F.col("version"), F.coalesce(F.size("embedding_types") > 0, F.lit(False)), F.transform("items", lambda x: x["vector"]), F.transform("items", lambda x: x["text"]), F.col("tokens"))
    return out.select("request_id", status.alias("status"), F.when(status == 200, body).otherwise(respond.error_body(F.col("request_id"), F.coalesce("message", late))).alias("body"))


def rerank(bodies: DataFrame, models: DataFrame, score: Callable[[Column, Column], Column] = encode.stand_in_score) -> DataFrame:
    """(request_id, status, body); documents may be strings or objects with a text."""
    parsed = requests.RERANK.replace("documents array<string>, ", "")
    with_documents = bodies.withColumn("documents", requests.document_texts(F.col("body")))
    checked = _checked(with_documents, models, "rerank", parsed, requests.validate_rerank)
    good = checked.where("status = 200").withColumns({"top": requests.effective_top_n(), "n": F.size("documents"), "shown": F.coalesce("return_documents", F.lit(False))})
    rows = good.select("request_id", "version", "top", "n", "shown", "query", F.posexplode("documents").alias("index", "text"))
    scored = rows.select("request_id", "version", "top", "n", "shown", "index", "text", score(F.col("query"), F.col("text")).alias("score"))
    best = rank.ranked(scored, "request_id", "index", "score", F.col("top"))
    best = best.withColumn("document", F.when(F.col("shown"), F.col("text")))
    plain = respond.rerank_body(best.where(~F.col("shown")), "request_id", "index", "score", F.col("n"), F.col("n") * encode.PER_DOCUMENT, F.col("version"))
    full = respond.rerank_body(best.where("shown"), "request_id", "index", "score", F.col("n"), F.col("n") * encode.PER_DOCUMENT, F.col("version"), "document")
    good_bodies = plain.unionAll(full).withColumnRenamed("body", "answer")
    return checked.join(good_bodies, "request_id", "left").select("request_id", "status", F.coalesce("answer", respond.error_body(F.col("request_id"), F.col("message"))).alias("body"))


def openai(bodies: DataFrame, models: DataFrame, vector: Vector = encode.stand_in_vector) -> DataFrame:
    """(request_id, status, body); vectors are floats or Base64 of them."""
    from ..functions.vectors import base64_floats

    texts, bad = requests.input_texts(F.col("body"))
    rest = requests.OPENAI.replace("input array<string>, ", "")
    checked = _checked(bodies.withColumns({"input": texts, "bad": bad}).withColumn("version", F.lit(2)), models, "embed", rest, requests.validate_openai)
    shape = ~F.col("malformed") & F.col("bad").isNotNull()
    checked = checked.withColumns({"message": F.when(shape, F.concat(F.lit("invalid request body: "), "bad")).otherwise(F.col("message")), "status": F.when(shape, 400).otherwise(F.col("status"))})
    done = _texts(checked.where("status = 200"), F.col("input"), vector)
    coded = done.select("request_id", F.posexplode("items").alias("index", "x")).select("request_id", "index", base64_floats(F.col("x.vector")).alias("s"))
    coded = coded.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "s"))), lambda x: x["s"]).alias("coded"))
    out = checked.join(done, "request_id", "left").join(coded, "request_id", "left")
    late = requests.refuse_truncation("openai")
    status = F.when((F.col("status") == 200) & late.isNotNull(), 400).otherwise(F.col("status"))
    body = F.when(F.col("encoding_format") == "base64", respond.openai_body(F.col("requested"), F.col("coded"), F.col("tokens"))).otherwise(respond.openai_body(F.col("requested"), F.transform("items", lambda x: x["vector"]), F.col("tokens")))
    code = F.when(F.col("status") == 404, F.col("v.code"))
    return out.select("request_id", status.alias("status"), F.when(status == 200, body).otherwise(respond.openai_error_body(status, F.coalesce("message", late), code)).alias("body"))
