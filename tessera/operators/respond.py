"""Response bodies and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import search_units


def meta(version: Column, tokens: Column, unit: str, billed: Column) -> Column:
    return F.struct(F.struct(version.cast("string").alias("version")).alias("api_version"), F.struct(billed.alias(unit)).alias("billed_units"), F.struct(tokens.alias("input_tokens")).alias("tokens"))


def embed_body(request: Column, version: Column, by_type: Column, vectors: Column, texts: Column, tokens: Column) -> Column:
    """Version 1 without types has the matrix itself; version 1 with types names its shape; version 2 has floats by type."""
    tail = (texts.alias("texts"), meta(version, tokens, "input_tokens", tokens).alias("meta"))
    plain = F.to_json(F.struct(request.alias("id"), F.lit("embeddings_floats").alias("response_type"), vectors.alias("embeddings"), *tail))
    typed = F.to_json(F.struct(request.alias("id"), F.when(version == 1, "embeddings_by_type").alias("response_type"), F.struct(vectors.alias("float")).alias("embeddings"), *tail))
    return F.when((version == 1) & ~by_type, plain).otherwise(typed)


def openai_body(model: Column, vectors: Column, tokens: Column) -> Column:
    items = F.transform(vectors, lambda v, i: F.struct(F.lit("embedding").alias("object"), i.alias("index"), v.alias("embedding")))
    return F.to_json(F.struct(F.lit("list").alias("object"), items.alias("data"), model.alias("model"), F.struct(tokens.alias("prompt_tokens"), tokens.alias("total_tokens")).alias("usage")))


def check_finite(v: Column) -> Column:
    """The vector; a value without a JSON number stops the query."""
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(bad, F.raise_error(F.lit("a vector holds a value that is not finite"))).otherwise(v)


def rerank_body(ranked: DataFrame, request: str, index: str, score: str, documents: Column, tokens: Column, version: Column, text: str | None = None) -> DataFrame:
    """(request, body) from ranked rows; a request's rows are its top n."""
    fields = [F.col(index).alias("index"), F.col(score).alias("relevance_score")]
    if text:
        fields.append(F.struct(F.col(text).alias("text")).alias("document"))
    results = F.array_sort(F.collect_list(F.struct(F.col("rank"), F.struct(*fields).alias("r"))))
    out = ranked.groupBy(request).agg(results.alias("results"), F.max(documents).alias("n"), F.max(tokens).alias("tokens"), F.max(version).alias("version"))
    body = F.struct(F.col(request).alias("id"), F.transform("results", lambda x: x["r"]).alias("results"), meta(F.col("version"), F.col("tokens"), "search_units", search_units(F.col("n"))).alias("meta"))
    return out.select(request, F.to_json(body).alias("body"))


def error_body(request: Column, message: Column) -> Column:
    return F.to_json(F.struct(request.alias("id"), message.alias("message")))


def openai_error_body(status: Column, message: Column, code: Column) -> Column:
    kind = F.when(status >= 500, "server_error").otherwise("invalid_request_error")
    error = F.struct(message.alias("message"), kind.alias("type"), F.lit(None).cast("string").alias("param"), code.alias("code"))
    return F.to_json(F.struct(error.alias("error")), {"ignoreNullFields": "false"})


def status_of(failure: Column) -> Column:
    """HTTP status by kind of failure.  Fixed values of the service."""
    return F.when(failure == "overloaded", 503).when(failure == "illegal_argument", 400).when(failure == "illegal_state", 503).when(failure == "unauthorized", 401).otherwise(500)
