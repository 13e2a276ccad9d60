"""Requests to, and responses of, servers of three dialects, as columns.

Embeddings have one shape everywhere. Reranking has two: `results` (a model, documents, and an object of results with
`relevance_score`) and `texts` (no model, texts, and a bare array with `score`).
Of equal indexes in one response the last stands; documents without a score have 0; an index that no document has stops the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of fields that servers read.  Fixed values.
DIALECTS = ("results", "texts")
_RESULTS = "results array<struct<index:bigint,relevance_score:double>>"
_ARRAY = "array<struct<index:bigint,score:double>>"
_DATA = "data array<struct<index:bigint,embedding:array<double>>>"


def embed_request(model: Column, texts: Column) -> Column:
    return F.to_json(F.struct(model.alias("model"), texts.alias("input")))


def rerank_request(dialect: str, model: Column, query: Column, documents: Column) -> Column:
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}")
    fields = (query.alias("query"), documents.alias("texts")) if dialect == "texts" else (model.alias("model"), query.alias("query"), documents.alias("documents"))
    return F.to_json(F.struct(*fields))


def score_items(body: Column) -> Column:
    """array<struct<index, value>> of a rerank response of either dialect."""
    bare = F.transform(F.from_json(body, _ARRAY), lambda x: F.struct(x["index"].alias("index"), x["score"].cast("float").alias("value")))
    named = F.transform(F.from_json(body, _RESULTS)["results"], lambda x: F.struct(x["index"].alias("index"), x["relevance_score"].cast("float").alias("value")))
    return F.when(F.ltrim(body).startswith("["), bare).otherwise(named)


def vector_items(body: Column) -> Column:
    """array<struct<index, value>> of an embedding response."""
    return F.transform(F.from_json(body, _DATA)["data"], lambda x: F.struct(x["index"].alias("index"), x["embedding"].cast("array<float>").alias("value")))


def in_order(responses: DataFrame, items: Column, out: str) -> DataFrame:
    """`responses` with an array column `out`: the items by index, each index once; a response without items has an empty array."""
    place = F.transform(F.coalesce(items, F.array()), lambda x, i: F.struct(x["index"].alias("index"), (-i).alias("place"), x["value"].alias("value")))
    # a column of its own, so that the sort is not repeated for every element
    ordered = responses.withColumn(out, F.array_sort(place))
    last = lambda x, i: (i == 0) | (F.get(F.col(out), i - 1)["index"] != x["index"])
    return ordered.withColumn(out, F.transform(F.filter(out, last), lambda x: F.struct(x["index"].alias("index"), x["value"].alias("value"))))


def scores(responses: DataFrame, body: str, documents: str, out: str = "scores") -> DataFrame:
    """`responses` with an array of floats in document order; `documents` is the column of their number."""
    found = in_order(responses, score_items(F.col(body)), out)
    n = F.col(documents)
    stray = F.exists(out, lambda x: (x["index"] < 0) | (x["index"] >= n))
    every = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    missing = F.transform(F.array_except(every, F.transform(out, lambda x: x["index"])), lambda i: F.struct(i.alias("index"), F.lit(0).cast("float").alias("value")))
    filled = F.transform(F.array_sort(F.concat(F.col(out), missing)), lambda x: x["value"])
    return found.withColumn(out, F.when(stray, F.raise_error(F.lit("a response has an index that no document has"))).otherwise(filled))


def embeddings(responses: DataFrame, body: str, out: str = "vectors") -> DataFrame:
    """`responses` with an array of vectors by index."""
    found = in_order(responses, vector_items(F.col(body)), out)
    return found.withColumn(out, F.transform(out, lambda x: x["value"]))
