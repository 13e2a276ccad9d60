"""Vector algebra on `embeddings`: the label owns token vectors, the id is their position."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import pooling
from .common import table


def _tokens(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")


def _cells(df, key, vector="embedding", digits=6):
    return df.select(key, F.posexplode(vector).alias("cell", "x")).select(key, "cell", F.round(F.col("x").cast("double"), digits).alias("x"))


def _sql_cells(source: str, key: str, vector: str = "embedding") -> str:
    return f"SELECT {key}, CAST(i - 1 AS INTEGER) AS cell, round(CAST({vector}[i] AS DOUBLE), 6) AS x FROM ({source}) s, range(1, 65) t(i) WHERE i <= len({vector})"


_SQUARES = "list_sum(list_transform({v}, lambda x: (x * x)::DOUBLE))"
_NORMAL = f"CASE WHEN {_SQUARES} > 0 THEN list_transform({{v}}, lambda x: x * CAST(1 / sqrt({_SQUARES}) AS FLOAT)) ELSE {{v}} END"
#: Stored vectors are of unit length already, so they are stretched first.
_STRETCHED = "(SELECT vec_id, label, list_transform(embedding, lambda x: x * CAST(1 + vec_id % 7 AS FLOAT)) AS embedding FROM embeddings)"


def _stretched(spark, sf_dir):
    return _tokens(spark, sf_dir).withColumn("embedding", V.scale(F.col("embedding"), 1 + F.col("vec_id") % 7))


def pool_cls(spark, sf_dir):
    return _cells(pooling.pool(_tokens(spark, sf_dir), "CLS", "label", "vec_id", "embedding"), "label")


def pool_last(spark, sf_dir):
    return _cells(pooling.pool(_tokens(spark, sf_dir), "LAST_TOKEN", "label", "vec_id", "embedding"), "label")


def pool_mean(spark, sf_dir):
    return _cells(pooling.pool(_tokens(spark, sf_dir), "MEAN", "label", "vec_id", "embedding"), "label")


def l2_normalize(spark, sf_dir):
    return _cells(_stretched(spark, sf_dir).withColumn("embedding", V.l2_normalize(F.col("embedding"))), "vec_id")


def scaled(spark, sf_dir):
    return _cells(_stretched(spark, sf_dir), "vec_id")


def cosine_pairs(spark, sf_dir):
    """Each vector against the one of the next id, as two targets' answers to one text."""
    a = _tokens(spark, sf_dir).select("vec_id", F.col("embedding").alias("a"))
    b = _tokens(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


_COSINE = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1] * p[2])::DOUBLE)) / sqrt({} * {})".format(_SQUARES.format(v="a.embedding"), _SQUARES.format(v="b.embedding"))
COSINE_PAIRS = f"SELECT a.vec_id, round({_COSINE}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def rebuilt_order(spark, sf_dir):
    """Vectors of a response that lists them in any order, put back by index."""
    items = F.collect_list(F.struct(F.col("vec_id").alias("index"), F.get("embedding", F.lit(0)).alias("x")))
    back = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.array_sort(items).alias("items"))
    return back.select("label", F.posexplode("items").alias("place", "item")).select("label", "place", F.col("item.index").alias("vec_id"), F.round(F.col("item.x").cast("double"), 6).alias("x"))


REBUILT = "SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS place, vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS x FROM embeddings"


def vector_cells(spark, sf_dir):
    """Single cells; outside the vector there is none."""
    v = F.col("embedding")
    return _tokens(spark, sf_dir).select("vec_id", *[F.round(V.cell(v, i).cast("double"), 6).alias(f"cell_{i}") for i in (0, 7, 1000)], F.size(v).alias("dimension"))


CELLS = "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS cell_0, round(CAST(embedding[8] AS DOUBLE), 6) AS cell_7, round(CAST(embedding[1001] AS DOUBLE), 6) AS cell_1000, CAST(len(embedding) AS INTEGER) AS dimension FROM embeddings"


def window_combine(spark, sf_dir):
    """Window vectors to one vector an owner: each window counts by its weight, and the sum is normalised again."""
    windows = _tokens(spark, sf_dir).select("label", (1 + F.col("vec_id") % 5).alias("weight"), "embedding")
    return _cells(pooling.combine_windows(windows, "label", "embedding"), "label", digits=4)


COMBINE = """
WITH s AS (SELECT label, i AS cell, sum((1 + vec_id % 5) * CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) GROUP BY label, i),
n AS (SELECT label, sum(x * x) AS n FROM s GROUP BY label)
SELECT label, CAST(cell - 1 AS INTEGER) AS cell, round(x / sqrt(n), 4) AS x FROM s JOIN n USING (label)"""


def base64_vectors(spark, sf_dir):
    """Little-endian 32-bit floats; checked against a round trip in the tests."""
    return table(spark, sf_dir, "embeddings").select("vec_id", V.base64_floats(F.col("embedding")).alias("embedding"))


QUERIES = {
    "pool_cls": (pool_cls, _sql_cells("SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label", "label")),
    "pool_last": (pool_last, _sql_cells("SELECT label, arg_max(embedding, vec_id) AS embedding FROM embeddings GROUP BY label", "label")),
    "pool_mean": (pool_mean, "SELECT label, CAST(i - 1 AS INTEGER) AS cell, round(CAST(CAST(avg(CAST(embedding[i] AS DOUBLE)) AS FLOAT) AS DOUBLE), 6) AS x FROM embeddings, range(1, 65) t(i) GROUP BY label, i"),
    "l2_normalize": (l2_normalize, _sql_cells(f"SELECT vec_id, {_NORMAL.format(v='embedding')} AS embedding FROM {_STRETCHED}", "vec_id")),
    "scaled": (scaled, _sql_cells(f"SELECT * FROM {_STRETCHED}", "vec_id")),
    "cosine_pairs": (cosine_pairs, COSINE_PAIRS),
    "rebuilt_order": (rebuilt_order, REBUILT),
    "vector_cells": (vector_cells, CELLS),
    "window_combine": (window_combine, COMBINE),
    "base64_vectors": (base64_vectors, None),
}
