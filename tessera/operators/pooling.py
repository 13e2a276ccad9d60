"""Pooling of token vectors and combination of window vectors; rows of (owner, position, vector)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize


def pool_cls(tokens: DataFrame, owner: str, position: str, vector: str) -> DataFrame:
    return tokens.groupBy(owner).agg(F.min_by(vector, position).alias(vector))


def pool_last(tokens: DataFrame, owner: str, position: str, vector: str) -> DataFrame:
    return tokens.groupBy(owner).agg(F.max_by(vector, position).alias(vector))


def _by_cell(tokens: DataFrame, owner: str, vector: str, value) -> DataFrame:
    cells = tokens.select(owner, *(c for c in ("weight",) if c in tokens.columns), F.posexplode(vector).alias("cell", "x"))
    sums = cells.groupBy(owner, "cell").agg(value.alias("x"))
    return sums.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "x"))), lambda s: s["x"].cast("float")).alias(vector))


def pool_mean(tokens: DataFrame, owner: str, vector: str) -> DataFrame:
    """The mean of each cell, summed in double with map-side combining."""
    return _by_cell(tokens, owner, vector, F.avg(F.col("x").cast("double")))


def pool(tokens: DataFrame, mode: str, owner: str, position: str, vector: str) -> DataFrame:
    if mode == "CLS":
        return pool_cls(tokens, owner, position, vector)
    if mode == "LAST_TOKEN":
        return pool_last(tokens, owner, position, vector)
    if mode == "MEAN":
        return pool_mean(tokens, owner, vector)
    raise ValueError(f"unknown pooling {mode}")


def combine_windows(windows: DataFrame, owner: str, vector: str, normalize: bool = True) -> DataFrame:
    """Windows of (owner, weight, vector) to one vector an owner: the weighted sum, normalised again, or the weighted mean."""
    total = F.sum(F.col("weight") * F.col("x").cast("double"))
    out = _by_cell(windows, owner, vector, total if normalize else total / F.sum("weight"))
    return out.withColumn(vector, l2_normalize(F.col(vector))) if normalize else out
