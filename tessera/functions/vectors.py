"""Vector expressions: float products widened to double, as float models compute them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def squared_norm(v: Column) -> Column:
    return _sum(F.transform(v, lambda x: (x * x).cast("double")))


def scale(v: Column, factor: Column) -> Column:
    """By a float factor; floats stay floats."""
    return F.transform(v, lambda x: x * factor.cast("float"))


def l2_normalize(v: Column) -> Column:
    """Unit length; the zero vector stays as it is."""
    n = squared_norm(v)
    return F.when(n > 0, scale(v, (1.0 / F.sqrt(n)).cast("float"))).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """Double; NaN where either vector is zero."""
    dot = _sum(F.zip_with(a, b, lambda x, y: (x * y).cast("double")))
    n = squared_norm(a) * squared_norm(b)
    return F.when(n > 0, dot / F.sqrt(n)).otherwise(F.lit(float("nan")))


def sigmoid(logit: Column) -> Column:
    """Computed in double, returned as float."""
    return (1.0 / (1.0 + F.exp(-logit.cast("double")))).cast("float")


def activate(logit: Column, activation: str = "SIGMOID") -> Column:
    if activation not in ("SIGMOID", "NONE"):
        raise ValueError(f"unknown activation {activation}")
    return sigmoid(logit) if activation == "SIGMOID" else logit.cast("float")


def cell(v: Column, index: int) -> Column:
    """Counted from 0; null outside."""
    return F.get(v, F.lit(index))


def widen(v: Column) -> Column:
    return v.cast("array<float>")


def base64_floats(v: Column) -> Column:
    """Base64 of little-endian 32-bit floats, without line feeds."""
    import numpy as np
    import pyarrow as pa

    def run(column):
        return pa.array([None if x is None else np.asarray(x, "<f4").tobytes() for x in column.to_pylist()], pa.binary())

    return F.translate(F.base64(F.arrow_udf(run, "binary")(v)), "\r\n", "")
