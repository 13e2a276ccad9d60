"""Prometheus text: lines of `name{labels} value`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(lines: DataFrame, line: str = "value") -> DataFrame:
    """(series, value): comments and lines without a number are left out, values of one series are added."""
    s = F.trim(line)
    rows = lines.where((s != "") & ~s.startswith("#")).select(
        F.trim(F.regexp_extract(s, r"^(.*) [^ ]*$", 1)).alias("series"), F.regexp_extract(s, r" ([^ ]*)$", 1).try_cast("double").alias("value")
    )
    return rows.where("value is not null").groupBy("series").agg(F.sum("value").alias("value"))


def matches(series: Column, name: str, *labels: str) -> Column:
    """The series of that very name, with or without labels, whose text holds every label given."""
    out = (series == name) | series.startswith(f"{name}{{")
    for x in labels:
        out = out & (F.instr(series, x) > 0)
    return out


def total(metrics: DataFrame, name: str, *labels: str) -> DataFrame:
    """A single row with the sum, 0 if nothing matches."""
    return metrics.where(matches(F.col("series"), name, *labels)).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))


def expose(metrics: DataFrame) -> DataFrame:
    """Lines of text, to be written with `df.write.text`."""
    return metrics.select(F.concat_ws(" ", "series", F.col("value").cast("string")).alias("value"))
