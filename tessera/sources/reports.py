"""Benchmark reports: Markdown and JSON out, Markdown in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import format_number, label


def markdown_rows(results: DataFrame) -> DataFrame:
    """One table row a result, to be written as text."""
    n = lambda c, d: format_number(F.col(c).cast("double"), d)
    cells = F.concat_ws(" | ", "workload", label(F.col("target")), F.col("concurrency").cast("string"), n("rps", 1), n("p50", 1), n("p90", 1), n("p99", 1))
    return results.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("value"))


def json_rows(results: DataFrame) -> DataFrame:
    """Numbers that are not finite are left out."""
    clean = [F.when(~(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in results.dtypes]
    return results.select(F.to_json(F.struct(*clean)).alias("value"))


def read_markdown(lines: DataFrame, line: str = "value") -> DataFrame:
    """(workload, target, concurrency, rps, p50, p90, p99) of table rows; a dash is null."""
    cells = F.split(F.trim(F.regexp_replace(line, r"^\s*\||\|\s*$", "")), r"\s*\|\s*")
    number = lambda i: F.get("c", F.lit(i)).try_cast("double")
    rows = lines.select(cells.alias("c")).where((F.size("c") == 7) & F.get("c", F.lit(2)).rlike("^[0-9]+$"))
    return rows.select(F.get("c", F.lit(0)).alias("workload"), F.get("c", F.lit(1)).alias("target"), F.get("c", F.lit(2)).cast("int").alias("concurrency"), *[number(3 + i).alias(k) for i, k in enumerate(("rps", "p50", "p90", "p99"))])
