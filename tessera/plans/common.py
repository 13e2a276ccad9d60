"""Reading of tables, and rows that both Spark and the SQL of a check make alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """A query in SQL that both engines read alike, over the named tables.

    Relations are bound by parameters, so no view is left behind in the session.
    """
    return spark.sql(sql.format(**{t: f"{{{t}}}" for t in tables}), **{t: table(spark, sf_dir, t) for t in tables})


def plain(sql: str, *tables: str) -> str:
    return sql.format(**{t: t for t in tables})
