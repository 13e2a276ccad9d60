"""Comparison of runs: windows, percentiles, rates, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the agreement check.
MIN_COSINE, MAX_SCORE_DIFF = 0.999, 0.01
PERCENTILES = (0.5, 0.9, 0.99)


def window_counts(log: DataFrame, group: list[str], ts: str, opened: Column, closed: Column, failed: Column, error: Column) -> DataFrame:
    """Requests and errors that end inside [opened, closed), and the first error's text; what ends outside is counted apart."""
    inside = (F.col(ts) >= opened) & (F.col(ts) < closed)
    return log.groupBy(*group).agg(
        F.count_if(inside & ~failed).alias("requests"),
        F.count_if(inside & failed).alias("errors"),
        F.count_if(~inside).alias("discarded"),
        F.min_by(F.when(inside & failed, error), F.when(inside & failed, F.col(ts))).alias("first_error"),
    )


def percentiles(log: DataFrame, group: list[str], value: str) -> DataFrame:
    """Exact 50th, 90th and 99th percentiles (values that occur) and the maximum."""
    names = [f"p{round(100 * p)}" for p in PERCENTILES]
    exact = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)").alias(n) for p, n in zip(PERCENTILES, names, strict=True)]
    return log.groupBy(*group).agg(*exact, F.max(value).alias("max"))


def percentile_sketch(log: DataFrame, group: list[str], value: str) -> DataFrame:
    """The same from a mergeable sketch, of bounded size a group however many values it has."""
    return log.groupBy(*group).agg(F.percentile_approx(value, list(PERCENTILES), 1000).alias("p"), F.max(value).alias("max"))


def rates(results: DataFrame) -> DataFrame:
    """Requests, inputs and tokens a second; tokens stay NaN where they are unknown."""
    rps = F.col("requests") / F.col("seconds")
    return results.withColumns({"rps": rps, "inputs_per_second": rps * F.col("inputs"), "tokens_per_second": rps * F.col("inputs") * F.col("tokens_per_input")})


def comparable(errors: Column, requests: Column) -> Column:
    return (errors == 0) & (requests > 0)


def compare_runs(runs: DataFrame, own: str) -> DataFrame:
    """Own run against every competitor's of equal workload and concurrency: throughput and p99 ratios, null and marked where a run is invalid."""
    keys = ["workload", "concurrency"]
    ok = comparable(F.col("errors"), F.col("requests"))
    mine = runs.where(F.col("target") == own).select(*keys, F.col("rps").alias("rps_own"), F.col("p99").alias("p99_own"), ok.alias("ok_own"))
    theirs = runs.where(F.col("target") != own).select(*keys, "target", "rps", "p99", ok.alias("ok"))
    valid = F.col("ok") & F.col("ok_own")
    return theirs.join(mine, keys).select(
        *keys, "target", F.when(valid, F.col("rps_own") / F.col("rps")).alias("throughput_ratio"), F.when(valid, F.col("p99_own") / F.col("p99")).alias("p99_ratio"), F.when(~valid, "invalid: errors").alias("marker")
    )


def agreement(checks: DataFrame) -> DataFrame:
    """(target, failures) from (target, min_cosine, max_diff, planted_first); a value that is no number is a failure too."""
    far = F.col("min_cosine").isNull() | F.isnan("min_cosine") | (F.col("min_cosine") < MIN_COSINE)
    off = F.isnan("max_diff") | (F.col("max_diff") > MAX_SCORE_DIFF)
    return checks.select("target", F.array_compact(F.array(F.when(far, "cosine"), F.when(off, "score"), F.when(~F.col("planted_first"), "planted"))).alias("failures"))


def counter_deltas(samples: DataFrame, series: str, value: str, edge: str) -> DataFrame:
    """Closing less opening value of each series; `edge` is `open` or `close`."""
    at = lambda e: F.max(F.when(F.col(edge) == e, F.col(value)))
    return samples.groupBy(series).agg((at("close") - at("open")).alias("delta"))


def padding_ratio(padding: Column, real: Column) -> Column:
    """NaN where nothing was computed."""
    return F.when(padding + real == 0, float("nan")).otherwise(padding / (padding + real))
