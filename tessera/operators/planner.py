"""Batch plans under a token budget, and fair rounds."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Bounds of one batch."""

    max_rows: int = 1024
    token_budget: int = 16384
    max_input: int = 512
    packed: bool = False
    half: bool = False

    @property
    def budget(self) -> int:
        """A sequence of the greatest length always fits."""
        return max(self.token_budget, self.max_input)

    @property
    def padded_tokens(self) -> int:
        """Packed models in half precision may hold four times the budget with padding."""
        return self.budget * (4 if self.packed and self.half else 1)


def cut(lengths: list[int], limits: Limits) -> list[int]:
    """Batch numbers of lengths in ascending order; each batch is filled as far as all bounds allow, and holds one sequence at least."""
    out, batch, rows, real = [], -1, 0, 0
    for n in lengths:
        padded = (rows + 1) * n  # ascending: the newest is the longest
        cost = real + n if limits.packed else padded
        if not rows or rows + 1 > limits.max_rows or padded > limits.padded_tokens or cost > limits.budget:
            batch, rows, real = batch + 1, 0, 0
        rows, real = rows + 1, real + n
        out.append(batch)
    return out


def plan_batches(rows: DataFrame, group: str, index: str, length: str, limits: Limits) -> DataFrame:
    """(group, index, length, batch, position): each group, one round's worth of sequences, is sorted by length and cut into batches.

    At scale a group is a bounded range of the input: batches never cross groups, and vectors do not depend on their batch.
    """

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by([(length, "ascending"), (index, "ascending")])
        batch = cut(t[length].to_pylist(), limits)
        place, seen = [], -1
        for b in batch:
            place.append(0 if b != seen else place[-1] + 1)
            seen = b
        return t.append_column("batch", pa.array(batch, pa.int32())).append_column("position", pa.array(place, pa.int32()))

    kept = rows.select(group, index, length)
    kind = dict(kept.dtypes)
    schema = ", ".join(f"`{c}` {kind[c]}" for c in kept.columns) + ", batch int, position int"
    return kept.groupBy(group).applyInArrow(solve, schema)


def batch_metrics(plan: DataFrame, group: str, length: str, packed: bool = False) -> DataFrame:
    """Rows, real tokens and padding of each batch; packed models have no padding."""
    padding = F.lit(0).cast("long") if packed else (F.max(length) * F.count("*") - F.sum(length)).cast("long")
    return plan.groupBy(group, "batch").agg(F.count("*").alias("rows"), F.sum(length).cast("long").alias("tokens"), padding.alias("padding"))


def fair_round(pending: DataFrame, jobs: DataFrame, job: str, index: str, length: str, budget: int, done: str | None = None) -> DataFrame:
    """What one round takes from each job: its shortest sequences while their sum stays within an equal share of four budgets, one at least.

    `jobs` has a row for each active job; those with `done` set count for the share and give nothing.
    """
    share = F.greatest(F.lit(1), F.floor(F.lit(4 * budget) / F.col("active")))
    active = jobs.agg(F.count("*").alias("active"))
    live = jobs.where(~F.col(done)).select(job) if done else jobs.select(job)
    w = Window.partitionBy(job).orderBy(length, index)
    own = pending.join(live, job, "left_semi").withColumns({"taken": F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(w)})
    # `active` is a single row
    return own.join(F.broadcast(active)).where((F.col("taken") <= share) | (F.col("n") == 1)).drop("active", "n")
