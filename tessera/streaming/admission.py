"""Admission of requests to a bounded queue, replayed from a log or kept as stream state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLAY = "ts long, job long, change long, queued long, admitted boolean"


def _decide(queued: int, change: int, limit: int) -> tuple[int, bool]:
    """An arrival is refused if it overfills the queue, unless the queue was empty; a completion always counts."""
    if change > 0 and queued and queued + change > limit:
        return queued, False
    return queued + change, True


def replay(log: DataFrame, model: str, limit: int) -> DataFrame:
    """(model, ts, job, change, queued, admitted) in order of (ts, arrivals last, job): `change` is +n at arrival, -n at completion.

    Completions of refused jobs change nothing. One model's log is folded in order; models are independent.
    """

    def fold(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t[model].to_pylist(), t["ts"].to_pylist(), t["job"].to_pylist(), t["change"].to_pylist(), strict=True), key=lambda r: (r[1], r[3] > 0, r[2]))
        queued, refused, out = 0, set(), []
        for name, ts, job, change in rows:
            if change < 0 and job in refused:
                out.append((name, ts, job, change, queued, False))
                continue
            queued, ok = _decide(queued, change, limit)
            if not ok:
                refused.add(job)
            out.append((name, ts, job, change, queued, ok))
        names = [model, "ts", "job", "change", "queued", "admitted"]
        return pa.table({n: pa.array([r[i] for r in out], t.schema.field(model).type if n == model else pa.bool_() if n == "admitted" else pa.int64()) for i, n in enumerate(names)})

    kind = dict(log.dtypes)[model]
    own = log.select(model, F.col("ts").cast("long").alias("ts"), F.col("job").cast("long").alias("job"), F.col("change").cast("long").alias("change"))
    return own.groupBy(model).applyInArrow(fold, f"`{model}` {kind}, {REPLAY}")


def admission_stream(arrivals: DataFrame, model: str, limit: int) -> DataFrame:
    """The same on a stream: state is one counter a model, and the refused jobs that are not completed yet."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        queued, refused = state.get if state.exists else (0, [])
        refused = set(refused)
        rows = pd.concat(list(batches)).sort_values(["ts", "change", "job"])
        out = []
        for ts, job, change in zip(rows["ts"], rows["job"], rows["change"], strict=True):
            if change < 0 and job in refused:
                refused.discard(job)
                out.append((key[0], ts, job, change, queued, False))
                continue
            queued, ok = _decide(queued, int(change), limit)
            if not ok:
                refused.add(int(job))
            out.append((key[0], ts, job, change, queued, ok))
        state.update((int(queued), sorted(refused)))
        yield pd.DataFrame(out, columns=[model, "ts", "job", "change", "queued", "admitted"])

    kind = dict(arrivals.dtypes)[model]
    return arrivals.groupBy(model).applyInPandasWithState(update, f"`{model}` {kind}, {REPLAY}", "queued long, refused array<long>", "append", "NoTimeout")


def live(pending: DataFrame, cancelled: DataFrame, job: str) -> DataFrame:
    """Sequences of jobs that are not cancelled."""
    return pending.join(cancelled.select(job).distinct(), job, "left_anti")


def rounds(stream: DataFrame, handle, checkpoint: str, available_now: bool = False):
    """Continuous batching: each micro-batch takes all that came while the last one ran; `handle(frame, number)` plans, encodes and emits."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
