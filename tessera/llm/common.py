"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six white-space bytes that separate words, as `bytes.split()` takes them.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Every folder that `written` made in this process, and the lists of those who want to know of it.
scratch: list[str] = []
_watching: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("watching", default=())


#: Bytes that go to a Python worker at once, so that long texts do not fill its memory.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """From now on the session's Arrow batches are bounded in bytes too."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, to be read in bounded batches."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local master, whose workers share the driver's machine, may do without one named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not scratch:
        atexit.register(_tidy)
    scratch.append(path)
    for made in _watching.get():
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_of():
    """The list of the folders that this thread's code writes inside the block; other threads' and other runs' are not in it."""
    made: list[str] = []
    before = _watching.set((*_watching.get(), made))
    try:
        yield made
    finally:
        _watching.reset(before)


def _tidy() -> None:
    """What this process has written goes when it ends, if its session still can."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):
            release(spark, scratch)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders that `written` made; only call it when no result that reads them is still to be run."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def hash_sample(df: DataFrame, rows: int, size: int, *keys: str) -> DataFrame:
    """About `size` of the `rows` rows of `df`: those whose keys hash low. If many rows have equal keys, the first 2 * `size` by hash and keys.

    Which rows are taken depends on their values alone. A sort of what hashes low keeps the bound; it holds no more rows than the limit on any task.
    """
    wide = 1 << 40
    h = F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(wide))
    return df.where(h < F.lit(min(wide, -(-wide * size // max(1, rows))))).orderBy(h, *keys).limit(2 * size)


#: Bits of a sieve for each key, and the most it may have (32 MB); beyond, it holds back less, and what it guards is only moved more.
SIEVE, SIEVE_BITS = 16, 1 << 28


def sieve(df: DataFrame, column: str, keys: DataFrame, name: str) -> DataFrame:
    """`df` with a boolean column `name`: true where the long column `column` has a value that `keys` has, and seldom elsewhere.

    It spares large rows a shuffle whose join would only drop them. Its bits are counted first, so what goes to the
    executors is bounded; the join behind it decides.
    """
    rows = keys.count()
    bits = 1 << 16
    while bits < min(SIEVE_BITS, SIEVE * rows):
        bits *= 2
    at = F.pmod(F.xxhash64(column), F.lit(bits)) + 1  # buckets of 32,768 bits are counted from 1
    bucket, map_ = f"{name}_bucket", f"{name}_map"
    maps = keys.groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(map_))
    place = F.bitmap_bit_position(at).cast("int")
    byte = F.conv(F.hex(F.substring(map_, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), place.bitwiseAND(F.lit(7)) + 1)) != 0
    joined = df.withColumn(bucket, F.bitmap_bucket_number(at)).join(F.broadcast(maps), bucket, "left")
    return joined.withColumn(name, F.coalesce(bit, F.lit(False))).drop(bucket, map_)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of `df` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def put(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with `value` as the last column `name`; input columns whose names clash with it, in any case, are replaced."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()], value.alias(name))


def words_of(text: bytes) -> list[bytes]:
    return text.split()


class Memo(dict):
    """What `make` gives for a key, kept for the keys used lately: at least `size` and at most twice as many of them."""

    every: list[Memo] = []

    def __init__(self, make: Callable, size: int, longest: int = 32):
        super().__init__()
        Memo.every.append(self)
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def keep_only(*memos: Memo) -> None:
    """Empties all other memos of this worker, which serves one operator after another."""
    for m in Memo.every:
        if not any(m is k for k in memos):
            m.clear()
            m.old = {}


def texts(column) -> list[str]:
    """The Arrow column's values, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def values(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy()


def whole_groups(batches, key: str):
    """Tables of whole groups, some or one at a time, from batches sorted by `key`."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = values(batch, key)
        last = int(np.searchsorted(keys, keys[-1]))
        if kept and (last or values(kept[0], key)[0] != keys[-1]):
            yield pa.Table.from_batches([*kept, batch.slice(0, last)])
            kept = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        kept.append(batch.slice(last))
    if kept:
        yield pa.Table.from_batches(kept)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
