"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

Only anchored suffixes are looked at first: anchors (see `anchors`) whose probe occurs once cannot lie in a repeat, and
anchors with equal surroundings repeat as a whole. What is left, the surroundings of anchors that share a probe but differ
somewhere, goes to the shards of an index family: a shard's text arrives in batches, every batch gets a suffix array of
its windows, is merge-scanned against the levels there are for matches of the full length, and levels of like size merge.

Defined results: a null text is empty and has nothing removed, as has a text shorter than `length`; repeated rows, also of one
id, repeat each other; ids may be null; other columns of the input do not matter; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import anchors, split, word_anchors
from .common import fresh, keep_only, put, release, scratch_of, sieve, struct, table, texts, values, whole_groups, written

LENGTH = 400
PROBE = 128
#: Windows in one batch, and about as many in one shard as fit a worker's memory several times over.
BATCH = 1 << 15
SHARD = 1 << 17
#: Probes with more surroundings than this are dealt out by where the window lies around the anchor.
SHARED = 256
OFFSETS = 32


class IndexFamily:
    """Suffix arrays over windows of one text buffer, each level at least twice as large as the next."""

    def __init__(self, text: np.ndarray, length: int):
        self.length = length
        self.windows = np.lib.stride_tricks.sliding_window_view(text, length)
        self.levels: list[np.ndarray] = []  # starts in suffix order, distinct windows only
        self.repeated = np.zeros(len(text), bool)

    def _keys(self, starts: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.windows[starts]).view(f"V{self.length * self.windows.itemsize}").ravel()

    def _scan(self, level: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted keys: how many of the level are smaller, and the start of the equal one or -1."""
        rank, equal = np.zeros(len(keys), np.int64), np.full(len(keys), -1)
        for at in range(0, len(level), BATCH):
            part = level[at : at + BATCH]
            own = self._keys(part)
            r = np.searchsorted(own, keys)
            rank += r
            inside = np.minimum(r, len(own) - 1)
            hit = (r < len(own)) & (own[inside] == keys)
            equal[hit] = part[inside[hit]]
        return rank, equal

    def add(self, starts: np.ndarray) -> None:
        """A new batch; marks in `repeated` every window, old or new, that now occurs twice."""
        keys = self._keys(starts)
        order = np.argsort(keys, kind="stable")
        keys, starts = keys[order], starts[order]
        same = keys[1:] == keys[:-1]
        self.repeated[starts[1:][same]] = self.repeated[starts[:-1][same]] = True
        fresh = np.append(True, ~same)
        group = np.cumsum(fresh) - 1
        new = np.ones(fresh.sum(), bool)
        for level in self.levels:
            _, equal = self._scan(level, keys[fresh])
            found = equal >= 0
            self.repeated[equal[found]] = True
            self.repeated[starts[found[group]]] = True
            new &= ~found
        self.levels.append(starts[fresh][new])
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            self.levels.append(self._merge(self.levels.pop(), self.levels.pop()))

    def _merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = sorted((a, b), key=len)
        place = np.concatenate([self._scan(b, self._keys(a[at : at + BATCH]))[0] for at in range(0, len(a), BATCH)] or [np.empty(0, np.int64)])
        return np.insert(b, place, a)


def repeated_windows(contexts: list[bytes], length: int = LENGTH, unit: int = 1) -> list[np.ndarray]:
    """For each context, which of its windows of `length` units occur twice among all contexts; a unit is a byte, or the eight of a word's hash."""
    size = np.array([len(c) // unit for c in contexts])
    at = np.cumsum(size) - size
    family = IndexFamily(np.frombuffer(b"".join(contexts), f"u{unit}"), length)
    count = size - length + 1
    ends = np.cumsum(count)
    starts = np.repeat(at - (ends - count), count) + np.arange(ends[-1])
    for i in range(0, len(starts), BATCH):
        family.add(starts[i : i + BATCH])
    return [family.repeated[a : a + n] for a, n in zip(at, count, strict=True)]


ANCHOR = struct(doc_id=T.LongType(), text_hash=T.LongType(), probe=T.LongType(), cover=T.LongType(), place=T.IntegerType(), first=T.IntegerType(), last=T.IntegerType())


def _anchor_rows(length: int, probe: int, unit: int):
    def run(batches):
        keep_only()
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("text_hash")
            found = [(anchors if unit == 1 else word_anchors)(t.encode(), length, probe) for t in texts(batch.column("text"))]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            place, first, last, probes, cover = (np.concatenate([np.empty(0, np.int64), *(f[i] for f in found)]) for i in range(5))
            columns = [ids.take(rows), hashes.take(rows), pa.array(probes), pa.array(cover), *(pa.array(x.astype(np.int32)) for x in (place, first, last))]
            yield pa.RecordBatch.from_arrays(columns, names=ANCHOR.names)

    return run


def _combine(batches):
    """Rows of equal probe and cover are counted where they are, before any shuffle."""
    for batch in batches:
        probe, cover = values(batch, "probe"), values(batch, "cover")
        order = np.lexsort((cover, probe))
        fresh = np.append(True, (np.diff(probe[order]) != 0) | (np.diff(cover[order]) != 0))[: len(order)]
        at = np.flatnonzero(fresh)
        rep = batch.take(pa.array(order[at]))
        yield pa.RecordBatch.from_arrays([*rep.columns, pa.array(np.diff(np.append(at, len(order))))], names=[*ANCHOR.names, "n"])


def _live(batches):
    """Of sorted rows those that can repeat: of each probe and cover one, whether it occurs twice, and how many covers the probe has."""
    for rows in whole_groups(batches, "probe"):
        probe, cover, n = (rows[c].to_numpy() for c in ("probe", "cover", "n"))
        new = np.append(True, probe[1:] != probe[:-1])
        fresh = new | np.append(True, cover[1:] != cover[:-1])
        at = np.flatnonzero(fresh)
        total = np.add.reduceat(n, at)
        of = (np.cumsum(new) - 1)[at]
        covers = np.bincount(of)[of]
        keep = (total > 1) | (covers > 1)
        rep = rows.take(pa.array(at[keep])).combine_chunks()
        out = rep.drop_columns(["n"]).append_column("whole", pa.array(total[keep] > 1)).append_column("covers", pa.array(covers[keep]))
        yield from out.to_batches()


LIVE = T.StructType([*ANCHOR.fields, T.StructField("whole", T.BooleanType()), T.StructField("covers", T.LongType())])


def _resolve(length: int, unit: int):
    """Which windows of each context repeat; contexts come sorted by shard."""

    def solve(pending: list[pa.Table]):
        rows = pa.concat_tables(pending)
        flags = repeated_windows(rows["context"].to_pylist(), length, unit)
        keep, parts = [], []
        for i, f in enumerate(flags):
            if f.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], f, [False]]).astype(np.int8)))
                keep.append(i)
                parts.append((edge + rows["from"][i].as_py()).tolist())
        found = rows.select(["probe", "cover"]).take(pa.array(keep, pa.int64())).append_column("parts", pa.array(parts, pa.list_(pa.int32())))
        return found.combine_chunks().to_batches()

    def run(batches):
        pending, size = [], 0
        for rows in whole_groups(batches, "shard"):
            pending.append(rows)
            size += sum(map(len, rows["context"].to_pylist())) // unit - (length - 1) * rows.num_rows
            if size >= SHARD:
                yield from solve(pending)
                pending, size = [], 0
        if pending:
            yield from solve(pending)

    return run


def repeated_spans(docs: DataFrame, key: str, text: str, hash_: str, length: int = LENGTH, probe: int = PROBE, unit: int = 1) -> DataFrame:
    """(doc_id, text_hash, spans) for those of `docs` that have repeats: sorted arrays of [start, end) bytes, which may overlap.

    Where a unit is eight bytes, all is in words, `length` and spans too.
    """
    own = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(hash_).alias("text_hash"))
    found = written(own.mapInArrow(_anchor_rows(length, probe, unit), ANCHOR), "anchors")
    with_n = T.StructType([*ANCHOR.fields, T.StructField("n", T.LongType())])
    counted = found.mapInArrow(_combine, with_n).repartition("probe").sortWithinPartitions("probe", "cover")
    live = written(counted.mapInArrow(_live, LIVE), "anchors-live")
    edges = live.where("covers > 1").withColumn(
        "block",
        # windows that are equal lie equally around their anchor
        F.when(F.col("covers") > SHARED, F.sequence(F.col("first") - F.pmod(F.col("first") - F.col("place"), F.lit(OFFSETS)), F.col("last"), F.lit(OFFSETS))).otherwise(F.array("first")),
    ).select("doc_id", "text_hash", "probe", "cover", "place", "first", "last", "covers", F.explode("block").alias("block"))
    low = F.greatest("first", "block")
    high = F.when(F.col("covers") > SHARED, F.least(F.col("last"), F.col("block") + (OFFSETS - 1))).otherwise(F.col("last"))
    edges = edges.select("doc_id", "text_hash", "probe", "cover", low.alias("low"), (low - F.col("first")).alias("from"), (high - low + length).alias("size"), F.when(F.col("covers") > SHARED, F.col("block") - F.col("place")).otherwise(F.lit(0)).alias("offset"))
    # texts without such an anchor are not moved
    whole_texts = own.select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), "text")
    likely = sieve(whole_texts, "own_hash", live.where("covers > 1").select(F.col("text_hash").alias("own_hash")), "likely").where("likely")
    symbols = F.encode("text", "UTF-8")
    if unit > 1:
        likely, symbols = likely.withColumn("text", F.arrow_udf(_word_hashes, T.BinaryType()).asNondeterministic()("text")), F.col("text")
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash"))
    cut = likely.join(edges, same).select(
        F.xxhash64("probe", "offset").alias("shard"), "probe", "cover", "from", F.substring(symbols, unit * F.col("low") + 1, unit * F.col("size")).alias("context")
    )
    parts = cut.repartition("shard").sortWithinPartitions("shard").mapInArrow(_resolve(length, unit), "probe long, cover long, parts array<int>")
    # pairs of bounds, of windows, from the first window on
    parts = parts.select("probe", "cover", F.transform(F.sequence(F.lit(0), F.size("parts") - 1, F.lit(2)), lambda i: F.struct(F.get("parts", i).alias("s"), F.get("parts", i + 1).alias("e"))).alias("part"))
    whole = live.where("whole").select("probe", "cover", F.array(F.struct(F.lit(0).alias("s"), (F.col("last") - F.col("first") + 1).alias("e"))).alias("part"))
    solved = whole.union(parts.join(live.where("not whole").select("probe", "cover"), ["probe", "cover"], "left_semi"))
    hits = sieve(found, "probe", live, "likely").where("likely").join(solved, ["probe", "cover"]).select("doc_id", "text_hash", F.explode("part").alias("p"), "first")
    span = F.struct((F.col("first") + F.col("p.s")).alias("s"), (F.col("first") + F.col("p.e") + (length - 1)).alias("e"))
    return hits.select("doc_id", "text_hash", span.alias("span")).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def _word_hashes(column: pa.Array) -> pa.Array:
    return pa.array([split(t.encode())[2].tobytes() for t in texts(column)], pa.binary())


def _pairs(spans: list[dict] | None) -> list[tuple[int, int]]:
    return [(x["s"], x["e"]) for x in spans or ()]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for s, e in runs:
        kept.append(data[at:s])
        at = e
    return b"".join([*kept, data[at:]])


def _whole_characters(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the bytes of characters that they hold in part."""
    out = []
    for s, e in runs:
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def whole_words(data: bytes, start: int, end: int) -> int:
    """Words of `data` that lie in [start, end) as a whole."""
    n = len(data[start:end].split())
    if n and start and not data[start - 1 : start].isspace() and not data[start : start + 1].isspace():
        n -= 1
    if n and end < len(data) and not data[end : end + 1].isspace() and not data[end - 1 : end].isspace():
        n -= 1
    return n


def _removed(kept: T.DataType) -> T.StructType:
    return struct(n_bytes=T.LongType(), n_removed=T.LongType(), runs=T.ArrayType(struct(s=T.IntegerType(), e=T.IntegerType())), kept=kept)


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "dedup", length: int = LENGTH, probe: int = PROBE, characters: bool = False, words: int = 0) -> DataFrame:
    """`docs` with a struct column `out`: n_bytes, n_removed, the maximal removed runs, and the bytes kept.

    With `characters`, runs leave out what they hold of a character in part, and `kept` is a string. With `words`, runs of
    fewer whole words stay, and words in strings of so many that start anywhere else too go, however few bytes they have,
    and the white space between those, whatever it is.
    """
    id_, hash_, of_, spans_, words_ = fresh(docs, "id", "hash", "of_hash", "spans", "word_spans")
    docs = docs.withColumn(hash_, F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))

    def spans_of(length: int, probe: int, unit: int) -> DataFrame:
        with scratch_of() as made:
            found = repeated_spans(docs, key, text, hash_, length, probe, unit).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(of_), F.col("spans").alias(spans_))
            found = written(found, "spans")
        release(docs.sparkSession, made[:-1])  # nothing reads the anchors any more
        return found

    spans = spans_of(length, probe, 1)
    none = F.lit(None).cast(spans.schema[spans_].dataType)
    spans = spans.withColumn(words_, none)
    if words:
        both = spans.union(spans_of(words, max(1, words // 3), 8).select(id_, of_, none, spans_))
        spans = written(both.groupBy(id_, of_).agg(*(F.first(c, ignorenulls=True).alias(c) for c in (spans_, words_))), "spans")
    run_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    kept_type = pa.string() if characters else pa.binary()

    def remove(column: pa.Array, found: pa.Array, found_words: pa.Array) -> pa.Array:
        rows = []
        for t, s, w in zip(texts(column), found.to_pylist(), found_words.to_pylist(), strict=True):
            data = t.encode()
            runs = [r for r in _union(_pairs(s)) if not words or whole_words(data, *r) >= words]
            if w:
                start, end, *_ = split(data)
                runs = _union(sorted(runs + [(int(start[a]), int(end[b - 1])) for a, b in _union(_pairs(w))]))
            if characters:
                runs = _whole_characters(data, runs)
            rows.append({"n_bytes": len(data), "n_removed": sum(e - s for s, e in runs), "runs": [{"s": s, "e": e} for s, e in runs], "kept": cut(data, runs)})
        return pa.array(rows, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("runs", run_type), ("kept", kept_type)]))

    hit = "hit"
    while any(c.lower() in (hit, f"{hit}_bucket", f"{hit}_map") for c in docs.columns):
        hit += "_"
    same = F.col(f"`{key}`").cast("long").eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(of_))
    # rows whose text surely has no spans are not moved
    sifted = sieve(docs, hash_, spans.select(F.col(of_).alias(hash_)), hit)
    clean = sifted.where(~F.col(hit)).drop(hit)
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in spans.schema.fields]
    joined = sifted.where(F.col(hit)).drop(hit).join(spans, same, "left").union(clean.select("*", *nothing))
    kind = _removed(T.StringType() if characters else T.BinaryType())
    return put(joined, out, F.arrow_udf(remove, kind).asNondeterministic()(F.col(f"`{text}`"), F.col(spans_), F.col(words_))).drop(id_, hash_, of_, spans_, words_)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "dedup.n_bytes", "dedup.n_removed", F.size("dedup.runs").cast("long").alias("n_spans"), F.sha2("dedup.kept", 256).alias("kept_sha256"))


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
