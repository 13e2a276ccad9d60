"""LM scoring: corpus counts, a hashed maximum-entropy model trained by distributed gradient updates, sparse batch scoring.

Texts are cut into chunks of bounded size. A pass writes each chunk's distinct words as hashes with their training counts, dealt out
in blobs by hash, and its texts as compressed numbers of those words; so a word goes through the shuffle once a chunk, not
once an occurrence. Buckets of hashes add up the counts of all chunks, and then hand each chunk its own words' totals back; neither
holds more than a bucket's distinct words. With the totals, texts are written as the model's outcomes, and the model is
trained on all training texts, each in one of `ROUNDS` rounds: every task makes a pass of mini-batch gradient steps over its
texts from the weights so far, and the changes are added up by blocks of rows, one block at a time, and averaged over the
tasks that touched a row. The hashed tables grow with the training tokens up to a size that can be sent to every task
(`ROWS`); a task's texts grow with the tables, so that what changes is a fixed share of what is read.

Defined results: a null text is empty and scores its end alone; a null id counts as the empty string for the folds; rows are
scored one by one, so repeated rows score alike; with no training texts every word is unknown; empty tables give no rows;
other columns are left out.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import replace
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import struct, table, values, written
from .maxent import Model, Shape

ROUNDS = 3
RATE = 0.3
#: Training tokens a row of the hashed tables stands for, and the least and most rows of a table.
TOKENS_ROW, ROWS = 4096, (1 << 13, 1 << 17)
#: Tokens a training task reads for each row of the model's tables; rows of a block.
TASK_TOKENS, BLOCK = 96, 1024
#: Bytes of text in a chunk.
CHUNK = 8 << 20
#: Tokens scored together.
PASS_TOKENS = 100_000
#: Words that a bucket adds up at once.
MERGE = 1 << 20
#: Outcomes; the hashed tables have as many rows as the corpus asks for.
SHAPE = Shape()
#: No word holds a space, so this one stands for the end.
END = b" "


def tokens(text: str) -> list[bytes]:
    return [*text.encode().lower().split(), END]


def word_hashes(words) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64)


def _pack(ids: np.ndarray, width: int = 4) -> bytes:
    """Bytes of one significance together, compressed."""
    return zstandard.compress(ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def _unpack(data: bytes, width: int = 4) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1).T.copy().view(f"<u{width}").ravel().astype(np.int64)


#: kind 0: a chunk's words of one bucket (hashes, counts); 1: the numbers of a chunk's words, bucket after bucket; 2: a text (id,
#: held out, numbers of its words); 3: a bucket's commonest words (hashes, counts); 4: its counts and distinct words by shared outcome.
PARTS = struct(chunk=T.LongType(), kind=T.IntegerType(), bucket=T.IntegerType(), doc_id=T.LongType(), held_out=T.BooleanType(), a=T.BinaryType(), b=T.BinaryType())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=PARTS.names)


def _split(buckets: int):
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        known = words = None
        size, training = 0, []

        def flush():
            hashes = word_hashes(list(known))
            total = np.bincount(np.concatenate([np.empty(0, np.int64), *training]), minlength=len(hashes)).astype(np.uint32)
            of = (hashes.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((np.arange(len(of)), of))  # a bucket's words in the order of their numbers
            edge = np.flatnonzero(np.append(True, np.diff(of[order]) != 0))
            chunk = part << 24 | number
            words.append((chunk, 1, None, None, None, _pack(order), None))
            for s, e in zip(edge, np.append(edge[1:], len(order)), strict=True):
                words.append((chunk, 0, int(of[order[s]]), None, None, hashes[order[s:e]].tobytes(), total[order[s:e]].tobytes()))
            return [_batch(words[i : i + 4096]) for i in range(0, len(words), 4096)]

        for batch in batches:
            for doc, held, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
                if known is None:
                    known, words, size, training = defaultdict(count().__next__), [], 0, []
                own = tokens(text or "")
                ids = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
                if not held:
                    training.append(ids)
                words.append((part << 24 | number, 2, None, doc, held, _pack(ids), None))
                size += len(text or "")
                if size >= CHUNK:
                    yield from flush()
                    known, number = None, number + 1
        if known is not None:
            yield from flush()

    return run


def _merged(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and their sums."""
    h, c = np.concatenate([np.empty(0, np.int64), *hashes]), np.concatenate([np.empty(0, np.int64), *counts])
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    return h[first], np.add.reduceat(c, first) if len(first) else c


def _add_up(batches):
    """Rows by bucket and phase: every chunk's counts are added up; then every chunk's words are answered with their totals.

    Between the two a bucket gives its commonest words, and its counts and distinct words by shared outcome.
    """
    at, hashes, counts, size = None, [], [], 0
    h = c = None

    def close():
        h, c = _merged(hashes, counts)
        top = np.lexsort((h, -c))[: SHAPE.single]
        top = top[c[top] > 0]
        slot, trained = SHAPE.slot(h), c > 0
        sums = np.concatenate([np.bincount(slot, c, SHAPE.slots), np.bincount(slot[trained], minlength=SHAPE.slots)]).astype(np.int64)
        return h, c, _batch([(-1, 3, at, None, None, h[top].tobytes(), c[top].tobytes()), (-1, 4, at, None, None, sums.tobytes(), None)])

    for batch in batches:
        out = []
        for bucket, phase, chunk, a, b in zip(*(batch.column(x).to_pylist() for x in ("bucket", "phase", "chunk", "a", "b")), strict=True):
            if bucket != at:
                at, hashes, counts, size, h = bucket, [], [], 0, None
            own = np.frombuffer(a, np.int64)
            if phase == 0:
                hashes.append(own)
                counts.append(np.frombuffer(b, np.uint32).astype(np.int64))
                size += len(own)
                if size > MERGE and len(hashes) > 1:
                    merged = _merged(hashes, counts)
                    hashes, counts = [merged[0]], [merged[1]]
                    size = len(merged[0]) // 2  # the next merge is when as much again has come
                continue
            if h is None:
                h, c, sums = close()
                hashes, counts = [], []
                yield sums
            out.append((chunk, 0, bucket, None, None, a, c[np.searchsorted(h, own)].tobytes()))
        if out:
            yield _batch(out)


def _pairs(batches):
    for batch in batches:
        a, b = (np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, np.int64) for x in batch.column(c).to_pylist())]) for c in ("a", "b"))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["hash", "n"])


def _sums(batches):
    """(place, n) of the buckets' sums by shared outcome: first counts, then distinct words."""
    for batch in batches:
        s = np.sum([np.frombuffer(x, np.int64) for x in batch.column("a").to_pylist()] or [np.zeros(2 * SHAPE.slots, np.int64)], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s))), pa.array(s)], names=["place", "n"])


class Vocabulary:
    """Outcomes of words by hash: the commonest words' own, else the shared one; and what a word's share of that is."""

    def __init__(self, top: np.ndarray, counts: np.ndarray, sums: np.ndarray, distinct: np.ndarray):
        """top: hashes, the commonest first; counts: theirs; sums, distinct: of all words, by shared outcome."""
        order = np.argsort(top)
        self.top, self.outcome = top[order], order
        slot = SHAPE.slot(top)
        sums = sums - np.bincount(slot, counts, SHAPE.slots)
        distinct = distinct - np.bincount(slot, minlength=SHAPE.slots)
        self.shared = sums + 0.5 * distinct + 0.5
        self.mass = np.concatenate([counts + 0.5, np.zeros(SHAPE.single - len(counts)), self.shared])

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.top):
            return SHAPE.single + SHAPE.slot(hashes)
        place = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
        return np.where(self.top[place] == hashes, self.outcome[place], SHAPE.single + SHAPE.slot(hashes))


def fold(key: Column) -> Column:
    """Held out where the checksum of the id's text leaves 1 when divided by 5."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def _train(numbered: DataFrame, model: Model, tokens: int) -> Model:
    """Rounds over all training texts; what a round changes is averaged over the tasks that touched a row."""
    spark = numbered.sparkSession
    tables = (model.class_weights, model.member_weights)
    tasks = max(1, -(-tokens // (ROUNDS * TASK_TOKENS * sum(map(len, tables)))))

    def learn(seed: int, sent):
        def run(batches):
            learner, waiting, size, number = sent.value.learner(), [], 0, count(seed)

            def step():
                learner.train(np.concatenate([learner.model.contexts(w) for w in waiting], 1), np.concatenate(waiting), RATE, next(number))
                waiting.clear()

            for batch in batches:
                for packed in batch.column("ids").to_pylist():
                    waiting.append(_unpack(packed, 2))
                    size += len(waiting[-1])
                    if size >= PASS_TOKENS:
                        step()
                        size = 0
            if waiting:
                step()
            for level, (old, new, steps) in enumerate(zip((sent.value.class_weights, sent.value.member_weights), (learner.model.class_weights, learner.model.member_weights), learner.steps, strict=True)):
                touched = steps > learner.START
                for block in np.unique(np.flatnonzero(touched) // BLOCK).tolist():
                    own = slice(block * BLOCK, (block + 1) * BLOCK)
                    change = (new[own] - old[own]).astype(np.float16)
                    yield _change([(level << 32 | block, touched[own].astype(np.uint32).tobytes(), change.tobytes())])

        return run

    def add(batches):
        """Rows by block: one sum at a time."""
        at, times, total = None, None, None
        done = lambda: _change([(at, times.tobytes(), (total / np.maximum(times, 1)[:, None]).astype(np.float16).tobytes())])
        for batch in batches:
            for block, hit, change in zip(*(batch.column(c).to_pylist() for c in ("block", "times", "change")), strict=True):
                hit = np.frombuffer(hit, np.uint32)
                change = np.frombuffer(change, np.float16).reshape(len(hit), -1).astype(np.float32)
                if block != at:
                    if at is not None:
                        yield done()
                    at, times, total = block, hit, change
                else:
                    times, total = times + hit, total + change
        if at is not None:
            yield done()

    kind = "block long, times binary, change binary"
    for n in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)
        own = numbered.where(~F.col("held_out") & (F.col("round") == n)).select("ids").coalesce(tasks)
        changes = written(own.mapInArrow(learn(n << 20, sent), kind), "lm-changes")
        # as many rows as the tables have blocks; half the tables' size
        for r in changes.repartition("block").sortWithinPartitions("block").mapInArrow(add, kind).collect():
            part = np.frombuffer(r.change, np.float16).reshape(-1, tables[r.block >> 32].shape[1])
            start = (r.block & 0xFFFFFFFF) * BLOCK
            tables[r.block >> 32][start : start + len(part)] += part
        sent.unpersist()
    return model


def _change(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "times", "change"])


#: `share`: log10 of the words' shares of their shared outcomes; `ids`: packed outcomes.
NUMBERED = struct(doc_id=T.LongType(), held_out=T.BooleanType(), round=T.IntegerType(), n_tokens=T.LongType(), n_known=T.LongType(), base_score=T.DoubleType(), share=T.DoubleType(), ids=T.BinaryType())
SCORES = struct(doc_id=T.LongType(), held_out=T.BooleanType(), n_tokens=T.LongType(), n_known=T.LongType(), train_tokens=T.LongType(), base_score=T.DoubleType(), score=T.DoubleType())


def _number(sent, base_total: float):
    """Texts as outcomes, with all that counts alone decide. Batches are sorted by chunk and kind: a chunk's totals, their numbers, its texts."""

    def run(batches):
        vocabulary = sent.value
        at, blobs, counts, outcomes, logs, shares = None, [], None, None, None, None
        for batch in batches:
            out = []
            for chunk, kind, doc, held, a, b in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "doc_id", "held_out", "a", "b")), strict=True):
                if chunk != at:
                    at, blobs = chunk, []
                if kind == 0:
                    blobs.append((a, b))
                elif kind == 1:
                    hashes, totals = (np.concatenate([np.frombuffer(x[i], np.int64) for x in blobs]) for i in (0, 1))
                    number, blobs = _unpack(a), []
                    counts, outcomes = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
                    counts[number], outcomes[number] = totals, vocabulary.of(hashes)
                    logs = np.log10(counts + 0.5)
                    slot = outcomes - SHAPE.single
                    shares = np.where(slot >= 0, logs - np.log10(vocabulary.shared[np.maximum(slot, 0)]), 0.0)
                else:
                    own = _unpack(a)
                    base = logs[own].sum() - len(own) * np.log10(base_total)
                    round_ = xxhash.xxh32_intdigest(a) % ROUNDS
                    out.append((doc, held, round_, len(own), int((counts[own] > 0).sum()), base, shares[own].sum(), _pack(outcomes[own], 2)))
            if out:
                types = (pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=NUMBERED.names)

    return run


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: folds, counts, the smoothed unigram score and the model's, both log10 of the text's probability."""
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), fold(F.col(f"`{key}`")).alias("held_out"), F.col(f"`{text}`").alias("text"))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = written(own.mapInArrow(_split(buckets), PARTS), "lm-chunks")
    blobs = parts.where("kind = 0").select("chunk", "bucket", "a", "b", F.explode(F.array(F.lit(0), F.lit(1))).alias("phase"))
    blobs = blobs.withColumn("b", F.when(F.col("phase") == 0, F.col("b")))
    added = written(blobs.repartition("bucket").sortWithinPartitions("bucket", "phase", "chunk").mapInArrow(_add_up, PARTS), "lm-counts")
    sums = np.zeros(2 * SHAPE.slots, np.int64)
    for r in added.where("kind = 4").mapInArrow(_sums, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        sums[r.place] = r.n
    n, distinct = int(sums[: SHAPE.slots].sum()), int(sums[SHAPE.slots :].sum())
    top = added.where("kind = 3").mapInArrow(_pairs, "hash long, n long").orderBy(F.desc("n"), "hash").limit(SHAPE.single).collect()
    vocabulary = Vocabulary(np.array([r.hash for r in top], np.int64), np.array([r.n for r in top], np.int64), sums[: SHAPE.slots], sums[SHAPE.slots :])
    known = spark.sparkContext.broadcast(vocabulary)
    both = parts.where("kind in (1, 2)").unionByName(added.where("kind = 0"))
    base_total = float(n) + 0.5 * (distinct + 1)
    numbered = written(both.repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket").mapInArrow(_number(known, base_total), NUMBERED), "lm-numbered")
    rows = ROWS[0]
    while rows < min(ROWS[1], n // TOKENS_ROW):
        rows *= 2
    model = Model(replace(SHAPE, pair_rows=rows, member_rows=rows), vocabulary.mass)
    if n:
        model = _train(numbered, model, n)
    sent = spark.sparkContext.broadcast(model)

    def score(batches):
        model = sent.value
        for batch in batches:
            ids = [_unpack(x, 2) for x in batch.column("ids").to_pylist()]
            length = np.array([len(x) for x in ids])
            p = np.empty(len(ids))
            # about PASS_TOKENS at once; every text has its end, so none is empty
            of = np.cumsum(length) // PASS_TOKENS
            edges = np.flatnonzero(np.append(True, of[1:] != of[:-1])).tolist()
            for s, e in zip(edges, [*edges[1:], len(ids)], strict=True):
                logs = model.log_probs(np.concatenate([model.contexts(x) for x in ids[s:e]], 1), np.concatenate(ids[s:e]))
                p[s:e] = np.add.reduceat(logs, np.cumsum(length[s:e]) - length[s:e]) / np.log(10)
            columns = {c: batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")}
            columns |= {"train_tokens": pa.array(np.full(len(ids), n)), "score": pa.array(p + values(batch, "share"))}
            yield pa.RecordBatch.from_arrays([columns[c] for c in SCORES.names], names=SCORES.names)

    return numbered.mapInArrow(score, SCORES)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES = {"op9_lm": op9_lm}
ORACLE_SQL: dict[str, str] = {}
