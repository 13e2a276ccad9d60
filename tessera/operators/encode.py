"""Encoders behind one seam: the lexical stand-in in expressions, and models in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .planner import Limits, cut
from .tokens import row

#: Fixed values of the stand-in: tokens and limit, dimension, scores, and tokens a document.
LIMIT, CONTAINED, PER_DOCUMENT = 20, 0.9, 10


class Encoder(Protocol):
    def encode_batch(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray: ...


def stand_in_vector(text: Column) -> Column:
    return F.array(F.char_length(text).cast("float"), F.lit(1.0).cast("float"), F.lit(0.5).cast("float"))


def stand_in_tokens(text: Column) -> Column:
    return F.least(F.char_length(text), F.lit(LIMIT))


def stand_in_truncated(text: Column) -> Column:
    return F.char_length(text) > LIMIT


def stand_in_score(query: Column, document: Column) -> Column:
    return F.when(F.contains(document, query), F.lit(CONTAINED).cast("float")).otherwise((F.char_length(document).cast("double") / 1000).cast("float"))


def encode_sequences(rows: DataFrame, make: Callable[[], Encoder], limits: Limits, index: str = "idx", ids: str = "ids", pad: int = 0) -> DataFrame:
    """(index, vector): sequences sorted by length inside each partition, cut into batches, padded and encoded.

    Only those two columns reach Python. `make` is called once a worker task. A batch that fails marks its own rows with
    the error and a null vector; the others go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            where = batch.column(index).to_pylist()
            own = [np.asarray(x, np.int64) for x in batch.column(ids).to_pylist()]
            plan = cut([len(x) for x in own], limits)
            vectors: list = [None] * len(own)
            errors: list = [None] * len(own)
            for b in range(plan[-1] + 1 if plan else 0):
                some = [i for i, p in enumerate(plan) if p == b]
                width = max(len(own[i]) for i in some)
                if not width:
                    for i in some:
                        errors[i] = "a sequence without tokens"
                    continue
                block, mask = np.full((len(some), width), pad, np.int64), np.zeros((len(some), width), np.int64)
                for k, i in enumerate(some):
                    block[k, : len(own[i])], mask[k, : len(own[i])] = own[i], 1
                try:
                    for i, v in zip(some, encoder.encode_batch(block, mask), strict=True):
                        vectors[i] = np.asarray(v, np.float32)
                except Exception as e:
                    for i in some:
                        errors[i] = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([pa.array(where, batch.schema.field(index).type), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[index, "vector", "error"])

    kind = dict(rows.dtypes)[index]
    sorted_ = rows.select(index, ids).withColumn("n", F.size(ids)).sortWithinPartitions("n", index).drop("n")
    return sorted_.mapInArrow(run, f"`{index}` {kind}, vector array<float>, error string")


class OnnxEncoder:
    """A model file on ONNX Runtime; one thread each, as tasks are the parallel part."""

    OUTPUTS = ("sentence_embedding", "last_hidden_state", "token_embeddings")

    def __init__(self, path: str, pooling: str = "CLS"):
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        self.session = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
        kinds = {i.name: i.type for i in self.session.get_inputs()}
        if not {"input_ids", "attention_mask"} <= set(kinds) or any(t != "tensor(int64)" for t in kinds.values()):
            raise ValueError(f"unsupported inputs {kinds}")
        outputs = {o.name: len(o.shape) for o in self.session.get_outputs()}
        self.output = next((n for n in self.OUTPUTS if n in outputs), None) or next((n for n, rank in outputs.items() if rank == 3), None)
        if self.output is None:
            raise ValueError(f"no output of token vectors among {sorted(outputs)}")
        self.types, self.pooling = "token_type_ids" in kinds, pooling

    def encode_batch(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        feed = {"input_ids": ids, "attention_mask": mask} | ({"token_type_ids": np.zeros_like(ids)} if self.types else {})
        out = self.session.run([self.output], feed)[0].astype(np.float32)
        if out.ndim == 2:
            return out
        if self.pooling == "CLS":
            return out[:, 0]
        if self.pooling == "LAST_TOKEN":
            return out[np.arange(len(out)), mask.sum(1) - 1]
        return (out * mask[:, :, None]).sum(1) / mask.sum(1, keepdims=True)


class OnnxReranker:
    """A model file whose logits, one a pair, are scores before activation; `types` tell query from document."""

    def __init__(self, path: str):
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        self.session = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
        outputs = {o.name: o.shape for o in self.session.get_outputs()}
        self.output = "logits" if "logits" in outputs else next((n for n, s in outputs.items() if len(s) == 2), None)
        if self.output is None or outputs[self.output][-1] != 1:
            raise ValueError(f"no output of one logit a pair among {outputs}")
        self.types = any(i.name == "token_type_ids" for i in self.session.get_inputs())

    def encode_batch(self, ids: np.ndarray, mask: np.ndarray, types: np.ndarray | None = None) -> np.ndarray:
        feed = {"input_ids": ids, "attention_mask": mask}
        if self.types:
            feed["token_type_ids"] = np.zeros_like(ids) if types is None else types
        return self.session.run([self.output], feed)[0].astype(np.float32)


def pass_metrics(rows: DataFrame, limits: Limits, index: str = "idx", ids: str = "ids") -> DataFrame:
    """(partition, batch, rows, tokens, padding) of the batches that `encode_sequences` makes of the same rows; packed models have no padding."""
    n = rows.select(index, F.size(ids).alias("n")).sortWithinPartitions("n", index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            lengths = batch.column("n").to_pylist()
            plan = cut(lengths, limits)
            own = [[x for x, p in zip(lengths, plan, strict=True) if p == b] for b in range(plan[-1] + 1 if plan else 0)]
            columns = [[part] * len(own), range(seen, seen + len(own)), [len(x) for x in own], [sum(x) for x in own], [0 if limits.packed else len(x) * max(x) - sum(x) for x in own]]
            seen += len(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["partition", "batch", "rows", "tokens", "padding"])

    return n.mapInArrow(run, "partition long, batch long, rows long, tokens long, padding long")


def embed(df: DataFrame, text: str, vector: str = "vector") -> DataFrame:
    """With the lexical stand-in; lazy, like any DataFrame."""
    return df.withColumn(vector, stand_in_vector(F.col(text)))


def rerank(df: DataFrame, query: str, document: str, score: str = "score") -> DataFrame:
    return df.withColumn(score, stand_in_score(F.col(query), F.col(document)))


__all__ = ["Encoder", "OnnxEncoder", "OnnxReranker", "embed", "encode_sequences", "pass_metrics", "rerank", "row"]
