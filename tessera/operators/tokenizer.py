"""Model tokenizers from a tokenizer.json, in Arrow batches; one is loaded once a worker."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word number of special tokens.
SPECIAL = -1

ENCODED = T.StructType(
    [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("word_ids", T.ArrayType(T.LongType())), T.StructField("type_ids", T.ArrayType(T.LongType())), T.StructField("truncated", T.BooleanType())]
)


@lru_cache(4)
def load(path: str, limit: int | None):
    """Truncates to `limit` tokens, specials included, the longer of a pair first; None leaves sequences whole."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    if limit is None:
        t.no_truncation()
    else:
        t.enable_truncation(limit, strategy="longest_first")
    return t


def _rows(encodings) -> pa.Array:
    rows = [{"ids": e.ids, "word_ids": [SPECIAL if w is None else w for w in e.word_ids], "type_ids": e.type_ids, "truncated": bool(e.overflowing)} for e in encodings]
    longs = pa.list_(pa.int64())
    return pa.array(rows, pa.struct([("ids", longs), ("word_ids", longs), ("type_ids", longs), ("truncated", pa.bool_())]))


def encode(text: Column, path: str, limit: int | None = None) -> Column:
    """A struct of ids, word and type ids, and whether anything was cut; null texts are refused."""

    def run(column: pa.Array) -> pa.Array:
        if column.null_count:
            raise ValueError("a text is null")
        return _rows(load(path, limit).encode_batch(column.to_pylist()))

    return F.arrow_udf(run, ENCODED)(text)


def encode_pairs(query: Column, document: Column, path: str, limit: int | None = None) -> Column:
    """The same of pairs; the query is repeated for each of its documents."""

    def run(queries: pa.Array, documents: pa.Array) -> pa.Array:
        if queries.null_count or documents.null_count:
            raise ValueError("a query or document is null")
        return _rows(load(path, limit).encode_batch(list(zip(queries.to_pylist(), documents.to_pylist(), strict=True))))

    return F.arrow_udf(run, ENCODED)(query, document)


def specials(path: str) -> tuple[list[int], list[int]]:
    """Special ids before and behind a single sequence, found by encoding a short one."""
    e = load(path, None).encode("a")
    mask = e.special_tokens_mask
    lead = next((i for i, m in enumerate(mask) if not m), len(mask))
    trail = next((i for i, m in enumerate(reversed(mask)) if not m), 0)
    return e.ids[:lead], e.ids[len(mask) - trail :]


def token_totals(encoded: DataFrame, request: str, index: str, column: str = "encoded") -> DataFrame:
    """(request, prompt_tokens, first_truncated) of the unsplit encodings."""
    cut = F.min(F.when(F.col(f"{column}.truncated"), F.col(index)))
    return encoded.groupBy(request).agg(F.sum(F.size(f"{column}.ids")).cast("long").alias("prompt_tokens"), F.coalesce(cut, F.lit(-1)).alias("first_truncated"))
