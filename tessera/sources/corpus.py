"""Seeded pseudo-texts and workloads, made on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "the of and model query server text vector search index cache batch il di che per modello testo ricerca indice memoria coda".split()
#: Fixed values of the workloads: texts a payload, words a text, and whether a query goes with them.
WORKLOADS = {"query": (1, 6, 16, False), "ingest": (32, 50, 380, False), "rerank": (32, 30, 230, True)}
QUERY_WORDS = (6, 16)
#: What may follow a word inside a text, some twice as often.  Fixed values of the workloads.
MARKS = (".", ",", ";", ".", ",")


def _text(seed: Column, low: int, high: int) -> Column:
    """Low to high words, decided by the hash of the seed alone; a mark behind one word in twelve, a stop behind the last."""
    n = (F.pmod(F.xxhash64(seed, F.lit("n")), F.lit(high - low + 1)) + low).cast("int")
    vocabulary = F.array(*[F.lit(w) for w in WORDS])

    def mark(i: Column) -> Column:
        """One hash decides whether there is a mark, and which."""
        k = F.pmod(F.xxhash64(seed, i, F.lit("mark")), F.lit(12 * len(MARKS))).cast("int")
        return F.coalesce(F.get(F.array(*[F.lit(m) for m in MARKS]), k), F.lit(""))

    def word(i: Column) -> Column:
        w = F.get(vocabulary, F.pmod(F.xxhash64(seed, i), F.lit(len(WORDS))).cast("int"))
        cased = F.when((i == 1) | (mark(i - 1) == "."), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100))).otherwise(w)
        return F.concat(cased, F.when(i == n, ".").otherwise(mark(i)))

    return F.array_join(F.transform(F.sequence(F.lit(1), n), word), " ")


def payloads(spark: SparkSession, workload: str, seed: int, count: int) -> DataFrame:
    """(payload_id, query, texts); the query is null unless documents are reranked for it."""
    texts, low, high, query = WORKLOADS[workload]
    own = F.array(*[_text(F.struct(F.lit(seed), F.lit(workload), F.col("id"), F.lit(k)), low, high) for k in range(texts)])
    q = _text(F.struct(F.lit(seed), F.lit(workload), F.col("id"), F.lit("query")), *QUERY_WORDS) if query else F.lit(None).cast("string")
    return spark.range(count).select(F.col("id").alias("payload_id"), q.alias("query"), own.alias("texts"))
