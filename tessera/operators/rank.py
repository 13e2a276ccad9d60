"""Ranking of scored documents, top n, and units billed for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(scores: DataFrame, request: str, index: str, score: str, top_n: int | Column | None = None) -> DataFrame:
    """Adds `rank`, from 1: descending score, NaN first and 0.0 before -0.0, ties by ascending index; the first `top_n` are kept.

    A literal bound becomes a group limit before the shuffle; a column is a filter behind the ranking.
    """
    negative_zero = (F.col(score) == 0) & (F.col(score).cast("string") == "-0.0")
    w = Window.partitionBy(request).orderBy(F.desc(score), negative_zero, F.col(index))
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if top_n is None else out.where(F.col("rank") <= top_n)


def argmax(rows: DataFrame, group: str, index: str, value: str) -> DataFrame:
    """(group, index, value) of the largest value, the first of equals; a sort-free aggregate with map-side combining."""
    best = F.max_by(F.struct(F.col(index).alias("i"), F.col(value).alias("v")), F.struct(F.col(value), -F.col(index)))
    return rows.groupBy(group).agg(best.alias("b")).select(group, F.col("b.i").alias(index), F.col("b.v").alias(value))


def search_units(documents: Column) -> Column:
    """One unit for every hundred documents begun."""
    return F.floor((documents + 99) / 100).cast("long")


def overlap_scores(queries: DataFrame, documents: DataFrame, query: str, document: str, text: str = "text") -> DataFrame:
    """(query, document, score): share of the query's distinct words that the document holds, for pairs that share one.

    Each side is tokenized once and the two meet on words, so no pair without a common word is ever made. Documents are dealt
    out by their id first, as words: where the queries' words are few enough for Spark to send them to every task, a
    document's matches are then counted, and a bound on the rank applied, where they are made, and no pair is shuffled.
    """
    tokens = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))
    q = queries.select(query, tokens.alias("t")).select(query, F.size("t").alias("n"), F.explode("t").alias("token"))
    d = documents.select(document, tokens.alias("t")).repartition(document).select(document, F.explode("t").alias("token"))
    return d.join(q, "token").groupBy(query, document).agg((F.count("*") / F.max("n")).alias("score"))


def holding(queries: DataFrame, documents: DataFrame, query: str, document: str, text: str = "text") -> DataFrame:
    """(query, document): pairs whose document has the query's whole text in it.

    A text's words, its first and last apart, stand between spaces wherever it is found; so its longest inner word finds
    the documents to look into. Texts without an inner word are looked for in all documents.
    """
    words = lambda c: F.split(c, " ")
    inner = F.filter(F.slice(words(F.col(text)), 2, F.greatest(F.size(words(F.col(text))) - 2, F.lit(0))), lambda w: w != "")
    anchor = F.element_at(F.sort_array(F.transform(inner, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w")))), -1)["w"]
    q = queries.select(query, F.col(text).alias("wanted"), F.when(F.size(inner) > 0, anchor).alias("word"))
    d = documents.select(document, F.col(text).alias("own"))
    # words go without their text; the few pairs that share an anchor come back for it
    by_word = d.select(document, F.explode(F.array_distinct(words(F.col("own")))).alias("word")).join(q.where("word is not null"), "word")
    short = d.join(q.where("word is null").drop("word"), F.contains("own", "wanted"))
    found = d.join(by_word.select(query, document, "wanted"), document).where(F.contains("own", "wanted"))
    return found.select(query, document).unionByName(short.select(query, document))
