"""Pairing, scoring, ranking, top n, and the responses made of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import sigmoid
from ..operators import encode, rank
from .common import table

TOP = 10
_TOKENS = r"list_filter(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')), lambda x: x <> '')"


def rerank_topn(spark, sf_dir):
    """The flagship: for every benchmark item its ten best documents by word overlap, with the units billed for all candidates."""
    documents = table(spark, sf_dir, "documents")
    scores = rank.overlap_scores(table(spark, sf_dir, "benchmark"), documents, "item_id", "doc_id")
    units = documents.agg(rank.search_units(F.count("*")).alias("search_units"))
    best = rank.ranked(scores, "item_id", "doc_id", "score", TOP)
    return best.join(F.broadcast(units)).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"), "search_units")


RERANK_TOPN = f"""
WITH q AS (SELECT item_id, len(t) AS n, unnest(t) AS token FROM (SELECT item_id, {_TOKENS} AS t FROM benchmark)),
d AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents),
s AS (SELECT item_id, doc_id, CAST(count(*) AS DOUBLE) / max(n) AS score FROM q JOIN d USING (token) GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT item_id, doc_id, rank, round(score, 6) AS score, (SELECT CAST((count(*) + 99) // 100 AS BIGINT) FROM documents) AS search_units FROM r WHERE rank <= {TOP}"""


def _best(spark, sf_dir, n):
    """(item_id, doc_id, score): of the stand-in's scores of every document for every item, each item's `n` best and some more.

    A document that holds the item's text scores alike wherever it does; all others score by length alone. So the best are
    among those that hold it and the longest of all documents, of which as many are taken as the item's holders, which
    leave their places, cannot use up.
    """
    items, documents = (table(spark, sf_dir, t) for t in ("benchmark", "documents"))
    held = rank.holding(items, documents, "item_id", "doc_id")
    size = n
    while True:
        longest = documents.select("doc_id", F.char_length("text").alias("n"), "text").orderBy(F.desc("n"), "doc_id").limit(size)
        displaced = rank.holding(items, longest, "item_id", "doc_id").groupBy("item_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        if size - displaced >= n or longest.count() < size:
            break
        size *= 2
    # as many rows as are asked for, beside every item
    beside = items.select("item_id", F.col("text").alias("query")).join(F.broadcast(longest.select("doc_id", "text")))
    by_length = encode.rerank(beside, "query", "text").select("item_id", "doc_id", "score")
    by_text = held.select("item_id", "doc_id", F.lit(encode.CONTAINED).cast("float").alias("score"))
    return by_length.unionByName(by_text).distinct()


_FAKE = "CASE WHEN contains(text, query) THEN 0.9::FLOAT ELSE CAST(CAST(length(text) AS DOUBLE) / 1000 AS FLOAT) END"
_PAIRS = "pairs AS (SELECT item_id, b.text AS query, doc_id, d.text FROM benchmark b CROSS JOIN documents d)"


def rerank_fake(spark, sf_dir):
    """The stand-in's scores over all documents, the ten best of each item, with tokens and units of the whole request."""
    total = table(spark, sf_dir, "documents").agg(rank.search_units(F.count("*")).alias("search_units"), (F.count("*") * encode.PER_DOCUMENT).alias("input_tokens"))
    best = rank.ranked(_best(spark, sf_dir, TOP), "item_id", "doc_id", "score", TOP)
    # `total` is a single row
    return best.join(F.broadcast(total)).select("item_id", "doc_id", "rank", F.round(F.col("score").cast("double"), 6).alias("score"), "search_units", "input_tokens")


RERANK_FAKE = f"""
WITH {_PAIRS}, s AS (SELECT item_id, doc_id, {_FAKE} AS score FROM pairs),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s),
t AS (SELECT item_id, CAST((count(*) + 99) // 100 AS BIGINT) AS search_units, count(*) * 10 AS input_tokens FROM s GROUP BY item_id)
SELECT item_id, doc_id, rank, round(CAST(score AS DOUBLE), 6) AS score, search_units, input_tokens FROM r JOIN t USING (item_id) WHERE rank <= {TOP}"""


def pair_counts(spark, sf_dir):
    """Documents paired with each query, and their characters: every query meets every document, so the table's totals say it."""
    total = table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.sum(F.char_length("text")).cast("long").alias("n_chars"))
    return table(spark, sf_dir, "benchmark").select("item_id").join(F.broadcast(total))  # a single row


PAIR_COUNTS = f"WITH {_PAIRS} SELECT item_id, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM pairs GROUP BY item_id"


def top_n_per_request(spark, sf_dir):
    """The bound comes with each request: 1 + item_id % 5."""
    return rank.ranked(_best(spark, sf_dir, 5), "item_id", "doc_id", "score", 1 + F.col("item_id") % 5).select("item_id", "doc_id", "rank")


TOP_N = f"""
WITH {_PAIRS}, r AS (SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY {_FAKE} DESC, doc_id) AS INTEGER) AS rank FROM pairs)
SELECT item_id, doc_id, rank FROM r WHERE rank <= 1 + item_id % 5"""


def holding_counts(spark, sf_dir):
    """In how many documents each item's whole text is found."""
    items = table(spark, sf_dir, "benchmark")
    found = rank.holding(items, table(spark, sf_dir, "documents"), "item_id", "doc_id").groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))


HOLDING = f"WITH {_PAIRS} SELECT item_id, count(*) FILTER (WHERE contains(text, query)) AS documents FROM pairs GROUP BY item_id"


def sigmoid_scores(spark, sf_dir):
    logit = (F.get("embedding", F.lit(0)) * F.lit(10.0).cast("float")).cast("float")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(sigmoid(logit).cast("double"), 6).alias("score"))


SIGMOID = "SELECT vec_id, round(CAST(CAST(1 / (1 + exp(-CAST(embedding[1] * 10::FLOAT AS DOUBLE))) AS FLOAT) AS DOUBLE), 6) AS score FROM embeddings"


def argmax_per_label(spark, sf_dir):
    """Per label the vector with the largest first component, the first of equals."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    return rank.argmax(rows, "label", "vec_id", "x")


ARGMAX = "SELECT label, vec_id, CAST(x AS DOUBLE) AS x FROM (SELECT label, vec_id, embedding[1] AS x, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rn FROM embeddings) WHERE rn = 1"


def planted_first(spark, sf_dir):
    """Items that some document contains word for word, and whether a containing document is ranked first."""
    scores = rank.overlap_scores(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id")
    first = rank.ranked(scores, "item_id", "doc_id", "score", 1).select("item_id", F.col("doc_id").alias("first_doc"), "score")
    return first.select("item_id", (F.round("score", 6) == 1).alias("all_words"), "first_doc")


PLANTED = RERANK_TOPN.replace("SELECT item_id, doc_id, rank, round(score, 6) AS score, (SELECT CAST((count(*) + 99) // 100 AS BIGINT) FROM documents) AS search_units FROM r WHERE rank <= 10", "SELECT item_id, round(score, 6) = 1 AS all_words, doc_id AS first_doc FROM r WHERE rank = 1")


#: A request is a bounded range of ids inside a source.
REQUEST = 1024


def realigned_scores(spark, sf_dir):
    """Every request's results, ranked, as rows that go back to their document by its index: (request, doc_id, rank, score)."""
    request = F.concat_ws(":", "source", F.floor(F.col("doc_id") / REQUEST).cast("string"))
    scored = table(spark, sf_dir, "documents").select(request.alias("request"), "doc_id", encode.stand_in_score(F.lit("license"), F.col("text")).alias("score"))
    best = rank.ranked(scored, "request", "doc_id", "score")
    return best.select("request", "doc_id", "rank", F.round(F.col("score").cast("double"), 6).alias("score"))


REALIGNED = f"""
WITH s AS (SELECT source || ':' || (doc_id // {REQUEST}) AS request, doc_id, {_FAKE.replace("query", "'license'")} AS score FROM documents)
SELECT request, doc_id, CAST(row_number() OVER (PARTITION BY request ORDER BY score DESC, doc_id) AS INTEGER) AS rank, round(CAST(score AS DOUBLE), 6) AS score FROM s"""

QUERIES = {
    "rerank_topn": (rerank_topn, RERANK_TOPN), "rerank_fake": (rerank_fake, RERANK_FAKE), "pair_counts": (pair_counts, PAIR_COUNTS), "top_n_per_request": (top_n_per_request, TOP_N),
    "sigmoid_scores": (sigmoid_scores, SIGMOID), "argmax_per_label": (argmax_per_label, ARGMAX), "planted_first": (planted_first, PLANTED), "realigned_scores": (realigned_scores, REALIGNED),
    "holding_counts": (holding_counts, HOLDING),
}
