"""Requests and responses of servers of other dialects."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import dialects


def test_requests(spark):
    df = spark.createDataFrame([("m", "q", ["x", 'y"'])], "m string, q string, d array<string>")
    made = [dialects.embed_request(F.col("m"), F.col("d")), *(dialects.rerank_request(k, F.col("m"), F.col("q"), F.col("d")) for k in dialects.DIALECTS)]
    embed, results, texts = (json.loads(x) for x in df.select(*made).first())
    assert embed == {"model": "m", "input": ["x", 'y"']}
    assert results == {"model": "m", "query": "q", "documents": ["x", 'y"']} and texts == {"query": "q", "texts": ["x", 'y"']}
    with pytest.raises(ValueError, match="unknown dialect"):
        dialects.rerank_request("other", F.col("m"), F.col("q"), F.col("d"))


@pytest.mark.parametrize(
    "body,documents,want",
    [
        ('{"results":[{"index":2,"relevance_score":0.5},{"index":0,"relevance_score":0.25}]}', 3, [0.25, 0, 0.5]),
        (' [{"index":1,"score":2},{"index":0,"score":-1.5}]', 2, [-1.5, 2]),
        ('[{"index":0,"score":1},{"index":0,"score":3}]', 1, [3]),
        ("[]", 2, [0, 0]),
        ('{"results":[]}', 0, []),
        (None, 1, [0]),
    ],
)
def test_scores(spark, body, documents, want):
    df = spark.createDataFrame([(body, documents)], "body string, n int")
    assert dialects.scores(df, "body", "n").first().scores == want


def test_an_index_that_no_document_has(spark):
    df = spark.createDataFrame([('[{"index":2,"score":1}]', 2)], "body string, n int")
    with pytest.raises(Exception, match="no document has"):
        dialects.scores(df, "body", "n").collect()


def test_embeddings(spark):
    body = '{"data":[{"index":1,"embedding":[0.1,2]},{"index":0,"embedding":[3,4.5]}],"model":"m"}'
    df = spark.createDataFrame([(body,), ("{}",)], "body string")
    first, second = (r.vectors for r in dialects.embeddings(df, "body").collect())
    assert first == [[3, 4.5], [pytest.approx(0.1), 2]] and second == []
