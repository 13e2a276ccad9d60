"""Whole routes on the stand-in's golden requests."""

import base64
import json

import numpy as np
import pytest

from tessera.plans import service

MODELS = "SELECT * FROM VALUES ('fake-embed', 'embed', 3, 20), ('fake-rerank', 'rerank', CAST(NULL AS INT), 20) AS m(name, task, dimension, max_input_tokens)"


@pytest.fixture
def ask(spark):
    def run(route, *bodies, version=2):
        df = spark.createDataFrame([(f"r{i}", version, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "request_id string, version int, body string")
        return [(r.status, json.loads(r.body)) for r in route(df, spark.sql(MODELS)).orderBy("request_id").collect()]

    return run


def test_embed(ask):
    m = {"model": "fake-embed"}
    (s1, plain), (s2, typed) = ask(service.embed, {"texts": ["ab", "abcd"]}, {"texts": ["ab"], "embedding_types": ["float"]}, version=1)
    assert (s1, s2) == (200, 200) and plain["response_type"] == "embeddings_floats" and [v[0] for v in plain["embeddings"]] == [2, 4] and plain["meta"]["api_version"]["version"] == "1" and plain["meta"]["tokens"]["input_tokens"] == 6
    assert typed["response_type"] == "embeddings_by_type"
    answers = ask(service.embed, m | {"texts": ["abc"]}, m | {"inputs": [{"content": [{"type": "text", "text": "abc"}]}]}, {"texts": ["a"]}, m | {"texts": ["a", "x" * 21]}, m | {"texts": ["a", "x" * 21], "truncate": "NONE"}, '{"texts": [')
    assert answers[0][1]["embeddings"] == answers[1][1]["embeddings"] == {"float": [[3, 1, 0.5]]} and "response_type" not in answers[0][1]
    assert [a[0] for a in answers[2:]] == [400, 200, 400, 400]
    assert answers[2][1]["message"] == "model is required" and answers[4][1]["message"].startswith("texts[1] exceeds") and answers[5][1]["message"].startswith("invalid request body") and answers[5][1]["id"] == "r5"


def test_rerank(ask):
    m, docs = {"model": "fake-rerank", "query": "cat"}, ["dogs", "a cat sleeps", "a very long document about nothing"]
    answers = ask(service.rerank, m | {"documents": docs, "top_n": 2}, m | {"documents": [{"text": "dogs"}, "a cat"], "return_documents": True}, m | {"documents": []}, m | {"documents": [{"title": "x"}]}, {"model": "fake-rerank", "documents": docs}, m | {"documents": docs, "rank_fields": ["x"]}, m | {"documents": docs, "top_n": 0})
    first, second = answers[0][1], answers[1][1]
    assert [r["index"] for r in first["results"]] == [1, 2] and first["results"][0]["relevance_score"] == pytest.approx(0.9) and first["meta"]["billed_units"] == {"search_units": 1} and "document" not in first["results"][0]
    assert second["results"][0] == {"index": 1, "relevance_score": pytest.approx(0.9), "document": {"text": "a cat"}} and second["results"][1]["document"] == {"text": "dogs"}
    assert [a[0] for a in answers[2:]] == [400] * 5


def test_openai(ask):
    m = {"model": "fake-embed"}
    answers = ask(service.openai, m | {"input": ["ab", "abcd"]}, m | {"input": "abcd", "encoding_format": "base64"}, {"model": "x", "input": "a"}, m | {"input": [1, 2]}, m | {"input": "x" * 21}, m | {"input": "a", "dimensions": 2}, m | {"input": ""}, {"model": "fake-rerank", "input": "a"})
    first = answers[0][1]
    assert [d["embedding"] for d in first["data"]] == [[2, 1, 0.5], [4, 1, 0.5]] and first["usage"] == {"prompt_tokens": 6, "total_tokens": 6} and first["model"] == "fake-embed"
    assert np.frombuffer(base64.b64decode(answers[1][1]["data"][0]["embedding"]), "<f4").tolist() == [4, 1, 0.5]
    assert [a[0] for a in answers[2:]] == [404] + [400] * 5 and answers[2][1]["error"] == {"message": "The model 'x' does not exist", "type": "invalid_request_error", "param": None, "code": "model_not_found"}
    assert "token-id" in answers[3][1]["error"]["message"] and answers[4][1]["error"]["message"].startswith("input[0] exceeds the maximum context length of 20")
