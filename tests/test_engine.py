"""Golden values of windows, plans, rounds, requests, models, configuration, evaluation and streaming."""

import base64
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import scalars, vectors
from tessera.operators import encode, evaluate, planner, pooling, rank, requests, respond, tokens
from tessera.sources import corpus, models, prometheus, reports
from tessera.streaming import admission


def spans(spark, word_ids, limit):
    df = spark.createDataFrame([(word_ids,)], "w array<int>")
    return [tuple(x) for x in df.select(tokens.windows(F.col("w"), limit).alias("x")).first().x]


def test_windows(spark):
    assert spans(spark, [-1, 0, 1, -1], 8) == [(0, 4, 4, False, 4)]
    assert [s[:2] for s in spans(spark, [-1, 0, 0, 1, 1, 1, 2, 3, -1], 6)] == [(1, 3), (3, 7), (7, 8)]
    assert spans(spark, [-1, 0, 0, 0, 0, 0, -1], 4) == [(1, 3, 4, True, 2), (3, 5, 4, True, 2), (5, 6, 3, True, 1)]
    many = spans(spark, [-1, *range(100), -1], 12)
    assert len(many) == 10 and many[-1][1] == 101
    with pytest.raises(ValueError, match="no room"):
        tokens.windows(F.col("w"), 2)


def batches(lengths, limits):
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    return order, planner.cut([lengths[i] for i in order], limits)


@pytest.mark.parametrize(
    "lengths,limits,sizes",
    [
        ([5, 2, 9, 2], planner.Limits(10, 1000), [4]), ([40, 10, 10, 40, 10], planner.Limits(64, 60, 1), [3, 1, 1]), ([1] * 5, planner.Limits(2, 1000), [2, 2, 1]), ([500, 3], planner.Limits(8, 100, 1), [1, 1]),
        ([40, 10, 10, 40, 10], planner.Limits(64, 60, 1, True, True), [3, 1, 1]), ([40, 10, 10, 40, 10], planner.Limits(64, 100, 1, True, True), [4, 1]),
    ],
)
def test_batches(lengths, limits, sizes):
    order, plan = batches(lengths, limits)
    assert [plan.count(b) for b in range(max(plan) + 1)] == sizes
    if lengths == [5, 2, 9, 2]:
        assert order == [1, 3, 0, 2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 600), max_size=60), st.integers(1, 20), st.integers(1, 2000), st.booleans(), st.booleans())
def test_batches_keep_their_bounds(lengths, rows, budget, packed, half):
    limits = planner.Limits(rows, budget, 1, packed, half)
    order, plan = batches(lengths, limits)
    assert len(plan) == len(lengths) and plan == sorted(plan)
    for b in set(plan):
        own = [lengths[order[i]] for i, p in enumerate(plan) if p == b]
        cost = sum(own) if packed else len(own) * max(own)
        assert len(own) == 1 or (len(own) <= rows and cost <= limits.budget and len(own) * max(own) <= limits.padded_tokens)


def test_limits():
    assert planner.Limits(1024, 16384, 8192).padded_tokens == 16384 and planner.Limits(1024, 16384, 8192, True, True).padded_tokens == 65536 and planner.Limits(1, 100, 512).budget == 512


def test_padding(spark):
    plan = spark.createDataFrame([("r", 0, n) for n in (100, 100, 40, 10)], "g string, batch int, len long")
    assert planner.batch_metrics(plan, "g", "len").first().padding == 150 and planner.batch_metrics(plan, "g", "len", packed=True).first().padding == 0


def test_fair_round(spark):
    rows = spark.createDataFrame([("large", i, 10) for i in range(100)] + [("small", 0, 10), ("gone", 0, 10)], "job string, idx int, len int")
    jobs = spark.createDataFrame([("large", False), ("small", False), ("gone", True)], "job string, done boolean")
    got = planner.fair_round(rows, jobs, "job", "idx", "len", 10, "done").groupBy("job").count().collect()
    assert {r.job: r["count"] for r in got} == {"large": 1, "small": 1}  # 40 tokens among three jobs


def test_pooling(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (1, 2, [5.0, 9.0]), (2, 0, [7.0, 7.0])], "o int, p int, v array<float>")
    get = lambda mode: {r.o: list(r.v) for r in pooling.pool(df, mode, "o", "p", "v").collect()}
    assert get("CLS") == {1: [1, 2], 2: [7, 7]} and get("LAST_TOKEN") == {1: [5, 9], 2: [7, 7]} and get("MEAN") == {1: [3, 5], 2: [7, 7]}
    w = df.withColumnRenamed("p", "weight").withColumn("weight", F.col("weight") + 1)
    assert list(pooling.combine_windows(w, "o", "v", normalize=False).where("o = 1").first().v) == pytest.approx([22 / 6, 37 / 6])
    assert np.linalg.norm(pooling.combine_windows(w, "o", "v").where("o = 1").first().v) == pytest.approx(1, abs=1e-6)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(vectors.l2_normalize(F.col("a")).alias("n"), vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.base64_floats(F.col("a")).alias("s")).collect()
    assert list(rows[0].n) == pytest.approx([0.6, 0.8]) and list(rows[1].n) == [0, 0] and rows[0].c == pytest.approx(0.96) and np.isnan(rows[1].c)
    assert [np.frombuffer(base64.b64decode(r.s), "<f4").tolist() for r in rows] == [[3, 4], [0, 0]]
    wide = spark.createDataFrame([([float(i) for i in range(200)],)], "a array<float>")
    assert "\n" not in wide.select(vectors.base64_floats(F.col("a"))).first()[0]


def test_ranking(spark):
    scores = [0.5, float("nan"), -0.0, 0.0, 0.9, 0.5]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "r int, i int, s float")
    assert [r.i for r in rank.ranked(df, "r", "i", "s").orderBy("rank").collect()] == [1, 4, 0, 5, 3, 2]
    assert rank.argmax(df.where("i <> 1"), "r", "i", "s").first().i == 4
    units = spark.createDataFrame([(1,), (100,), (101,), (250,)], "n int").select(rank.search_units(F.col("n")).alias("u")).collect()
    assert [r.u for r in units] == [1, 1, 2, 3]
    assert "WindowGroupLimit" in rank.ranked(df, "r", "i", "s", 2)._jdf.queryExecution().toString()


MODELS = "SELECT * FROM VALUES ('fake-embed', 'embed', 3, 20), ('fake-rerank', 'rerank', CAST(NULL AS INT), 20) AS m(name, task, dimension, max_input_tokens)"


def embed(spark, body, version=2):
    df = requests.parse(spark.createDataFrame([(json.dumps(body), version)], "body string, version int"), requests.EMBED)
    out = requests.route(df, spark.sql(MODELS), "embed").select(requests.validate_embed().alias("v")).first().v
    return out.status, out.message


def test_embed_requests(spark):
    m = {"model": "fake-embed", "texts": ["abc"]}
    assert embed(spark, m) == (200, None) and embed(spark, {"texts": ["a"]}, 1) == (200, None) and embed(spark, {"texts": ["a"]}) == (400, "model is required")
    assert embed(spark, m | {"model": "x"})[0] == 404 and embed(spark, m | {"model": "fake-rerank"}) == (400, "model 'fake-rerank' does not support embed")
    for bad in ({"images": ["x"]}, {"texts": []}, {"texts": None}, {"texts": ["a", None]}, {"input_type": "x"}, {"embedding_types": ["int8"]}, {"output_dimension": 256}, {"max_tokens": 5}, {"truncate": "START"}, {"truncate": "x"}):
        assert embed(spark, m | bad)[0] == 400, bad
    for fine in ({"output_dimension": 3}, {"max_tokens": 20}, {"truncate": "end"}, {"embedding_types": ["float"]}, {"priority": 3, "unknown": 1}):
        assert embed(spark, m | fine)[0] == 200, fine
    part = lambda *c: {"model": "fake-embed", "inputs": [{"content": [{"type": "text", "text": "a"}]}, {"content": list(c)}]}
    assert embed(spark, part({"type": "text", "text": "b"}))[0] == 200 and embed(spark, part({"type": "text", "text": "b"}), 1)[1] == "inputs is a v2 field: use texts"
    assert embed(spark, part())[1] == "inputs[1] must hold exactly one text content part" and embed(spark, part({"type": "x"}))[1] == "inputs[1]: only text content is supported" and embed(spark, part({"type": "text"}))[1] == "inputs[1] has no text"


def test_polymorphic_bodies(spark):
    bodies = ['{"documents": ["a", {"text": "b"}, {"title": "c"}, null, 3]}', '{"texts": [', "[1]", "3", '{"input": "x"}', '{"input": ["x", null]}', '{"input": [1]}', '{"input": [["x"]]}', '{"input": {"a": 1}}', '{"input": [true]}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    texts, message = requests.input_texts(F.col("body"))
    rows = requests.parse(df, "model string").select("i", "malformed", requests.document_texts(F.col("body")).alias("d"), texts.alias("t"), message.alias("m")).orderBy("i").collect()
    assert rows[0].d[:2] == ["a", "b"] and rows[0].d[2] is None and rows[0].d[3] is None
    assert [r.malformed for r in rows[:5]] == [False, True, True, True, False]
    assert rows[4].t == ["x"] and rows[5].t == ["x", None] and [r.m for r in rows[6:]] == ["token-id inputs are not supported, send text"] * 2 + ["input must be a string or an array of strings"] * 2


def test_stand_in(spark):
    df = spark.createDataFrame([("cat", "dogs"), ("cat", "a cat sleeps"), ("cat", "a very long document about nothing")], "q string, d string")
    got = encode.rerank(encode.embed(df, "d"), "q", "d").select("vector", F.round("score", 6).alias("s"), encode.stand_in_tokens(F.col("d")).alias("n")).collect()
    assert [round(r.s, 6) for r in got] == [0.004, 0.9, 0.034] and list(got[0].vector) == [4, 1, 0.5] and got[2].n == 20


def sums():
    class Sums:  # local, so that workers get it by value
        def encode_batch(self, ids, mask):
            if (ids == 666).any():
                raise RuntimeError("no")
            return (ids * mask).sum(1, keepdims=True).astype("f4")

    return Sums


def test_encoding_does_not_depend_on_batches(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [int(x) for x in rng.integers(1, 100, rng.integers(1, 50))]) for i in range(200)]
    df = spark.createDataFrame([*rows, (200, []), (201, [666])], "idx int, ids array<bigint>").repartition(3)
    for limits in (planner.Limits(4, 100, 50), planner.Limits(64, 4096, 50)):
        got = {r.idx: r for r in encode.encode_sequences(df, sums(), limits).collect()}
        assert all(list(got[i].vector) == [sum(x)] for i, x in rows if got[i].error is None)
        assert got[200].vector is None and "no" in got[201].error and sum(r.error is not None for r in got.values()) <= 2 + limits.max_rows


def test_pass_metrics(spark):
    df = spark.createDataFrame([(i, [1] * n) for i, n in enumerate([100, 100, 40, 10])], "idx int, ids array<bigint>").coalesce(1)
    one = encode.pass_metrics(df, planner.Limits(64, 400, 1)).first()
    assert (one.rows, one.tokens, one.padding) == (4, 250, 150)
    assert encode.pass_metrics(df, planner.Limits(64, 400, 1, True)).first().padding == 0


def test_responses(spark):
    df = spark.createDataFrame([("r", 1, True, [[2.0, 1.0]], ["ab"], 2), ("s", 1, False, [[2.0]], ["a"], 1), ("t", 2, False, [[2.0]], ["a"], 1)], "id string, v int, by boolean, x array<array<float>>, t array<string>, n int")
    one, two, three = (json.loads(r[0]) for r in df.select(respond.embed_body(*(F.col(c) for c in ("id", "v", "by", "x", "t", "n")))).collect())
    assert one["response_type"] == "embeddings_by_type" and one["embeddings"] == {"float": [[2, 1]]} and two["response_type"] == "embeddings_floats" and two["embeddings"] == [[2]]
    assert "response_type" not in three and three["embeddings"] == {"float": [[2]]} and three["meta"] == {"api_version": {"version": "2"}, "billed_units": {"input_tokens": 1}, "tokens": {"input_tokens": 1}}
    o = json.loads(df.select(respond.openai_body(F.lit("m"), F.col("x"), F.col("n"))).first()[0])
    assert o["data"][0] == {"object": "embedding", "index": 0, "embedding": [2, 1]} and o["usage"] == {"prompt_tokens": 2, "total_tokens": 2}
    with pytest.raises(Exception, match="not finite"):
        spark.range(1).select(respond.check_finite(F.array(F.lit(float("nan"))))).collect()


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def sized(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def graph(ops, weights=()):
    nodes = b"".join(sized(1, sized(4, op.encode()) + (sized(7, domain.encode()) if domain else b"")) for op, domain in ops)
    return sized(7, nodes + b"".join(sized(5, varint(2 << 3) + varint(w) + sized(9, b"\0" * 300)) for w in weights))


def test_graphs(spark, tmp_path):
    g = models.graph_of(graph([("MatMul", ""), ("MatMul", ""), ("Attention", "com.microsoft"), ("Softmax", "ai.onnx")], (10, 10, 7)))
    assert g.operators == {"MatMul": 2, "com.microsoft.Attention": 1, "Softmax": 1} and g.attention == "FUSED" and g.half
    assert not models.graph_of(graph([], (1, 1, 7))).half and models.graph_of(graph([("PackedAttention", "com.microsoft")])).attention == "PACKED"
    assert models.graph_of(graph([("Softmax", "")])).attention == "UNFUSED" and models.graph_of(b"\x3a\xff").attention == "UNKNOWN"
    (tmp_path / "m.onnx").write_bytes(graph([("Softmax", "")]))
    assert {r.operator: r.n for r in models.graphs(spark.read.format("binaryFile").load(str(tmp_path))).collect()} == {"Softmax": 1, "attention:UNFUSED": 1}


def directory(tmp_path, files, model="model.onnx"):
    for name, content in {"tokenizer.json": {}, **files}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(content))
    if model:
        (tmp_path / model).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / model).write_bytes(b"")
    return models.open_directory(str(tmp_path))


XLM = {"model_type": "xlm-roberta", "max_position_embeddings": 8194, "pad_token_id": 1, "hidden_size": 1024}


@pytest.mark.parametrize(
    "files,limit",
    [
        ({"config.json": XLM, "tokenizer_config.json": {"model_max_length": 8192}}, 8192), ({"sentence_bert_config.json": {"max_seq_length": 256}, "tokenizer_config.json": {"model_max_length": 512}}, 256),
        ({"config.json": XLM, "tokenizer_config.json": {"model_max_length": 1e30}}, 8192), ({"config.json": {"model_type": "bert", "max_position_embeddings": 512}}, 512),
    ],
)
def test_model_directories(tmp_path, files, limit):
    assert directory(tmp_path, files, "onnx/model.onnx").limit == limit


def test_model_directories_refused(tmp_path):
    limit = {"sentence_bert_config.json": {"max_seq_length": 256}}
    pooled = lambda *on: limit | {"1_Pooling/config.json": {f"pooling_mode_{k}": True for k in on}}
    assert directory(tmp_path / "a", pooled("mean_tokens")).pooling == "MEAN"
    for name, files, model in (("b", pooled("mean_tokens", "cls_token"), "model.onnx"), ("c", limit, None), ("d", {}, "model.onnx")):
        with pytest.raises(ValueError):
            directory(tmp_path / name, files, model)


def test_configuration(tmp_path):
    path = tmp_path / "c.yaml"

    def load(text):
        path.write_text(text)
        return config.load(str(path))

    assert load("# nothing\n") == config.Config() and config.Config().server.port == 8080
    c = load("server: {port: 0, api-keys: [k]}\nmodels:\n- {name: a, task: Embed, path: m/a, pooling: last-token, max-batch-size: 4, device: 'cuda:1'}\n- {name: b, task: rerank, path: /m/b, activation: none}\n")
    assert c.models[0].path == str(tmp_path / "m/a") and c.models[0].embedding.pooling == "LAST_TOKEN" and c.models[0].engine.max_batch_size == 4 and c.models[1].rerank.activation == "NONE" and c.models[1].path == "/m/b"
    assert (c.models[1].engine.token_budget, c.models[1].engine.max_queued_inputs) == (16384, 8192)
    one = "models:\n- {name: a, task: embed, path: m"
    for bad in (one + ", activation: none}", one + ", max-batch-size: 0}", "server: {api-keys: ['']}", one + ", device: tpu}", one + ", prot: 1}", one + "}\n- {name: a, task: embed, path: m}", "models:\n- {name: a, path: m}", "server: {port: 70000}", "x: 1"):
        with pytest.raises(ValueError):
            load(bad)
    assert config.token_limit(0, 512) == 512 and config.token_limit(100, 512) == 100
    with pytest.raises(ValueError):
        config.token_limit(513, 512)


def test_prometheus(spark):
    text = "# TYPE x counter\ntokens{model=\"m\",kind=\"real\"} 20\ntokens{model=\"m\",kind=\"real\"} 5.0\ntokens{model=\"n\",kind=\"real\"} 22\ntokens_other 9\nbad line x\ngc 1.0E9\n"
    m = prometheus.parse(spark.createDataFrame([(x,) for x in text.split("\n")], "value string"))
    total = lambda *a: prometheus.total(m, *a).first().total
    assert (total("tokens"), total("tokens", 'model="m"'), total("gc"), total("tok")) == (47, 25, 1e9, 0)
    assert sorted(r.value for r in prometheus.expose(m).collect())[0].startswith("gc ")


def test_comparison(spark):
    rows = [("query", 1, "own", 40.0, 1.0, 10, 0), ("query", 1, "tei", 20.0, 2.0, 10, 0), ("query", 1, "x", 10.0, 4.0, 10, 0), ("query", 1, "bad", 10.0, 4.0, 10, 5), ("query", 2, "tei", 1.0, 1.0, 1, 0)]
    df = spark.createDataFrame(rows, "workload string, concurrency int, target string, rps double, p99 double, requests int, errors int")
    got = {r.target: (r.throughput_ratio, r.p99_ratio, r.marker) for r in evaluate.compare_runs(df, "own").collect()}
    assert got == {"tei": (2.0, 0.5, None), "x": (4.0, 0.25, None), "bad": (None, None, "invalid: errors")}
    checks = spark.createDataFrame([("tei", 0.97, 0.2, False), ("ok", 1.0, 0.001, True), ("nan", float("nan"), 0.0, True)], "target string, min_cosine double, max_diff double, planted_first boolean")
    assert {r.target: list(r.failures) for r in evaluate.agreement(checks).collect()} == {"tei": ["cosine", "score", "planted"], "ok": [], "nan": ["cosine"]}


def test_percentile_sketch_is_close(spark):
    df = spark.range(20000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    p = evaluate.percentile_sketch(df, ["g"], "v").first().p
    assert p == pytest.approx([10000, 18000, 19800], abs=40)


def test_reports(spark):
    df = spark.createDataFrame([("query", "tei", 4, 10.25, float("nan"), 2.0, None)], "workload string, target string, concurrency int, rps double, p50 double, p90 double, p99 double")
    line = reports.markdown_rows(df).first().value
    assert line == "| query | TEI | 4 | 10.3 | - | 2.0 | - |"
    back = reports.read_markdown(spark.createDataFrame([("| workload | target | concurrency | rps | p50 | p90 | p99 |",), (line,)], "value string")).collect()
    assert len(back) == 1 and (back[0].rps, back[0].p50, back[0].p90) == (10.3, None, 2.0)
    assert json.loads(reports.json_rows(df).first().value) == {"workload": "query", "target": "tei", "concurrency": 4, "rps": 10.25, "p90": 2.0}


def test_format_bytes(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1536.0, 1048575.0, 1048576.0, 2.5 * 1048576, float("nan"), float("inf"), None)], "x double")
    assert [r[0] for r in df.select(scalars.format_bytes(F.col("x"))).collect()] == ["0 KiB", "2 KiB", "1024 KiB", "1.0 MiB", "2.5 MiB", "-", "-", "-"]


def test_corpus(spark):
    get = lambda w, seed: corpus.payloads(spark, w, seed, 5).collect()
    assert get("rerank", 1) == get("rerank", 1) != get("rerank", 2)
    for r in get("rerank", 1):
        assert len(r.texts) == 32 and 6 <= len(r.query.split()) <= 16 and all(30 <= len(t.split()) <= 230 and t[0].isupper() and t.endswith(".") for t in r.texts)
    assert all(r.query is None and len(r.texts) == 1 for r in get("query", 1))
    words = [t.split() for r in get("ingest", 3) for t in r.texts]
    inner = [(w, after) for own in words for w, after in zip(own, own[1:], strict=False)]
    # a capital stands behind a stop, and only there
    assert all(after[0].isupper() == (w[-1] == ".") for w, after in inner)
    marks = [w[-1] for w, _ in inner if not w[-1].isalpha()]
    assert set(marks) == {",", ".", ";"} and 0.06 < len(marks) / len(inner) < 0.11
    assert 0.33 < marks.count(".") / len(marks) < 0.47 and 0.13 < marks.count(";") / len(marks) < 0.27


def test_admission(spark):
    log = [("m", 1, 1, 5), ("m", 2, 2, 1), ("m", 3, 1, -5), ("m", 4, 3, 2), ("m", 5, 2, -1), ("m", 6, 3, -2)]
    df = spark.createDataFrame(log, "model string, ts long, job long, change long")
    got = [(r.job, r.queued, r.admitted) for r in admission.replay(df, "model", 2).orderBy("ts").collect()]
    assert got == [(1, 5, True), (2, 5, False), (1, 0, True), (3, 2, True), (2, 2, False), (3, 0, True)]


def test_admission_stream(spark, tmp_path):
    log = [("m", 1, 1, 5), ("m", 2, 2, 1), ("m", 3, 1, -5), ("m", 4, 3, 2), ("m", 5, 2, -1), ("m", 6, 3, -2)]
    schema = "model string, ts long, job long, change long"
    for i in range(3):  # three files, three micro-batches
        spark.createDataFrame(log[2 * i : 2 * i + 2], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = admission.admission_stream(stream, "model", 2).writeStream.format("json").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = [(r.job, r.queued, r.admitted) for r in spark.read.json(str(tmp_path / "out")).orderBy("ts").collect()]
    assert got == [(1, 5, True), (2, 5, False), (1, 0, True), (3, 2, True), (2, 2, False), (3, 0, True)]


def test_rounds(spark, tmp_path):
    spark.createDataFrame([(i, 10) for i in range(5)], "idx int, len int").coalesce(1).write.json(str(tmp_path / "in"))
    seen = []
    q = admission.rounds(spark.readStream.schema("idx int, len int").json(str(tmp_path / "in")), lambda df, n: seen.append(df.count()), str(tmp_path / "c"), available_now=True)
    q.awaitTermination(120)
    assert seen == [5]


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.micros(F.lit(10**18)).alias("a"), scalars.bearer_digest(F.lit("BEARER  k ")).alias("b"), scalars.bearer_digest(F.lit("Basic k")).alias("c"), scalars.format_number(F.lit(float("inf"))).alias("d"), scalars.label(F.lit("infinity")).alias("e"), F.sha2(F.lit("k"), 256).alias("k")
    ).first()
    assert (row.a, row.b == row.k, row.c, row.d, row.e) == (600_000_000, True, None, "-", "Infinity")
