"""Evaluation on `events`: value is a latency in ms, event_type the target, user_id a client."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, vectors
from ..operators import evaluate, planner
from ..sources import prometheus, reports
from ..streaming import admission
from .common import table

OPEN, CLOSE = "2024-01-02 00:00:00", "2024-01-20 00:00:00"


def latency_percentiles(spark, sf_dir):
    return evaluate.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value")


def window_counts(spark, sf_dir):
    """Requests that end between opening and closing; every seventh user's fail."""
    e = table(spark, sf_dir, "events")
    at = lambda s: F.to_timestamp(F.lit(s))
    out = evaluate.window_counts(e, ["event_type"], "ts", at(OPEN), at(CLOSE), F.col("user_id") % 7 == 0, F.concat(F.lit("HTTP "), F.col("event_id").cast("string")))
    return out


WINDOW = f"""
WITH e AS (SELECT *, ts >= TIMESTAMP '{OPEN}' AND ts < TIMESTAMP '{CLOSE}' AS inside, user_id % 7 = 0 AS failed FROM events)
SELECT event_type, count(*) FILTER (WHERE inside AND NOT failed) AS requests, count(*) FILTER (WHERE inside AND failed) AS errors, count(*) FILTER (WHERE NOT inside) AS discarded,
  'HTTP ' || arg_min(event_id, ts) FILTER (WHERE inside AND failed) AS first_error FROM e GROUP BY event_type"""


def _runs(spark, sf_dir):
    """A run for each target and concurrency; errors only in one target's."""
    e = table(spark, sf_dir, "events").where("event_type <> 'signup'").withColumn("concurrency", (F.lit(1) + F.col("user_id") % 3).cast("int"))
    runs = evaluate.percentiles(e, ["event_type", "concurrency"], "value")
    counts = e.groupBy("event_type", "concurrency").agg(F.count("*").alias("requests"), F.count_if((F.col("event_type") == "error") & (F.col("concurrency") == 2)).alias("errors"))
    joined = runs.join(counts, ["event_type", "concurrency"]).withColumns({"workload": F.lit("query"), "seconds": F.lit(60.0), "inputs": F.lit(1), "tokens_per_input": F.when(F.col("event_type") == "view", float("nan")).otherwise(17.0)})
    return evaluate.rates(joined.withColumnRenamed("event_type", "target"))


_RUNS = """runs AS (SELECT 'query' AS workload, event_type AS target, CAST(1 + user_id % 3 AS INTEGER) AS concurrency, count(*) AS requests, count(*) / 60.0::DOUBLE AS rps,
  quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99, CASE WHEN event_type = 'error' AND 1 + user_id % 3 = 2 THEN count(*) ELSE 0 END AS errors
  FROM events WHERE event_type <> 'signup' GROUP BY event_type, 1 + user_id % 3)"""


def run_rates(spark, sf_dir):
    out = _runs(spark, sf_dir)
    n = lambda c: scalars.format_number(F.col(c), 3)
    return out.select("target", "concurrency", "requests", n("rps").alias("rps"), n("inputs_per_second").alias("inputs_per_second"), n("tokens_per_second").alias("tokens_per_second"))


RATES = f"""WITH {_RUNS} SELECT target, concurrency, requests, printf('%.3f', rps) AS rps, printf('%.3f', rps) AS inputs_per_second, CASE WHEN target = 'view' THEN '-' ELSE printf('%.3f', rps * 17) END AS tokens_per_second FROM runs"""


def run_comparison(spark, sf_dir):
    out = evaluate.compare_runs(_runs(spark, sf_dir), "click")
    return out.select("workload", "concurrency", "target", F.round("throughput_ratio", 6).alias("throughput_ratio"), F.round("p99_ratio", 6).alias("p99_ratio"), F.coalesce("marker", F.lit("")).alias("marker"))


COMPARISON = f"""
WITH {_RUNS}, j AS (SELECT o.workload, o.concurrency, o.target, m.rps / o.rps AS t, m.p99 / o.p99 AS p, o.errors = 0 AND o.requests > 0 AND m.errors = 0 AND m.requests > 0 AS ok
  FROM runs o JOIN runs m ON m.target = 'click' AND o.target <> 'click' AND m.concurrency = o.concurrency)
SELECT workload, concurrency, target, CASE WHEN ok THEN round(t, 6) END AS throughput_ratio, CASE WHEN ok THEN round(p, 6) END AS p99_ratio, CASE WHEN ok THEN '' ELSE 'invalid: errors' END AS marker FROM j"""


def competitors(spark, sf_dir):
    """Targets in the order in which they are first seen, numbered."""
    from pyspark.sql import Window

    first = table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("first"))
    return first.select("event_type", "first", F.row_number().over(Window.orderBy("first")).alias("place"))  # one row a target


def _vector_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a = e.select("vec_id", "label", F.col("embedding").alias("a"))
    # another target's answer: every 50th vector is another, the rest are a little longer
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    far = F.when((F.col("vec_id") % 50 == 0) & F.col("other").isNotNull(), F.col("other")).otherwise(vectors.scale(F.col("a"), F.lit(1.5)))
    return a.join(b, "vec_id", "left").select("vec_id", "label", "a", far.alias("b"))


def agreement_check(spark, sf_dir):
    """Labels as targets: least cosine, largest score difference, and whether the planted document comes first."""
    p = _vector_pairs(spark, sf_dir).select("label", vectors.cosine(F.col("a"), F.col("b")).alias("cosine"), F.abs(F.get("a", F.lit(0)) - F.get("b", F.lit(0))).cast("double").alias("diff"))
    rows = p.groupBy(F.col("label").alias("target")).agg(F.min("cosine").alias("min_cosine"), F.max("diff").alias("max_diff")).withColumn("planted_first", F.col("target") != 3)
    return evaluate.agreement(rows).select("target", F.array_join("failures", ",").alias("failures"))


AGREEMENT = """
WITH p AS (SELECT a.vec_id, a.label, a.embedding AS a, CASE WHEN a.vec_id % 50 = 0 AND b.vec_id IS NOT NULL THEN b.embedding ELSE list_transform(a.embedding, lambda x: x * 1.5::FLOAT) END AS b
  FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1),
c AS (SELECT label, abs(a[1] - b[1])::DOUBLE AS diff, list_sum(list_transform(list_zip(a, b), lambda q: (q[1] * q[2])::DOUBLE)) / sqrt(list_sum(list_transform(a, lambda x: (x * x)::DOUBLE)) * list_sum(list_transform(b, lambda x: (x * x)::DOUBLE))) AS cosine FROM p),
t AS (SELECT label AS target, min(cosine) AS c, max(diff) AS d FROM c GROUP BY label)
SELECT target, concat_ws(',', CASE WHEN c < 0.999 THEN 'cosine' END, CASE WHEN d > 0.01 THEN 'score' END, CASE WHEN target = 3 THEN 'planted' END) AS failures FROM t"""

def _metrics(spark, sf_dir):
    """Exposition text with a comment, a series of a longer name and one without labels."""
    e = table(spark, sf_dir, "events")
    labels = F.format_string('{event_type="%s",user="%s"}', "event_type", (F.col("user_id") % 4).cast("string"))
    lines = e.select(F.concat(F.lit("requests_total"), labels, F.lit(" "), (F.col("event_id") % 10).cast("string")).alias("value"))
    return prometheus.parse(lines.unionAll(spark.sql("SELECT * FROM VALUES ('# HELP requests_total all requests'), ('requests_total_other 5'), ('requests_total 7') AS t(value)")))


def prometheus_series(spark, sf_dir):
    return _metrics(spark, sf_dir)


def prometheus_sum(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    picks = [("all", ()), ("click", ('event_type="click"',)), ("click of 1", ('event_type="click"', 'user="1"')), ("none", ('user="9"',))]
    out = None
    for name, labels in picks:
        row = prometheus.total(m, "requests_total", *labels).select(F.lit(name).alias("pick"), "total")
        out = row if out is None else out.unionAll(row)
    return out


_SERIES = "SELECT 'requests_total{event_type=\"' || event_type || '\",user=\"' || (user_id % 4) || '\"}' AS series, CAST(sum(event_id % 10) AS DOUBLE) AS value FROM events GROUP BY event_type, user_id % 4"
SUMS = """
SELECT 'all' AS pick, CAST(sum(event_id % 10) + 7 AS DOUBLE) AS total FROM events
UNION ALL SELECT 'click', CAST(coalesce(sum(event_id % 10), 0) AS DOUBLE) FROM events WHERE event_type = 'click'
UNION ALL SELECT 'click of 1', CAST(coalesce(sum(event_id % 10), 0) AS DOUBLE) FROM events WHERE event_type = 'click' AND user_id % 4 = 1
UNION ALL SELECT 'none', 0.0"""


def counter_deltas(spark, sf_dir):
    """Counters of each target before and after a point in time, and the padding share made of two of them."""
    e = table(spark, sf_dir, "events")
    edges = e.groupBy("event_type").agg(F.sum(F.when(F.col("ts") < F.to_timestamp(F.lit(OPEN)), F.col("user_id")).otherwise(0)).cast("double").alias("open"), F.sum("user_id").cast("double").alias("close"))
    long = edges.select("event_type", F.explode(F.array(F.struct(F.lit("open").alias("edge"), F.col("open").alias("v")), F.struct(F.lit("close").alias("edge"), F.col("close").alias("v")))).alias("x")).select("event_type", "x.*")
    return evaluate.counter_deltas(long, "event_type", "v", "edge")


def client_timings(spark, sf_dir):
    """Latencies in microseconds, ten minutes at most, from nanoseconds."""
    return table(spark, sf_dir, "events").select("event_id", scalars.micros((F.round(F.col("value") * 100) * 100_000_000).cast("long")).alias("us"))


def tokens_per_input(spark, sf_dir):
    """Over a sample of payloads, by target; the first target that knows any wins."""
    t = table(spark, sf_dir, "events").groupBy("event_type").agg((F.sum("user_id") / F.count("*")).alias("tokens_per_input"), F.min("event_id").alias("place"))
    return t.where("tokens_per_input > 0").orderBy("place").limit(1).select("event_type", F.round("tokens_per_input", 6).alias("tokens_per_input"))


ADMIT = 40


def _log(spark, sf_dir):
    """Arrivals of 1 to 20 inputs and their completions some seconds later."""
    e = table(spark, sf_dir, "events").select("event_type", (F.unix_timestamp("ts")).alias("ts"), F.col("event_id").alias("job"), (1 + F.col("user_id") % 20).alias("n"), "value")
    arrivals = e.select("event_type", "ts", "job", F.col("n").alias("change"))
    completions = e.select("event_type", (F.col("ts") + 60 * (1 + F.floor(F.col("value"))).cast("long")).alias("ts"), "job", (-F.col("n")).alias("change"))
    return arrivals.unionAll(completions)


def admission_replay(spark, sf_dir):
    return admission.replay(_log(spark, sf_dir), "event_type", ADMIT)


# a recursion over each target's log in order; refused jobs travel as a list
ADMISSION = f"""
WITH RECURSIVE e AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS job, 1 + user_id % 20 AS n, value FROM events),
l AS (SELECT event_type, ts, job, n AS change FROM e UNION ALL SELECT event_type, ts + 60 * (1 + CAST(floor(value) AS BIGINT)), job, -n FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, change > 0, job) AS rn FROM l),
r AS (
  SELECT event_type, ts, job, change, rn, change AS queued, true AS admitted, CAST([] AS BIGINT[]) AS refused FROM o WHERE rn = 1
  UNION ALL
  SELECT o.event_type, o.ts, o.job, o.change, o.rn,
    CASE WHEN o.change > 0 AND r.queued > 0 AND r.queued + o.change > {ADMIT} OR o.change < 0 AND list_contains(r.refused, o.job) THEN r.queued ELSE r.queued + o.change END,
    NOT (o.change > 0 AND r.queued > 0 AND r.queued + o.change > {ADMIT} OR o.change < 0 AND list_contains(r.refused, o.job)),
    CASE WHEN o.change > 0 AND r.queued > 0 AND r.queued + o.change > {ADMIT} THEN list_append(r.refused, o.job) WHEN o.change < 0 THEN list_filter(r.refused, lambda x: x <> o.job) ELSE r.refused END
  FROM r JOIN o ON o.event_type = r.event_type AND o.rn = r.rn + 1
)
SELECT event_type, ts, job, CAST(change AS BIGINT) AS change, CAST(queued AS BIGINT) AS queued, admitted FROM r"""


def cancel_antijoin(spark, sf_dir):
    """Pending requests without those of users that cancelled."""
    e = table(spark, sf_dir, "events")
    return admission.live(e.select("event_id", "user_id"), e.where("event_type = 'error' AND value > 150").select("user_id"), "user_id")


def report_rows(spark, sf_dir):
    """Rows of the Markdown report, read back."""
    runs = _runs(spark, sf_dir).select("workload", "target", "concurrency", "rps", "p50", "p90", "p99")
    return reports.read_markdown(reports.markdown_rows(runs))


REPORT = f"WITH {_RUNS} SELECT workload, target, concurrency, round(rps, 1) AS rps, round(p50, 1) AS p50, round(p90, 1) AS p90, round(p99, 1) AS p99 FROM runs"


def limits(spark, sf_dir):
    """Budgets and padded bounds of planner limits, from a literal table."""
    rows = spark.sql("SELECT * FROM VALUES (0, 16384, 8192, false, false), (1, 16384, 8192, true, false), (2, 16384, 8192, true, true), (3, 100, 512, false, false) AS t(id, budget, longest, packed, half)")
    budget = F.greatest("budget", "longest")
    return rows.select("id", budget.alias("budget"), (budget * F.when(F.col("packed") & F.col("half"), 4).otherwise(1)).alias("padded_tokens"))


def device_parse(spark, sf_dir):
    return spark.sql("SELECT * FROM VALUES ('cpu'), (' CUDA '), ('cuda:3'), ('cuda:x'), ('tpu'), ('cuda:') AS t(device)").select("device", F.coalesce(scalars.device_ordinal(F.col("device")), F.lit(-2)).alias("ordinal"))


def duration_parse(spark, sf_dir):
    return spark.sql("SELECT * FROM VALUES ('500ms'), ('15s'), ('2m'), ('5h'), ('s'), ('') AS t(text)").select("text", F.coalesce(scalars.duration_ms(F.col("text")), F.lit(-1)).alias("ms"))


def token_limit(spark, sf_dir):
    rows = spark.sql(
        "SELECT * FROM VALUES ('a', CAST(NULL AS INT), 8192D, 8194, 'xlm-roberta', 1), ('b', 256, 512D, NULL, 'bert', 0), ('c', NULL, 1e30D, 8194, 'xlm-roberta', 1), ('d', NULL, NULL, 512, 'bert', 0) AS t(model, s, t, p, kind, pad)"
    )
    return rows.select("model", scalars.token_limit(*(F.col(c) for c in ("s", "t", "p", "kind", "pad"))).alias("max_input_tokens"))


def text_parse(spark, sf_dir):
    """Lists, names of workloads and addresses."""
    rows = spark.sql("SELECT * FROM VALUES (1, 'ingest, rerank ,x', 'http://a/'), (2, ' QUERY', 'http://a'), (3, '', 'b//') AS t(id, list, url)")
    parts = scalars.split_list(F.col("list"))
    known = F.filter(F.transform(parts, lambda x: scalars.enum_of(x, ("QUERY", "INGEST", "RERANK"))), lambda x: x.isNotNull())
    return rows.select("id", F.array_join(parts, "|").alias("parts"), F.array_join(known, "|").alias("workloads"), scalars.strip_slash(F.col("url")).alias("url"))


def graph_votes(spark, sf_dir):
    """Operator counts of graphs to a class of attention and a precision, from a literal table of headers."""
    ops = spark.sql("SELECT * FROM VALUES ('a', 'op', 'MatMul', 2), ('a', 'op', 'com.microsoft.Attention', 1), ('a', 'op', 'Softmax', 1), ('b', 'op', 'com.microsoft.PackedAttention', 3), ('c', 'op', 'Softmax', 1), ('a', 'weight', '10', 2), ('b', 'weight', '1', 2), ('b', 'weight', '7', 9), ('c', 'weight', '16', 1) AS t(graph, kind, name, n)")
    n = lambda *names: F.sum(F.when(F.col("name").isin(*names), F.col("n")).otherwise(0))
    packed, fused, plain_ = n("com.microsoft.PackedAttention", "com.microsoft.PackedMultiHeadAttention"), n("com.microsoft.Attention", "com.microsoft.MultiHeadAttention"), n("Softmax")
    return ops.groupBy("graph").agg(F.when(packed > 0, "PACKED").when(fused > 0, "FUSED").when(plain_ > 0, "UNFUSED").otherwise("UNKNOWN").alias("attention"), (n("10", "16") > n("1")).alias("half"))


def model_metrics(spark, sf_dir):
    """Passes, rows, and real and padding tokens of each model, here of each source's batch plan."""
    from . import tokens

    m = planner.batch_metrics(tokens._plan(tokens.PADDED)(spark, sf_dir), "round", "len")
    return m.groupBy("round").agg(F.count("*").alias("passes"), F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"), F.sum("padding").alias("padding"))


def _metrics_sql() -> str:
    from . import tokens

    return f"SELECT round, count(*) AS passes, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(padding) AS BIGINT) AS padding FROM ({tokens.PADDING}) GROUP BY round"


QUERIES = {
    "latency_percentiles": (latency_percentiles, "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99, max(value) AS max FROM events GROUP BY event_type"),
    "window_counts": (window_counts, WINDOW), "run_rates": (run_rates, RATES), "run_comparison": (run_comparison, COMPARISON),
    "competitors": (competitors, 'SELECT event_type, min(event_id) AS first, CAST(row_number() OVER (ORDER BY min(event_id)) AS INTEGER) AS place FROM events GROUP BY event_type'),
    "agreement_check": (agreement_check, AGREEMENT),
    "prometheus_series": (prometheus_series, f"{_SERIES} UNION ALL SELECT 'requests_total_other', 5.0 UNION ALL SELECT 'requests_total', 7.0"), "prometheus_sum": (prometheus_sum, SUMS),
    "counter_deltas": (counter_deltas, f"SELECT event_type, CAST(sum(user_id) - sum(CASE WHEN ts < TIMESTAMP '{OPEN}' THEN user_id ELSE 0 END) AS DOUBLE) AS delta FROM events GROUP BY event_type"),
    "client_timings": (client_timings, "SELECT event_id, least(CAST(round(value * 100) AS BIGINT) * 100000, 600000000) AS us FROM events"),
    "tokens_per_input": (tokens_per_input, "SELECT event_type, round(sum(user_id) / count(*), 6) AS tokens_per_input FROM events GROUP BY event_type HAVING sum(user_id) > 0 ORDER BY min(event_id) LIMIT 1"),
    "admission_replay": (admission_replay, ADMISSION),
    "cancel_antijoin": (cancel_antijoin, "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150)"),
    "report_rows": (report_rows, REPORT),
    "limits": (limits, "SELECT * FROM (VALUES (0, 16384, 16384), (1, 16384, 16384), (2, 16384, 65536), (3, 512, 512)) AS t(id, budget, padded_tokens)"),
    "device_parse": (device_parse, "SELECT * FROM (VALUES ('cpu', -1), (' CUDA ', 0), ('cuda:3', 3), ('cuda:x', -2), ('tpu', -2), ('cuda:', -2)) AS t(device, ordinal)"),
    "duration_parse": (duration_parse, "SELECT text, CAST(ms AS BIGINT) AS ms FROM (VALUES ('500ms', 500), ('15s', 15000), ('2m', 120000), ('5h', -1), ('s', -1), ('', -1)) AS t(text, ms)"),
    "token_limit": (token_limit, "SELECT * FROM (VALUES ('a', 8192), ('b', 256), ('c', 8192), ('d', 512)) AS t(model, max_input_tokens)"),
    "text_parse": (text_parse, "SELECT * FROM (VALUES (1, 'ingest|rerank|x', 'INGEST|RERANK', 'http://a'), (2, 'QUERY', 'QUERY', 'http://a'), (3, '', '', 'b/')) AS t(id, parts, workloads, url)"),
    "graph_votes": (graph_votes, "SELECT * FROM (VALUES ('a', 'FUSED', true), ('b', 'PACKED', false), ('c', 'UNFUSED', true)) AS t(graph, attention, half)"),
    "model_metrics": (model_metrics, _metrics_sql()),
}
