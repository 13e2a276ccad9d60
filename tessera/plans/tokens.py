"""Tokens, truncation, windows and batch plans on `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import planner, pooling, tokens
from .common import table

LIMIT = 512
_N = "len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+'))"


def _counted(spark, sf_dir, *more):
    return table(spark, sf_dir, "documents").select("doc_id", *more, tokens.with_specials(F.size(tokens.words(F.col("text")))).alias("n"))


def token_counts(spark, sf_dir):
    return _counted(spark, sf_dir).select("doc_id", F.col("n").cast("long").alias("n_tokens"))


def prompt_tokens(spark, sf_dir):
    """Tokens of a request, here of a source, specials included."""
    return _counted(spark, sf_dir, "source").groupBy("source").agg(F.sum("n").cast("long").alias("prompt_tokens"), F.count("*").alias("inputs"))


def truncate_flags(spark, sf_dir):
    kept, cut = tokens.truncated(F.col("n"), LIMIT)
    return _counted(spark, sf_dir).select("doc_id", kept.cast("long").alias("kept"), cut.alias("truncated"))


def first_truncated(spark, sf_dir):
    """Of each source the first document that was cut, by id; -1 if none was."""
    _, cut = tokens.truncated(F.col("n"), LIMIT)
    return tokens.first_truncated(_counted(spark, sf_dir, "source").withColumn("cut", cut), "source", "doc_id", "cut")


def _pieces(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tokens.word_ids(F.col("text")).alias("ids"))


def _windows(spark, sf_dir):
    return _pieces(spark, sf_dir).select("doc_id", F.posexplode(tokens.windows(F.col("ids"), LIMIT)).alias("win", "w")).select("doc_id", "win", "w.*")


def chunk_windows(spark, sf_dir):
    return _windows(spark, sf_dir)


# word starts by position; a recursion a document, one window a step
_RECURSION = f"""
p AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \\t\\n\\r\\f]+') AS w FROM documents),
l AS (SELECT doc_id, list_transform(w, lambda x: CAST(ceil(length(x) / 4) AS BIGINT)) AS k FROM p),
c AS (SELECT doc_id, coalesce(list_sum(k), 0)::BIGINT + 2 AS n, k FROM l),
e AS (SELECT doc_id, unnest(k) AS size, generate_subscripts(k, 1) AS i FROM c WHERE n > {LIMIT}),
s AS (SELECT doc_id, CAST(1 + sum(size) OVER (PARTITION BY doc_id ORDER BY i) - size AS BIGINT) AS start FROM e),
r AS (
  SELECT doc_id, n, 0 AS win, 1::BIGINT AS a,
    CASE WHEN 1 + {LIMIT - 2} >= n - 1 THEN n - 1 ELSE coalesce((SELECT max(start) FROM s WHERE s.doc_id = c.doc_id AND start > 1 AND start <= 1 + {LIMIT - 2}), 1 + {LIMIT - 2}) END AS b
  FROM c WHERE n > {LIMIT}
  UNION ALL
  SELECT doc_id, n, win + 1, b,
    CASE WHEN b + {LIMIT - 2} >= n - 1 THEN n - 1 ELSE coalesce((SELECT max(start) FROM s WHERE s.doc_id = r.doc_id AND start > b AND start <= b + {LIMIT - 2}), b + {LIMIT - 2}) END
  FROM r WHERE b < n - 1
),
v AS (
  SELECT doc_id, CAST(win AS INTEGER) AS win, CAST(a AS INTEGER) AS "from", CAST(b AS INTEGER) AS "to", CAST(b - a + 2 AS INTEGER) AS length, true AS wrap, CAST(b - a AS INTEGER) AS weight FROM r
  UNION ALL
  SELECT doc_id, 0, 0, CAST(n AS INTEGER), CAST(n AS INTEGER), false, CAST(n AS INTEGER) FROM c WHERE n <= {LIMIT}
)"""
CHUNKS = f"WITH RECURSIVE {_RECURSION} SELECT * FROM v"


def chunk_weighted_mean(spark, sf_dir):
    """Window vectors (weight, 1, 1/2) of a document to one, by weight, not normalised again."""
    rows = _windows(spark, sf_dir).select("doc_id", "weight", F.array(F.col("weight").cast("float"), F.lit(1.0).cast("float"), F.lit(0.5).cast("float")).alias("vector"))
    out = pooling.combine_windows(rows, "doc_id", "vector", normalize=False)
    return out.select("doc_id", *[F.round(F.get("vector", F.lit(i)).cast("double"), 2).alias(f"x{i}") for i in range(3)])


CHUNK_MEAN = f"""WITH RECURSIVE {_RECURSION}
SELECT doc_id, round(CAST(CAST(sum(weight * weight::DOUBLE) / sum(weight) AS FLOAT) AS DOUBLE), 2) AS x0, 1.0::DOUBLE AS x1, 0.5::DOUBLE AS x2 FROM v GROUP BY doc_id"""


def row_assembly(spark, sf_dir):
    """Every window of every document as a model's row of the full length, its own token ids between the special ones, padding
    behind, and its mask: both as digests, with the tokens that count."""
    pieces = F.flatten(F.transform(tokens.words(F.col("text")), lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w), F.lit(tokens.PIECE)), lambda i: F.substring(w, i, F.lit(tokens.PIECE)))))
    ids = F.concat(F.array(F.lit(0)), F.transform(pieces, lambda p: FIRST_ID + 64 * F.ascii(p) + F.char_length(p)), F.array(F.lit(0)))
    # each array in a step of its own, so that it is made once
    docs = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"), tokens.word_ids(F.col("text")).alias("words"))
    rows = docs.select("doc_id", "ids", F.posexplode(tokens.windows(F.col("words"), LIMIT)).alias("win", "w"))
    own = F.when(F.col("w.wrap"), F.slice("ids", F.col("w.from") + 1, F.col("w.weight"))).otherwise(F.slice("ids", F.lit(2), F.col("w.length") - 2))
    rows = rows.select("doc_id", "win", own.alias("ids"), F.col("w.length").alias("n"))
    row = tokens.row(F.col("ids"), F.lit(0), F.size("ids"), F.array(F.lit(CLS)), F.array(F.lit(SEP)), 0, LIMIT)
    text = lambda c: F.md5(F.array_join(c.cast("array<string>"), ",").cast("binary"))
    return rows.select("doc_id", "win", F.col("n").cast("long").alias("n"), text(row).alias("row_md5"), text(tokens.mask(F.col("n"), LIMIT)).alias("mask_md5"))


#: Ids of the stand-in's special tokens, and where those of its pieces begin.
CLS, SEP, FIRST_ID = 101, 102, 1000
ROWS = f"""WITH RECURSIVE {_RECURSION},
i AS (SELECT doc_id, flatten(list_transform(w, lambda x: list_transform(range(1, length(x) + 1, 4), lambda k: {FIRST_ID} + 64 * unicode(substring(x, k, 4)) + length(substring(x, k, 4))))) AS ids FROM p),
a AS (SELECT doc_id, win, v.length::BIGINT AS n, list_concat([{CLS}], CASE WHEN wrap THEN list_slice(ids, "from", "to" - 1) ELSE ids END, [{SEP}]) AS own FROM v JOIN i USING (doc_id))
SELECT doc_id, win, n, md5(array_to_string(list_concat(own, list_transform(range({LIMIT} - n), lambda x: 0)), ',')) AS row_md5,
  md5(array_to_string(list_transform(range({LIMIT}), lambda x: CASE WHEN x < n THEN 1 ELSE 0 END), ',')) AS mask_md5 FROM a"""

#: A round is a bounded range of ids inside a source.
ROUND = 4096


def _rounds(spark, sf_dir):
    kept, _ = tokens.truncated(F.col("n"), LIMIT)
    group = F.concat_ws(":", "source", F.floor(F.col("doc_id") / ROUND).cast("string"))
    return _counted(spark, sf_dir, "source").select(group.alias("round"), "doc_id", kept.cast("long").alias("len"))


PADDED = planner.Limits(max_rows=64, token_budget=4096, max_input=LIMIT)
PACKED = planner.Limits(max_rows=64, token_budget=4096, max_input=LIMIT, packed=True, half=True)
_LENS = f"q AS (SELECT source || ':' || (doc_id // {ROUND}) AS round, doc_id, least({_N} + 2, {LIMIT})::BIGINT AS len FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY len, doc_id) AS rn FROM q)"


def _plan_sql(limits: planner.Limits) -> str:
    cost = "r.tokens + o.len" if limits.packed else "(r.size + 1) * o.len"
    new = f"r.size + 1 > {limits.max_rows} OR (r.size + 1) * o.len > {limits.padded_tokens} OR {cost} > {limits.budget}"
    return f"""{_LENS}, r AS (
  SELECT round, doc_id, len, rn, 0 AS batch, 1 AS size, len AS tokens FROM o WHERE rn = 1
  UNION ALL
  SELECT o.round, o.doc_id, o.len, o.rn, CASE WHEN {new} THEN r.batch + 1 ELSE r.batch END, CASE WHEN {new} THEN 1 ELSE r.size + 1 END, CASE WHEN {new} THEN o.len ELSE r.tokens + o.len END
  FROM r JOIN o ON o.round = r.round AND o.rn = r.rn + 1
)"""


def _plan(limits):
    return lambda spark, sf_dir: planner.plan_batches(_rounds(spark, sf_dir), "round", "doc_id", "len", limits)


_PLAN_ROWS = 'SELECT round, doc_id, len, CAST(batch AS INTEGER) AS batch, CAST(size - 1 AS INTEGER) AS "position" FROM r'


def padding_ratio(spark, sf_dir):
    m = planner.batch_metrics(_plan(PADDED)(spark, sf_dir), "round", "len")
    return m.select("round", "batch", "rows", "tokens", "padding", F.round(F.col("padding") / (F.col("padding") + F.col("tokens")), 6).alias("ratio"))


PADDING = f"""WITH RECURSIVE {_plan_sql(PADDED)}
SELECT round, CAST(batch AS INTEGER) AS batch, count(*) AS rows, CAST(sum(len) AS BIGINT) AS tokens, CAST(max(len) * count(*) - sum(len) AS BIGINT) AS padding,
  round((max(len) * count(*) - sum(len)) / CAST(max(len) * count(*) AS DOUBLE), 6) AS ratio FROM r GROUP BY round, batch"""

BUDGET = 16384


def fair_share_round(spark, sf_dir):
    """One round over all sources as jobs; sources whose name ends in 3 are cancelled but not yet taken off the list."""
    rows = _rounds(spark, sf_dir).select(F.split_part("round", F.lit(":"), F.lit(1)).alias("job"), "doc_id", "len")
    jobs = rows.select("job").distinct().withColumn("cancelled", F.col("job").endswith("3"))
    return planner.fair_round(rows, jobs, "job", "doc_id", "len", BUDGET, "cancelled").select("job", "doc_id", "len", "taken")


FAIR = f"""WITH {_LENS}, j AS (SELECT *, split_part(round, ':', 1) AS job FROM q),
s AS (SELECT job, doc_id, len, CAST(sum(len) OVER (PARTITION BY job ORDER BY len, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS taken, row_number() OVER (PARTITION BY job ORDER BY len, doc_id) AS n FROM j)
SELECT job, doc_id, len, taken FROM s WHERE NOT ends_with(job, '3') AND (n = 1 OR taken <= greatest(1, {4 * BUDGET} // (SELECT count(DISTINCT job) FROM j)))"""


def job_order(spark, sf_dir):
    """Shortest pending first, ties by id."""
    from pyspark.sql import Window

    w = Window.partitionBy("round").orderBy("len", "doc_id")
    return _rounds(spark, sf_dir).select("round", "doc_id", F.row_number().over(w).alias("turn"))


def length_sort(spark, sf_dir):
    """The same order over everything, by range partitions; the row number within the whole is not needed to read it in order."""
    return _rounds(spark, sf_dir).select("doc_id", "len").orderBy("len", "doc_id")


QUERIES = {
    "token_counts": (token_counts, f"SELECT doc_id, CAST({_N} + 2 AS BIGINT) AS n_tokens FROM documents"),
    "prompt_tokens": (prompt_tokens, f"SELECT source, CAST(sum({_N} + 2) AS BIGINT) AS prompt_tokens, count(*) AS inputs FROM documents GROUP BY source"),
    "truncate_flags": (truncate_flags, f"SELECT doc_id, CAST(least({_N} + 2, {LIMIT}) AS BIGINT) AS kept, {_N} + 2 > {LIMIT} AS truncated FROM documents"),
    "first_truncated": (first_truncated, f"SELECT source, coalesce(min(doc_id) FILTER (WHERE {_N} + 2 > {LIMIT}), -1) AS first_truncated FROM documents GROUP BY source"),
    "chunk_windows": (chunk_windows, CHUNKS),
    "chunk_weighted_mean": (chunk_weighted_mean, CHUNK_MEAN),
    "row_assembly": (row_assembly, ROWS),
    "batch_plan_padded": (_plan(PADDED), f"WITH RECURSIVE {_plan_sql(PADDED)} {_PLAN_ROWS}"),
    "batch_plan_packed": (_plan(PACKED), f"WITH RECURSIVE {_plan_sql(PACKED)} {_PLAN_ROWS}"),
    "padding_ratio": (padding_ratio, PADDING),
    "fair_share_round": (fair_share_round, FAIR),
    "job_order": (job_order, f"WITH {_LENS} SELECT round, doc_id, CAST(rn AS INTEGER) AS turn FROM o"),
    "length_sort": (length_sort, f"WITH {_LENS} SELECT doc_id, len FROM o"),
}
