"""Quality rules by suffix-array repetition.

Every text's words get a suffix array (prefix doubling, many texts in one numpy pass). Neighbouring suffixes' longest
common prefixes give the maximal repeated word strings; the union of their spans and the longest of them decide.

Defined results: a null or empty text has no words and is rejected by the base rule; rows are judged one by one, so
repeated rows get equal verdicts; an input column named as the output column is replaced; empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_only, put, struct, table, texts

#: Words in one numpy pass: bounds a worker's memory whatever the batch holds; one longer text is a pass of its own.
PASS_WORDS = 300_000


@dataclass(frozen=True)
class RepetitionRules:
    min_words: int = 10
    window: int = 5
    base_percent: int = 20
    max_covered: float = 0.25
    max_longest: int = 100


def suffix_repeats(ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every position the longest prefix of its suffix that starts elsewhere too (0 if under `window`), and the suffix order.

    `ids` are non-negative ints; a string that occurs once (a separator, say) ends every repeat.
    Ranks are refined as in prefix doubling: groups that one suffix is left in are done.
    """
    n = len(ids)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best, np.arange(n)
    group = np.unique(ids, return_inverse=True)[1]
    size = np.bincount(group)
    rank = (np.cumsum(size) - size)[group].astype(np.int32)  # a group's rank is its first place in the suffix array
    active = np.flatnonzero(size[group] > 1)
    levels = [rank.copy()]
    step = 1
    while len(active):
        ahead = active + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0).astype(np.int64)
        key = rank[active].astype(np.int64) * (n + 2) + second
        order = np.argsort(key)
        active, key = active[order], key[order]
        new = np.empty(len(key), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        first = np.flatnonzero(new)
        old = rank[active]
        group = np.empty(len(key), bool)
        group[0] = True
        np.not_equal(old[1:], old[:-1], out=group[1:])
        place = np.arange(len(key))
        start = np.maximum.accumulate(np.where(group, place, 0))
        sub = np.maximum.accumulate(np.where(new, place, 0))
        rank[active] = old + (sub - start).astype(np.int32)
        sizes = np.diff(np.append(first, len(key)))
        active = active[np.repeat(sizes > 1, sizes)]
        step *= 2
        levels.append(rank.copy())
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1], order[1:]
    alike = levels[0][a] == levels[0][b]
    at = np.flatnonzero(alike)
    p, q, common = a[at].copy(), b[at].copy(), np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (p < n) & (q < n)
        same[same] = levels[k][p[same]] == levels[k][q[same]]
        common[same] += 1 << k
        p[same] += 1 << k
        q[same] += 1 << k
    common[common < window] = 0
    np.maximum.at(best, a[at], common)
    np.maximum.at(best, b[at], common)
    return best, order


def _covered(best: np.ndarray) -> np.ndarray:
    """Which positions lie in [i, i + best[i]) of any i."""
    place = np.arange(len(best))
    return np.maximum.accumulate(np.where(best > 0, place + best, 0)) > place if len(best) else best > 0


def repetition_stats(batch: list[str], rules: RepetitionRules) -> dict[str, np.ndarray]:
    """One entry per text of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, word_bytes, repeat_bytes, longest_repeat."""
    out = {k: np.zeros(len(batch), np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "word_bytes", "repeat_bytes", "longest_repeat")}
    pending: list[tuple[int, int]] = []
    ids: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    used = 0

    def flush() -> None:
        nonlocal used
        if not pending:
            return
        best, _ = suffix_repeats(np.concatenate(ids), rules.window)
        inside = _covered(best)
        chars = np.where(inside, np.concatenate(lengths), 0)
        starts = np.cumsum([0] + [n + 1 for _, n in pending[:-1]])
        rows = np.array([i for i, _ in pending])
        out["n_repeat_words"][rows] = np.add.reduceat(inside.astype(np.int64), starts)
        out["repeat_bytes"][rows] = np.add.reduceat(chars, starts)
        out["longest_repeat"][rows] = np.maximum.reduceat(best, starts)
        pending.clear(), ids.clear(), lengths.clear()
        used = 0

    for i, text in enumerate(batch):
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        n = out["n_words"][i] = len(words)
        out["word_bytes"][i] = size = len(b"".join(words))
        out["word_chars"][i] = len(text) - (len(raw) - size)
        out["n_symbols"][i] = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        if n <= rules.window:
            continue
        known: defaultdict[bytes, int] = defaultdict(count(used).__next__)
        ids.append(np.fromiter(map(known.__getitem__, words), np.int64, n))
        ids.append(np.array([used + n]))  # one separator after each text
        lengths.append(np.fromiter(map(len, words), np.int64, n))
        lengths.append(np.zeros(1, np.int64))
        pending.append((i, int(n)))
        used += n + 1
        if used >= PASS_WORDS:
            flush()
    flush()
    return out


QUALITY = struct(n_words=T.LongType(), word_chars=T.LongType(), n_symbols=T.LongType(), n_dup_lines=T.LongType(), n_repeat_words=T.LongType(), longest_repeat=T.LongType(), covered=T.DoubleType(), base_failed=T.BooleanType(), kept=T.BooleanType())


def quality_rules(docs: DataFrame, text: str = "text", out: str = "quality", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """`docs` with a struct column `out`: the counts, `covered` (bytes of words inside repeats over bytes of words) and the verdict `kept`."""

    def judge(column: pa.Array) -> pa.Array:
        keep_only()
        s = repetition_stats(texts(column), rules)
        covered = s["repeat_bytes"] / np.maximum(1, s["word_bytes"])
        failed = (s["n_words"] < rules.min_words) | (100 * s["n_repeat_words"] > rules.base_percent * s["n_words"])
        kept = ~failed & (covered <= rules.max_covered) & (s["longest_repeat"] <= rules.max_longest)
        cols = [s[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")] + [covered, failed, kept]
        return pa.StructArray.from_arrays([pa.array(c) for c in cols], names=QUALITY.names)

    return put(docs, out, F.arrow_udf(judge, QUALITY).asNondeterministic()(F.col(text)))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality")
    return judged.select("doc_id", *[f"quality.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered")])


QUERIES = {"op1_quality": op1_quality}
# a repeat is longer than 100 words where a window of 101 words occurs twice
ORACLE_SQL = {
    "op1_quality": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS l FROM d),
w AS (SELECT r, unnest(l) AS w, generate_subscripts(l, 1) AS i, len(l) AS n, l FROM l),
g AS (SELECT r, i, w, array_to_string(l[i:i + 4], ' ') AS g FROM w WHERE i <= n - 4),
twice AS (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1),
inside AS (SELECT DISTINCT r, i + k AS i FROM g JOIN twice USING (r, g), range(5) t(k)),
long AS (SELECT DISTINCT r FROM (SELECT r, md5(array_to_string(l[i:i + 100], ' ')) AS h FROM w WHERE i <= n - 100) GROUP BY r, h HAVING count(*) > 1),
words AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, sum(strlen(w)) AS bytes, count(inside.i) AS n_repeat_words, sum(CASE WHEN inside.i IS NOT NULL THEN strlen(w) ELSE 0 END) AS repeated FROM w LEFT JOIN inside USING (r, i) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
a AS (SELECT doc_id, r, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(repeated, 0) AS DOUBLE) / greatest(1, coalesce(bytes, 0)) AS covered
  FROM d LEFT JOIN words USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND covered <= 0.25 AND r NOT IN (SELECT r FROM long) AS kept, covered FROM b"""
}
