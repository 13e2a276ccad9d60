"""SimHash near-duplicates by pivot distance tables.

Fingerprints are grouped first, so copies count once. Distances to reference fingerprints (pivots) alone leave a share of
all pairs that does not fall with their number, so pairs are looked for inside bands: of six blocks of a fingerprint two at
least are free of up to four differing bits (of ten blocks, three of up to seven), and their bits make a key. Inside a key's group the
pivot table, computed once for all fingerprints at hand, discards every pair with a coordinate difference over the limit
(the triangle inequality makes this exact); what survives is verified. Fingerprints of several words, which tell similar from alike far more sharply, allow more
differing bits; their keys are drawn from all digits. A large group is searched breadth first against what is
not reached yet, so that a dense group of near copies costs no pairs of its own. Groups report trees, not pairs; their
components are joined by star contraction.

Defined results: null and empty texts have fingerprint zero, which links like any other; fewer words than a shingle make one
shingle; repeated rows link to each other; a null id is ignored in the minimum, and a component of only nulls has a null id;
an input column named as an output is replaced; empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, keep_only, table, texts, whole_groups, written
from .graphs import components

SHINGLE = 4
LIMIT = 4
SEED = 42
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), seed=SEED) for i in range(16)], np.uint64)
#: Groups up to this size compare their pairs at once; larger ones are searched breadth first.
SMALL = 64
FRONT = 128
#: Keys of a fingerprint of several words.
KEYS = 120
FIRST_KEYS = 12


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Other 64 bits made of each hash."""
    x = hashes * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED, size: int = 1) -> list[int]:
    """`size` words of 64 bits; the first is of the shingles' hashes, the others of what is mixed from them."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * size
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends, at = [], -1
        for n in map(len, words):
            at += n + 1
            ends.append(at)
        starts = [0] + [e + 1 for e in ends[:-shingle]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=True)]
    bits = np.zeros((size, 64), np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.array(hashes[at : at + 8192], np.uint64)
        for k in range(size):
            bits[k] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
            if k + 1 < size:
                part = _mixed(part)
    return np.packbits(2 * bits > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel().tolist()


def simhash(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""
    return simhashes(text, shingle, 1)[0]


def simhashes(text: Column, shingle: int, size: int) -> Column:
    """The words of a fingerprint as an array of signed longs."""

    def run(column: pa.Array) -> pa.Array:
        keep_only()
        prints = np.array([fingerprint(t, shingle, size=size) for t in texts(column)], np.uint64).reshape(-1).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * size), pa.array(prints))

    return F.arrow_udf(run, T.ArrayType(T.LongType())).asNondeterministic()(text)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits, over all words of the last axis."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to every pivot; a pivot is as many words as a fingerprint, one after another of the list."""
    pivots = np.stack([np.roll(PIVOTS, -k) for k in range(prints.shape[1])], 1)
    return distance(prints[:, None], pivots[None]).astype(np.int16)


def _search(prints: np.ndarray, table: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join each component of one large group; breadth first, one component at a time."""
    out = []
    rest = np.lexsort(table.T)

    def hits(front: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `among` of what links to the front, and whom of the front it links to first."""
        low, high = table[front].min(0) - limit, table[front].max(0) + limit
        near = np.flatnonzero(((table[among] >= low) & (table[among] <= high)).all(1))
        found, whom = [], []
        for at in range(0, len(near), 1 << 14):
            part = near[at : at + (1 << 14)]
            close = distance(prints[front][:, None], prints[among[part]][None]) <= limit
            any_ = close.any(0)
            found.append(part[any_])
            whom.append(front[close[:, any_].argmax(0)])
        return np.concatenate(found or [np.empty(0, np.int64)]), np.concatenate(whom or [np.empty(0, np.int64)])

    while len(rest):
        front, rest = rest[:FRONT], rest[FRONT:]
        found, _ = hits(front, rest)
        inner = distance(prints[front][:, None], prints[front][None]) <= limit
        if not len(found) and inner.sum() == len(front):
            continue  # nobody here links to anything left
        queue, rest = front[:1], np.concatenate([front[1:], rest])
        while len(queue):
            front, queue = queue[:FRONT], queue[FRONT:]
            found, whom = hits(front, rest)
            out.append((rest[found], whom))
            queue = np.concatenate([queue, rest[found]])
            keep = np.ones(len(rest), bool)
            keep[found] = False
            rest = rest[keep]
    return out


def linked(keys: np.ndarray, prints: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Places of links inside groups of equal keys, enough to join each group's components. Rows (of one or more words) are sorted by key."""
    table = pivot_table(prints)
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(np.append(edge, len(keys)))
    left, right = [], []

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        near = np.abs(table[i] - table[j]).max(1, initial=0) <= limit
        i, j = i[near], j[near]
        close = distance(prints[i], prints[j]) <= limit
        left.append(i[close])
        right.append(j[close])

    small = np.repeat(size <= SMALL, size)
    for d in range(1, min(SMALL, int(size.max(initial=1)))):
        i = np.flatnonzero(small[:-d] & (keys[d:] == keys[:-d]))
        if not len(i):
            break
        for at in range(0, len(i), 1 << 16):
            verify(i[at : at + (1 << 16)], i[at : at + (1 << 16)] + d)
    for s, n in zip(edge[size > SMALL], size[size > SMALL], strict=True):
        for a, b in _search(prints[s : s + n], table[s : s + n], limit):
            left.append(a + s)
            right.append(b + s)
    return np.concatenate(left or [np.empty(0, np.int64)]), np.concatenate(right or [np.empty(0, np.int64)])


def _keys(fp: Column, limit: int) -> Column:
    """Keys of which two fingerprints within the limit share one at least; the low bits say which blocks a key is of."""
    equal = 2 if limit <= 4 else 3
    n = limit + equal
    if limit > 7:
        raise ValueError("more differing bits than the keys allow")
    edges = [64 * i // n for i in range(n + 1)]
    parts = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << hi - lo) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    width = max(hi - lo for lo, hi in zip(edges, edges[1:], strict=False))
    keys = []
    for k, some in enumerate(combinations(range(n), equal)):
        key = parts[some[0]]
        for i in some[1:]:
            key = F.shiftleft(key, width).bitwiseOR(parts[i])
        keys.append(F.shiftleft(key, 7).bitwiseOR(F.lit(k).cast("long")))
    return F.array(*keys)


def _sampled_keys(words: Column, size: int, first: int, last: int) -> Column:
    """Of KEYS keys of five hexadecimal digits each, which a seeded rule draws, those from `first` up to `last`; the low bits say which key it is."""
    rng = np.random.default_rng(SEED)
    digits = np.array([sorted(rng.choice(16 * size, 5, replace=False).tolist()) for _ in range(KEYS)])[first:last]
    n = len(digits)

    def run(column: pa.Array) -> pa.Array:
        own = column.flatten().to_numpy().view(np.uint64).reshape(len(column), size)
        keys = np.zeros((len(own), n), np.uint64)
        for d in digits.T:
            keys = keys << np.uint64(4) | own[:, d // 16] >> (4 * (d % 16)).astype(np.uint64) & np.uint64(15)
        keys = keys << np.uint64(7) | np.arange(first, last, dtype=np.uint64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * n), pa.array(keys.ravel().view(np.int64)))

    return F.arrow_udf(run, T.ArrayType(T.LongType()))(words)


def near_links(prints: DataFrame, limit: int = LIMIT, size: int = 1, first: int = 0, last: int = KEYS) -> DataFrame:
    """(a, b): links between distinct fingerprints (`node`, `words`, `root`) that are not known to be joined, enough to join every component.

    Fingerprints of one `root` are joined already. Of one word all links are found. Of more words the keys are digits drawn
    from all of them, and a link is found with a probability that the differing bits decide: 0.99 at 15 in a hundred, more below.
    """

    def search(batches):
        for rows in whole_groups(batches, "key"):
            prints = rows["words"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, size)
            a, b = linked(rows["key"].to_numpy(), prints, limit)
            node, root = rows["node"].to_numpy(), rows["root"].to_numpy()
            new = root[a] != root[b]
            if new.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[a[new]]), pa.array(node[b[new]])], names=["a", "b"])

    keys = _keys(F.get("words", F.lit(0)), limit) if size == 1 else _sampled_keys(F.col("words"), size, first, last)
    keyed = prints.select("node", "words", "root", F.explode(keys).alias("key"))
    sorted_ = keyed.repartition("key").sortWithinPartitions("key", "node")
    return sorted_.mapInArrow(search, "a long, b long").distinct()


def _roots(classes: DataFrame, limit: int, size: int) -> DataFrame:
    """(a, b) as `components` gives it.

    Of wide fingerprints a few keys come first: they join what is close, so that a large group of near copies does not
    report its links anew for each of the other keys.
    """
    alone = classes.withColumn("root", F.col("node"))
    if size == 1:
        return components(near_links(alone, limit), "simhash-links")
    close = components(near_links(alone, limit, size, 0, FIRST_KEYS), "simhash-close")
    joined = classes.join(close.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", "words", F.coalesce("root", "node").alias("root"))
    return components(close.union(near_links(joined, limit, size, FIRST_KEYS, KEYS)), "simhash-links")


def _node(words: Column, size: int) -> Column:
    """One long that stands for a fingerprint."""
    return F.get(words, F.lit(0)) if size == 1 else F.xxhash64(words)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, limit: int = LIMIT, size: int = 1) -> DataFrame:
    """(key, words, component_id) for each row of `docs`; `words` are the fingerprint's."""
    own = written(docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), simhashes(F.col(f"`{text}`"), shingle, size).alias("words")), "simhash")
    labels = _labels(own, limit, size).select("node", "component_id")
    return own.withColumn("node", _node(F.col("words"), size)).join(labels, "node").select(F.col("doc_id").alias(key), "words", "component_id")


def _labels(own: DataFrame, limit: int, size: int) -> DataFrame:
    """(node, least, root, component_id) for each fingerprint of `own` (doc_id, words)."""
    classes = written(own.groupBy("words").agg(F.min("doc_id").alias("least")).select(_node(F.col("words"), size).alias("node"), "words", "least"), "simhash-classes")
    roots = _roots(classes.select("node", "words"), limit, size)
    with_root = classes.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = with_root.groupBy("root").agg(F.min("least").alias("component_id"))
    return with_root.join(least, "root").select("node", "least", "root", "component_id")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, limit: int = LIMIT, size: int = 1) -> DataFrame:
    """The rows of `docs` that stay when of each component only the row of the least id does (of equal rows, one)."""
    node, least_, stay_ = fresh(docs, "node", "least", "stay")
    marked = docs.withColumn(node, simhashes(F.col(f"`{text}`"), shingle, size))
    own = written(marked.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(node).alias("words")), "simhash")
    labels = _labels(own, limit, size)
    # the component's row of least id; where several fingerprints have that id, the least of them
    stay = labels.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("x")).select(F.col("x.least").alias(least_), F.col("x.node").alias(stay_))
    marked = marked.withColumn(node, _node(F.col(node), size))
    kept = marked.join(stay, (F.col(node) == F.col(stay_)) & F.col(f"`{key}`").cast("long").eqNullSafe(F.col(least_)), "left_semi")
    return kept.dropDuplicates([node, key]).drop(node)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.get("words", F.lit(0)))), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLE_SQL: dict[str, str] = {}
