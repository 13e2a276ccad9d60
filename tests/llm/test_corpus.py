"""Deduplication, nearest neighbours, LM scoring, packing and the pipeline: against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import graphs, lm, packing, simhash, suffixes, vectors
from tessera.llm.maxent import Learner, Model, Shape


def groups(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def naive_print(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), seed=42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    random.seed(0)
    texts = ["", "a", "A b", "a b c d", "a b c d e", "x " * 50] + [" ".join(random.choice("abcdefgÀÉ") for _ in range(random.randint(0, 40))) for _ in range(50)]
    assert [simhash.fingerprint(t)[0] for t in texts] == [naive_print(t) for t in texts]
    assert spark.sql("SELECT xxhash64('a b c d') AS h").first().h % 2**64 == xxhash.xxh64_intdigest(b"a b c d", seed=42)


@pytest.mark.parametrize("limit", [2, 4, 7])
def test_links_join_all_components(spark, limit):
    rng = np.random.default_rng(limit)
    centre = int(rng.integers(0, 1 << 63))
    points = {centre, 0}
    for n in range(1500):  # one dense ball, chains from it, and loose points
        x = centre if n % 3 else int(rng.integers(0, 1 << 63))
        for _ in range(int(rng.integers(0, limit + 4))):
            x ^= 1 << int(rng.integers(0, 64))
        points.add(x)
    p = np.array(sorted(points), np.uint64)
    df = spark.createDataFrame([(int(x), [int(x)], int(x)) for x in p.view(np.int64)], "node long, words array<long>, root long")
    found = simhash.near_links(df, limit).collect()
    place = {int(x): i for i, x in enumerate(p.view(np.int64))}
    got = groups(len(p), [(place[r.a], place[r.b]) for r in found])
    want = groups(len(p), [(i, int(j)) for i in range(len(p)) for j in np.flatnonzero(np.bitwise_count(p[i] ^ p[i + 1 :]) <= limit) + i + 1])
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))
    assert len(found) < 40 * len(p)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 60)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.a: r.b for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 0 for i in range(1, 60)}, 301: 300}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_and_odd_rows(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").toPandas()
    prints = np.array([naive_print(t) for t in docs.text], np.uint64)
    of = groups(len(docs), [(i, int(j)) for i in range(len(docs)) for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= 4) + i + 1])
    least = docs.doc_id.groupby(np.array(of)).transform("min")
    got = simhash.op4_simhash(spark, tiny).toPandas().set_index("doc_id").loc[docs.doc_id]
    assert (got.component_id.to_numpy() == least.to_numpy()).all() and (got.fingerprint == [f"{x:016x}" for x in prints]).all()
    odd = spark.createDataFrame([(5, None, 1), (4, "", 1), (4, "", 1), (None, "a b", 1), (None, "a b", 1), (7, "word " * 20000, None)], "doc_id long, text string, NODE int")
    rows = simhash.near_duplicates(odd).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 0), (4, 4), (4, 4), (5, 4), (7, 7)]
    assert sorted((r.doc_id or 0) for r in simhash.first_of_each(odd).collect()) == [0, 4, 7]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.first_of_each(odd.limit(0)).count() == 0


def test_similar_texts_are_linked(spark):
    random.seed(7)
    word = lambda: "".join(random.choice("abcdefghijklmnopq") for _ in range(random.randint(2, 8)))
    docs, want = [], {}
    for i in range(60):  # an original, a copy with one word in 120 changed, and a text of the same words in another order
        own = [word() for _ in range(240)]
        near = [word() if k % 120 == 60 else w for k, w in enumerate(own)]
        docs += [(3 * i, " ".join(own)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(random.sample(own, len(own))))]
        want |= {3 * i: 3 * i, 3 * i + 1: 3 * i, 3 * i + 2: 3 * i + 2}
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=5, limit=19, size=2).collect()
    assert sum(want[r.doc_id] != r.component_id for r in got) <= 3


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        out.append((len(b), int(gone.sum()), len(edges) // 2, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup_is_exact(spark, small, monkeypatch):
    if small:  # many batches, levels and shards
        for k, v in (("SHARED", 3), ("OFFSETS", 8), ("BATCH", 512), ("SHARD", 3000)):
            monkeypatch.setattr(suffixes, k, v)
    random.seed(3)
    word = lambda letters, low, high: "".join(random.choice(letters) for _ in range(random.randint(low, high)))
    pool = [word("abc é", 20, 160) for _ in range(12)]
    texts = ["".join(random.choice(pool) if random.random() < 0.5 else word("abcdefgh ", 1, 60) for _ in range(random.randint(0, 8))) for _ in range(200)]
    texts += [None, "", "a" * 500, "ab" * 100, texts[5], texts[5], None]
    ids = [*range(len(texts) - 3), None, 5, 5]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumns({"DEDUP": F.lit(1), "text_hash": F.lit(2), "spans": F.lit(3)}).repartition(4)
    got = suffixes.suffix_dedup(df, length=40, probe=13).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    rows = sorted(((r.doc_id, r.text or "", r.dedup.n_bytes, r.dedup.n_removed, len(r.dedup.runs), bytes(r.dedup.kept)) for r in got), key=key)
    assert rows == sorted(((i, t or "", *b) for i, t, b in zip(ids, texts, brute_removed(texts, 40), strict=True)), key=key)


def test_suffix_dedup_query(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").toPandas()
    got = suffixes.op3_suffix_dedup(spark, tiny).toPandas().set_index("doc_id")
    for i, b in zip(docs.doc_id, brute_removed(docs.text, 400), strict=True):
        assert got.loc[i].to_list() == [*b[:3], hashlib.sha256(b[3]).hexdigest()]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.suffix_dedup(empty).count() == 0


def test_suffix_dedup_keeps_whole_characters(spark):
    shared = "é" * 300
    df = spark.createDataFrame([(1, "a" + shared + "\u00ea"), (2, "b" + shared + "\u00eb")], "doc_id long, text string")
    assert sorted(r.dedup.kept for r in suffixes.suffix_dedup(df, characters=True).collect()) == ["aê", "bë"]


def brute_words(texts, n):
    """Of each text the byte runs from the first to the last of neighbouring words that repeated strings of `n` words cover; of ASCII texts."""
    words = [[(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for t in texts]
    windows = [[tuple(x[0] for x in w[i : i + n]) for i in range(len(w) - n + 1)] for w in words]
    count = Counter(x for w in windows for x in w)
    out = []
    for w, own in zip(words, windows, strict=True):
        gone = {i + k for i, x in enumerate(own) if count[x] > 1 for k in range(n)}
        out.append([(w[s][1], w[next(e for e in range(s, len(w)) if e + 1 not in gone)][2]) for s in sorted(gone) if s - 1 not in gone])
    return out


def test_repeated_passages_of_short_words_go(spark):
    """51 words of under 240 bytes, and 51 words that are wrapped differently; 50 words stay."""
    random.seed(11)
    word = lambda low, high: "".join(random.choice("abcdefghijklmnopq") for _ in range(random.randint(low, high)))
    sentence = lambda n, low=4, high=8: " ".join(word(low, high) for _ in range(n))
    short, fifty, wrapped = sentence(51, 1, 3), sentence(50, 1, 3), sentence(51)
    assert len(short) < 200 < 240 < len(wrapped)
    texts = [f"{sentence(30)} {p} {sentence(30)}" for p in (short, fifty, wrapped) for _ in range(2)] + [f"{sentence(30)}\n{wrapped.replace(' ', chr(10) + ' ')}", short]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.repeats(spark, docs, "").collect()}
    assert all(short not in r.text for r in got.values()) and sum(fifty in r.text for r in got.values()) == 2 and sum(wrapped.split()[25] in r.text for r in got.values()) == 0
    assert got[7].text == "" and got[2].text == texts[2] and all(r.n_chars == len(r.text) for r in got.values())
    assert got[0].text == texts[0].replace(short, "")


@pytest.mark.parametrize("small", [False, True])
def test_repeated_words_are_exact(spark, small, monkeypatch):
    if small:
        for k, v in (("SHARED", 3), ("OFFSETS", 4), ("BATCH", 64), ("SHARD", 300)):
            monkeypatch.setattr(suffixes, k, v)
    random.seed(4)
    pool = [[random.choice(["a", "bb", "c", "dd", "e"]) for _ in range(random.randint(5, 30))] for _ in range(12)]
    texts = ["".join(w + random.choice([" ", "  ", "\n"]) for _ in range(random.randint(0, 8)) for w in (random.choice(pool) if random.random() < 0.5 else [f"w{random.randrange(10**6)}"] * random.randint(1, 12))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.dedup.kept for r in suffixes.suffix_dedup(df, length=4000, probe=200, characters=True, words=9).collect()}
    want = {i: suffixes.cut(t.encode(), runs).decode() for i, (t, runs) in enumerate(zip(texts, brute_words(texts, 9), strict=True))}
    assert got == want and sum(want[i] != t for i, t in enumerate(texts)) > 100


def test_index_family_merges_geometrically():
    text = np.frombuffer(random.Random(1).randbytes(4000), np.uint8)
    family = suffixes.IndexFamily(text, 50)
    for at in range(0, 3900, 100):
        family.add(np.arange(at, at + 50))
        sizes = [len(x) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
        for level in family.levels:
            keys = [text[s : s + 50].tobytes() for s in level]
            assert keys == sorted(keys)


def test_nearest_recall_and_odd_rows(spark, tiny):
    e = spark.read.parquet(f"{tiny}/embeddings.parquet").toPandas()
    x, ids = np.stack(e.embedding.to_numpy()).astype(float), e.vec_id.to_numpy()
    got = vectors.op8_nearest(spark, tiny).toPandas()
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        own = got[got.query_id == q].sort_values("rank")
        others = np.flatnonzero(ids != q)
        best = others[np.lexsort((ids[others], -s[others]))][:20]
        hit += len(set(ids[best]) & set(own.vec_id))
        total += 20
        assert np.allclose(own.score, [s[ids == v][0] for v in own.vec_id], rtol=0, atol=1e-12) and own["rank"].to_list() == list(range(1, 21))
    assert hit >= 0.95 * total
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [2.0]), (9, [0.5, -1.0]), (10, [])]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("RANK", F.lit(1))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in vectors.nearest(odd, odd.where("vec_id in (0, 3, 4)")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 9, 0.5)]
    assert vectors.nearest(odd.limit(0), odd.limit(0)).count() == 0


def test_nearest_finds_in_a_dense_cluster():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (3000, 32)), rng.normal(0, 1, 32) + 0.02 * rng.normal(0, 1, (1500, 32))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = vectors.AnisotropicQuantizer(32).fit(x)
    order = np.lexsort(x.T[::-1])
    codes, cells, sizes, shifts = q.encode(x[order])
    asked = np.arange(0, 4500, 50)
    where, found, _ = vectors.search_tile(q, order, codes, cells, sizes, shifts, x[order], asked, x[asked], 20)
    recall = [len(set(found[where == k]) & set(np.argsort(-np.where(np.arange(4500) == a, -9, x @ x[a]))[:20])) / 20 for k, a in enumerate(asked)]
    assert np.mean(recall) >= 0.9, np.mean(recall)


def test_model_is_a_distribution_and_learns():
    shape = Shape(classes=4, members=5, shared=1, pair_rows=64, member_rows=256)
    mass = np.array([90, 50, 30, 20, 10, 9, 8, 7, 6, 5, 4, 3, 0, 0, 0, 30, 20, 20, 20, 10], float)
    m = Model(shape, mass)
    rng = np.random.default_rng(0)
    words = np.concatenate([[1, 2, 3, 17, 5, 6][k % 6 : k % 6 + 1] if rng.random() < 0.9 else rng.choice(np.flatnonzero(mass), 1) for k in range(3000)])
    rows = m.contexts(words)
    before = m.log_probs(rows, words).mean()
    learner = m.learner()
    for n in range(3):
        learner.train(rows, words, 0.3, n)
    assert not m.class_weights.any()  # the learner has its own
    m = learner.model
    assert m.log_probs(rows, words).mean() > before + 0.5
    outcomes = np.flatnonzero(mass)
    for place in (0, 1, 77):
        p = m.log_probs(np.repeat(rows[:, place : place + 1], len(outcomes), 1), outcomes)
        assert abs(np.exp(p).sum() - 1) < 1e-4


def test_updates_are_the_sums_of_the_rows():
    rng = np.random.default_rng(0)
    rows, g = np.minimum(rng.zipf(1.3, 3000), 499).astype(np.int32), rng.normal(size=(3000, 7)).astype(np.float32)
    weights, steps = np.zeros((500, 7), np.float32), np.full(500, 1e-2, np.float32)
    Learner._update(weights, steps, rows, g, 0.3)
    total = np.zeros((500, 7))
    np.add.at(total, rows, g)
    own = 1e-2 + (total**2).mean(1)
    assert np.allclose(steps, np.where(total.any(1), own, 1e-2), rtol=1e-3) and np.allclose(weights, -0.3 * total / np.sqrt(own)[:, None], atol=1e-4)


def test_shares_of_words_add_up():
    """Over a whole vocabulary, one unseen word in each shared outcome included, a word's share of its outcome sums to one."""
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(-(1 << 62), 1 << 62, 20000))
    counts = np.minimum(rng.zipf(1.4, len(hashes)), 5000)
    order = np.lexsort((hashes, -counts))
    slot, top = lm.SHAPE.slot(hashes), order[: lm.SHAPE.single]
    v = lm.Vocabulary(hashes[top], counts[top], np.bincount(slot, counts, lm.SHAPE.slots), np.bincount(slot, minlength=lm.SHAPE.slots))
    of = v.of(hashes)
    assert (of[top] == np.arange(len(top))).all() and (np.delete(of, top) >= lm.SHAPE.single).all()
    rest = np.delete(np.arange(len(hashes)), top)
    share = np.bincount(of[rest] - lm.SHAPE.single, (counts[rest] + 0.5) / v.shared[of[rest] - lm.SHAPE.single], lm.SHAPE.slots) + 0.5 / v.shared
    assert np.allclose(share, 1) and math.isclose(v.mass.sum(), counts.sum() + 0.5 * (len(hashes) + lm.SHAPE.slots))


def test_bucket_sums_with_many_merges(monkeypatch):
    monkeypatch.setattr(lm, "MERGE", 50)
    rng = np.random.default_rng(0)
    chunks = [np.unique(rng.integers(0, 300, 40)) for _ in range(30)]
    counts = [rng.integers(0, 5, len(c)).astype(np.uint32) for c in chunks]
    want = Counter()
    for c, n in zip(chunks, counts, strict=True):
        want.update(dict(zip(c.tolist(), n.tolist(), strict=True)))
    rows = [(7, p, k, c.tobytes(), n.tobytes() if p == 0 else None) for p in (0, 1) for k, (c, n) in enumerate(zip(chunks, counts, strict=True))]
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 9], strict=True), types, strict=True)], names=["bucket", "phase", "chunk", "a", "b"]) for i in range(0, 60, 9)]
    out = [r for b in lm._add_up(batches) for r in b.to_pylist()]
    assert [r["kind"] for r in out] == [3, 4, *[0] * 30]
    for r, c in zip(out[2:], chunks, strict=True):
        assert np.frombuffer(r["b"], np.int64).tolist() == [want[x] for x in c.tolist()]
    sums = np.frombuffer(out[1]["a"], np.int64)
    assert sums[: lm.SHAPE.slots].sum() == sum(want.values()) and sums[lm.SHAPE.slots :].sum() == sum(n > 0 for n in want.values())


def test_lm_scores(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").toPandas()
    tokens = {i: "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split() + [b" "] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    count = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    got = lm.op9_lm(spark, tiny).toPandas()
    for r in got.itertuples():
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(w in count for w in t), n)
        assert abs(r.base_score - sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) < 1e-6
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()  # better on what it has not seen
    odd = spark.createDataFrame([(1, None, 0), (None, "", 0), (2, "a A a", 0), (2, "a A a", 0), (3, "w " * 50000, 0)], "doc_id long, text string, score int")
    rows = {(r.doc_id, r.n_tokens): r for r in lm.lm_scores(odd).collect()}
    assert rows[(1, 1)].n_known == 1 and rows[(None, 1)].score < 0 and rows[(3, 50001)].n_tokens == 50001
    assert lm.lm_scores(odd).count() == 5 and lm.lm_scores(odd.limit(0)).count() == 0


def test_lm_without_training_texts(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    rows = lm.lm_scores(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in rows)


def check_packing(pieces, ids):
    pieces = sorted(pieces, key=lambda r: (r[0], r[1]))
    at = Counter()
    for doc, start, n, crc, total, _, _ in pieces:
        assert start == at[doc] and total == len(ids[doc]) and zlib.crc32(np.array(ids[doc][start : start + n], "<u4").tobytes()) == crc
        at[doc] += n
    assert at == {d: len(x) for d, x in ids.items()}
    sequences: dict = {}
    for r in pieces:
        sequences.setdefault(r[5], []).append((r[6], r[2]))
    padding = 0
    for own in sequences.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= 4096
        padding += 0 if end & (end - 1) == 0 else 4096 - end
    return padding


def test_packing_query(spark, tiny):
    tokenizer = Tokenizer.from_file(packing.public_tokenizers.path(packing.VOCABULARY))
    docs = spark.read.parquet(f"{tiny}/documents.parquet").toPandas()
    ids = {i: [*e.ids, 2] for i, e in zip(docs.doc_id, tokenizer.encode_batch(docs.text.to_list(), add_special_tokens=False), strict=True)}
    assert check_packing([tuple(r) for r in packing.op10_packing(spark, tiny).collect()], ids) == 0


def test_packing_tokens_are_the_library_s():
    path = packing.public_tokenizers.path(packing.VOCABULARY)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    random.seed(0)
    letters = "abcdefghij THE 's\n\t éüñßÀŒİŉſ中文🙂́\u030cJH\u0085\x1c\x001²½3%%%$&ΣςΑ"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(4000)] + ["<|endoftext|> x<|startoftext|>y", "a" * 5000]
    for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(packing.encode_text(t, path), np.uint16).tolist() == [*e.ids, 2], t


def test_packing_asks_the_model_once_a_part(monkeypatch):
    encoder = packing.WordEncoder(packing.public_tokenizers.path(packing.VOCABULARY))
    asked = []
    monkeypatch.setattr(encoder, "_part", lambda part, make=encoder._part: asked.append(part) or make(part))
    words = [b"alpha", b"alpha.", b"Alpha,", b"alpha", b"it's", b"gr\xc3\xbcn.", b"gr\xc3\xbcn"]
    ids = [encoder.words[w] for w in words]
    assert [np.frombuffer(x, np.uint16).tolist() for x in ids] == [encoder.tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words]
    assert len(asked) == len(set(asked)) == 6  # alpha . , it 's grün: words and parts are one table


def test_packing_neighbours_share_words():
    rng = np.random.default_rng(0)
    docs = [rng.integers(100 * (i % 4) + 10, 100 * (i % 4) + 60, 900).astype(np.uint16) for i in range(40)]
    windows: dict = {}
    for doc, _, n, s, _ in packing.pack(docs):
        windows.setdefault(s, Counter())[doc % 4] += n
    alike = sum(max(c.values()) for c in windows.values()) / sum(sum(c.values()) for c in windows.values())
    assert alike > 0.85  # documents of one vocabulary meet


def test_packing_finds_neighbours_in_all_shards(spark):
    """Documents of one of 48 subjects, dealt out at random; a shard holds a twelfth of them."""
    random.seed(2)
    words = [["".join(random.choice("bcdfglmnprst") + random.choice("aeiou") for _ in range(3)) for _ in range(30)] for _ in range(49)]
    subject = {i: random.randrange(48) for i in range(768)}
    texts = [(i, " ".join(random.choice(words[k] if random.random() < 0.4 else words[48]) for _ in range(120))) for i, k in subject.items()]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    windows: dict = {}
    rows = packing.retrieval_packing(df, shard_rows=64).collect()
    for r in rows:
        windows.setdefault(r.sequence_id, Counter())[subject[r.doc_id]] += r.length
    assert len(windows) > 40 and len({r.doc_id for r in rows}) == 768
    alike = sum(max(c.values()) for c in windows.values()) / sum(sum(c.values()) for c in windows.values())
    assert alike > 0.6, alike  # about 14 documents a window, 16 of each subject: by chance it is below 0.2


def test_bm25_scores():
    docs = [np.array(x, np.uint16) for x in ([1, 1, 2], [1, 3], [4], [5, 6, 7], [8])]
    index = packing.BM25(docs)
    mean = np.mean([len(d) for d in docs])
    for seed in range(5):
        want = np.zeros(5)
        for t in set(docs[seed].tolist()):
            df = sum(t in d for d in docs)
            idf = max(0.0, math.log((5 - df + 0.5) / (df + 0.5)))
            for i, d in enumerate(docs):
                tf = (d == t).sum()
                want[i] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        assert np.allclose(index.scores(seed), want)


def test_packing_on_odd_rows(spark):
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "a b"), (2, "a b"), (3, "word " * 9000)], "doc_id long, text string").withColumns({"START": F.lit(1), "ids": F.lit("x"), "shard": F.lit(2)})
    rows = packing.retrieval_packing(odd).collect()
    assert sum(r.length for r in rows) == 1 + 1 + 3 + 3 + 9001 and {r.doc_tokens for r in rows} == {1, 3, 9001}
    assert packing.retrieval_packing(odd.limit(0)).count() == 0


def brute_pipeline(docs):
    """Ids and texts that should reach the packing stage, by definition."""
    from test_text import brute_repeats

    kept = [(i, t) for i, t in docs if t and (s := brute_repeats(t)) and s[0] >= 10 and 100 * s[1] <= 20 * s[0] and s[2] <= 100]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in kept)]
    of = groups(len(kept), [(i, j) for i in range(len(kept)) for j in range(i + 1, len(kept)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    first: dict = {}
    for (i, t), g in sorted(zip(kept, of, strict=True)):
        first.setdefault(g, (i, t))
    kept = sorted(first.values())
    return {i: brute_cut(t, b) for (i, t), b in zip(kept, brute_gone([t for _, t in kept], 240), strict=True)}


def brute_gone(texts, length):
    """Which bytes of each text a string of `length` bytes covers that starts anywhere else too."""
    data = [t.encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def brute_cut(text, gone):
    """The text (of one byte a character) without the runs that hold more than 50 words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
    out, at = "", 0
    for s, e in zip(edges[::2], edges[1::2], strict=True):
        if sum(m.start() >= s and m.end() <= e for m in re.finditer(r"\S+", text)) > 50:
            out, at = out + text[at:s], e
    return out + text[at:]


def test_pipeline_against_brute_force(spark, tmp_path):
    random.seed(5)
    sentence = lambda n: " ".join("".join(random.choice("abcdefghijklmnopq") for _ in range(random.randint(2, 8))) for _ in range(n))
    passage, shorter, too_short = sentence(90), sentence(51), sentence(50)
    clean = [sentence(random.randint(12, 120)) for _ in range(40)]
    texts = clean + [clean[0], clean[1] + " more", "spam " * 60, sentence(3), "", None] + [f"{sentence(80)} {passage} {sentence(70)}" for _ in range(3)]
    texts += [f"{sentence(70)} {p} {sentence(90)}" for p in (shorter, too_short, sentence(60)) for _ in range(4)] + [f"{shorter}\n{sentence(60)}"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_pipeline(list(enumerate(texts)))
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == docs.columns and now.dtypes == docs.dtypes, k
    got = {r.doc_id: r.text for r in now.collect()}
    assert got == want and all(r.n_chars == len(r.text) for r in now.collect())
    assert all(passage not in t and shorter not in t for t in got.values()) and sum(too_short in t for t in got.values()) == 4
    tokenizer = Tokenizer.from_file(packing.public_tokenizers.path(packing.VOCABULARY))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in want.items()}
    assert check_packing([tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()], ids) == 0


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __fp long, __dedup string, kept boolean"
    long = " ".join(f"w{i}" for i in range(30000))
    odd = spark.createDataFrame([(1, None, None, None, None, 1, "x", True), (None, long, None, None, None, None, None, None), (None, long, None, None, None, None, None, None), (2, "", "en", "s", 0, 1, "y", False)], schema)
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, odd.limit(0)):
            out = stage(spark, df, "")
            rows = out.collect()
            if name != "packing":
                assert [c for c in out.columns] == odd.columns
            if name == "quality":
                assert len(rows) in (0, 2)
