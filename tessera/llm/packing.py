"""Lexical retrieval packing.

Documents are tokenized once; document frequencies and the mean length are counted over all of them. A document goes where
its weights lead: to one of 256 cells of hashed BM25 vectors, whose centres are fitted on about 4,096 documents, and there
to its three terms of greatest weight. All are sorted by these, and every run of so many neighbours in that order is a
shard with an inverted index of its own, whose weights are the whole corpus's. So documents that share what is rare in them
meet wherever they came from, and a subject, or a text, that very many share is cut into many shards. A window is seeded with the first unused document; the index returns unused neighbours, best first, which
fill the window greedily; the one that does not fit is cut and its rest stays unused. What a shard's last window holds is
cut into sequences whose lengths are powers of two, so nothing is padded there either.

Defined results: a null text is the empty text, which has only the end id; repeated rows are packed one by one; ties in score
go to the earlier document, by id and then by ids; a null document id sorts first; other columns are left out.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import Memo, hash_sample, keep_only, struct, table, texts, written

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
LENGTH = 4096
#: Documents in a shard; an index and the ids of so many are held at once.
SHARD_ROWS = 1024
#: Tasks that pack, at most; a task packs its shards one after another.
TASKS = 1 << 16
#: Terms by which documents are sorted, and what stands where a document has fewer.
ROUTE, NO_TERM = 3, 1 << 16
#: Documents that the cells' centres are fitted on, cells at most, numbers of a hashed vector, passes of the fit.
SAMPLE, CELLS, WIDTH, ROUNDS = 4096, 256, 256, 8
K1, B = 1.2, 0.75
#: Words and parts of words, in one table, that a worker keeps of those used lately.
CACHE = 450_000

#: Words of these characters are composed and lower-cased character by character, and split at the classes' edges only.
_SIMPLE = re.compile(r"[!-~À-ÖØ-öø-įı-ſ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")
_ASCII_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class WordEncoder:
    """Ids of words, as bytes of 16-bit ids: white space always parts tokens, so words can be encoded one by one."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # few of the parts that are not known here are known there
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet shows other bytes as characters from 256 on
        hidden = [b for b in range(256) if b not in visible]
        self.alphabet = {b: 256 + i for i, b in enumerate(hidden)}
        # a part is, as a word, one part
        self.words = Memo(self._word, CACHE)

    def _part(self, part: str) -> bytes:
        """What the model makes of one whole part, in the alphabet that it is given its input in."""
        return array("H", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        known = self.words
        if word.isalpha():  # of ASCII letters
            return self._part(word.decode()) if word.islower() else known[word.lower()]
        if word[:-1].isalpha() and 33 <= word[-1] < 127:
            return known[word[:-1]] + known[word[-1:]]
        text = word.decode()
        if text.isascii() and text.isprintable():
            parts = _ASCII_PARTS.findall(word.lower())
        elif _SIMPLE.fullmatch(text):
            parts = [p.encode() for p in _PARTS.findall(text.lower())]
        else:
            return array("H", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()
        if len(parts) > 1:
            return b"".join(map(known.__getitem__, parts))
        (part,) = parts
        if part != word:
            return known[part]
        return self._part(text if text.isascii() else word.decode("latin-1").translate(self.alphabet))


@lru_cache(2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_text(text: str, path: str) -> bytes:
    """Little-endian 16-bit ids, the end id last."""
    raw = text.encode()
    # Only A-Z, for fewer different words. Marks that these are composed with, which comes before the library lower-cases, start with one of two bytes.
    if b"\xcc" not in raw and b"\xcd" not in raw:
        raw = raw.lower()
    return b"".join(map(_encoder(path).words.__getitem__, raw.split())) + END_ID.to_bytes(2, "little")


def _terms(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, term, occurrences) of each document's distinct terms, by owner and term, and the documents' lengths."""
    length = np.array([len(d) for d in docs], np.int64)
    pair, tf = np.unique(np.repeat(np.arange(len(docs)) << 16, length) | np.concatenate([*docs, np.empty(0, np.uint16)]), return_counts=True)
    return pair >> 16, pair & 0xFFFF, tf, length


class Statistics:
    """Document frequencies by term, documents, and their mean length: what BM25 weighs by."""

    def __init__(self, df: np.ndarray, n: int, mean: float):
        self.df, self.n, self.mean = df, n, mean
        self.idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5)))

    def weights(self, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        norm = K1 * (1 - B + B * length / self.mean)
        return self.idf[term] * tf * (K1 + 1) / (tf + norm[owner])

    def route(self, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray, centres: np.ndarray | None = None) -> np.ndarray:
        """Each document's cell, and its terms of greatest weight that another document has too, best first, of equals the smaller."""
        n, weight = len(length), self.weights(owner, term, tf, length)
        h = term.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = owner * WIDTH + ((h >> np.uint64(40)) % np.uint64(WIDTH)).astype(np.int64)
        x = np.bincount(at, np.where(h >> np.uint64(63), -weight, weight), n * WIDTH).reshape(-1, WIDTH)
        x = (x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]).astype(np.float32)
        if centres is None:
            return x
        use = (weight > 0) & (self.df[term] > 1)
        # of positive floats the order is that of their bits
        low = np.uint64(0xFFFFFFFF) - weight[use].astype(np.float32).view(np.uint32).astype(np.uint64)
        best = np.sort(owner[use].astype(np.uint64) << np.uint64(48) | low << np.uint64(16) | term[use].astype(np.uint64))
        own = (best >> np.uint64(48)).astype(np.int64)
        place = np.arange(len(own)) - np.searchsorted(own, own)
        out = np.full((n, 1 + ROUTE), NO_TERM, np.int32)
        out[:, 0] = (x @ centres.T).argmax(1)
        first = place < ROUTE
        out[own[first], 1 + place[first]] = (best[first] & np.uint64(0xFFFF)).astype(np.int32)
        return out


def fit_cells(x: np.ndarray, seed: int = 1) -> np.ndarray:
    """Centres of the rows of `x` by cosine; at most CELLS, and about one for 16 rows."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.permutation(len(x))[: max(1, min(CELLS, len(x) // 16))])].copy()
    for _ in range(ROUNDS):
        cell = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


class BM25:
    """An inverted index over one shard: postings by term, each with its weight; without statistics, by the shard's own."""

    def __init__(self, docs: list[np.ndarray], statistics: Statistics | None = None):
        self.n = len(docs)
        owner, term, tf, length = _terms(docs)
        of = statistics or Statistics(np.bincount(term, minlength=1 << 16), self.n, length.mean())
        weight = of.weights(owner, term, tf, length)
        useful = weight > 0  # terms of half the documents and more weigh nothing, so they have no postings
        owner, term, weight = owner[useful], term[useful], weight[useful]
        self.df = np.bincount(term, minlength=1 << 16)
        self.at = np.cumsum(self.df) - self.df
        order = np.argsort(term.astype(np.uint16), kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.terms = np.split(term, np.searchsorted(owner, np.arange(1, self.n)))

    def scores(self, seed: int) -> np.ndarray:
        """Of every document for the seed's terms."""
        t = self.terms[seed]
        if not len(t):
            return np.zeros(self.n)
        size = self.df[t]
        ends = np.cumsum(size)
        at = np.repeat(self.at[t] - (ends - size), size) + np.arange(ends[-1])
        return np.bincount(self.owner[at], self.weight[at], self.n)


def pack(docs: list[np.ndarray], length: int = LENGTH, statistics: Statistics | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) pieces that hold every id once, in windows of `length`."""
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    used = np.zeros(len(docs), np.int64)  # ids that whole windows and cuts have taken from each document
    for i, d in enumerate(docs):
        for start in range(0, len(d) - length + 1, length):
            out.append((i, start, length, sequence, 0))
            sequence += 1
        used[i] = len(d) // length * length
    left = np.array([len(d) for d in docs]) - used
    open_ = left > 0
    index = BM25(docs, statistics)
    seed = 0
    while True:
        while seed < len(docs) and not open_[seed]:
            seed += 1
        if seed == len(docs):
            break
        window, room = [(seed, int(used[seed]), int(left[seed]))], length - int(left[seed])
        used[seed] += left[seed]
        left[seed], open_[seed] = 0, False
        if room:
            rest = np.flatnonzero(open_)
            if len(rest):
                score = index.scores(seed)[rest]
                for k in rest[np.argsort(-score, kind="stable")]:
                    take = min(room, int(left[k]))
                    window.append((int(k), int(used[k]), take))
                    used[k] += take
                    left[k] -= take
                    open_[k] = left[k] > 0
                    room -= take
                    if not room:
                        break
        filled = length - room
        sizes = [length] if not room else [1 << b for b in range(filled.bit_length() - 1, -1, -1) if filled >> b & 1]
        offset, size = 0, sizes.pop(0)
        for k, start, n in window:
            while n:
                if offset == size:
                    sequence, offset, size = sequence + 1, 0, sizes.pop(0)
                take = min(n, size - offset)
                out.append((k, start, take, sequence, offset))
                start, n, offset = start + take, n - take, offset + take
        sequence += 1
    return out


PIECES = struct(doc_id=T.LongType(), start=T.LongType(), length=T.LongType(), ids=T.BinaryType(), doc_tokens=T.LongType(), sequence_id=T.LongType(), offset=T.LongType())


def retrieval_packing(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pieces of `docs`: doc_id, start, length, ids (little-endian, 32 bits each), doc_tokens, sequence_id, offset."""
    path = path or public_tokenizers.path(VOCABULARY)

    def tokenize(column: pa.Array) -> pa.Array:
        keep_only(_encoder(path).words)
        return pa.array([encode_text(t, path) for t in texts(column)], pa.binary())

    own = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    some = hash_sample(own, own.count(), SAMPLE, "doc_id", "text").select(F.arrow_udf(tokenize, T.BinaryType()).asNondeterministic()("text").alias("ids"))
    rough, centres = _fit(written(some, "packing-sample"))

    def encode(batches):
        """Every row's ids and where it goes; at last the part's document frequencies, documents and tokens."""
        df, rows, total = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            ids = tokenize(batch.column("text"))
            found = _terms(_arrays(ids))
            df += np.bincount(found[1], minlength=1 << 16)
            rows, total = rows + len(ids), total + int(found[3].sum())
            yield _routed(batch.column("doc_id"), ids, rough.route(*found, centres), pa.nulls(len(ids), pa.binary()))
        last = np.concatenate([[rows, total], df]).astype("<i8")
        yield _routed(pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), np.full((1, 1 + ROUTE), -1, np.int32), pa.array([last.tobytes()], pa.binary()))

    parts = written(own.mapInArrow(encode, ROUTED), "packing-ids")
    statistics = _total(parts.where("t0 = -1").select("counts"))

    def shards(batches):
        keep_only()
        part, number, rows = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                rows.append(row)
                if len(rows) == shard_rows:
                    yield from pieces(rows, part << 40 | number << 24)
                    number, rows = number + 1, []
        if rows:
            yield from pieces(rows, part << 40 | number << 24)

    def pieces(rows: list[tuple], first: int):
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        ids = [np.frombuffer(r[1], np.uint16) for r in rows]
        p = pack(ids, length, statistics)
        for at in range(0, len(p), 4096):
            own = p[at : at + 4096]
            columns = [
                pa.array([rows[i][0] for i, *_ in own], pa.int64()),
                pa.array([x[1] for x in own], pa.int64()),
                pa.array([x[2] for x in own], pa.int64()),
                pa.array([ids[i][s : s + n].astype("<u4").tobytes() for i, s, n, _, _ in own], pa.binary()),
                pa.array([len(ids[x[0]]) for x in own], pa.int64()),
                pa.array([first + x[3] for x in own], pa.int64()),
                pa.array([x[4] for x in own], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=PIECES.names)

    # by content at last, so that rows of the same terms, the same id or no id are cut apart too
    order = [*(f"t{i}" for i in range(1 + ROUTE)), F.xxhash64("doc_id", "ids")]
    tasks = min(TASKS, max(1, -(-statistics.n // (2 * shard_rows))))
    return parts.where("t0 >= 0").drop("counts").repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(shards, PIECES)


ROUTED = struct(doc_id=T.LongType(), ids=T.BinaryType(), **{f"t{i}": T.IntegerType() for i in range(1 + ROUTE)}, counts=T.BinaryType())


def _routed(doc_id: pa.Array, ids: pa.Array, to: np.ndarray, counts: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_id, ids, *(pa.array(c) for c in to.T), counts], names=ROUTED.names)


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def _total(counts: DataFrame) -> Statistics:
    """The sum over all parts; what reaches the driver is as long as the vocabulary."""

    def split(batches):
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                n = np.frombuffer(x, "<i8")
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at - 2), pa.array(n[at])], names=["term", "n"])

    found = {r.term: r.n for r in counts.mapInArrow(split, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    rows, total = found.pop(-2, 0), found.pop(-1, 0)
    df = np.zeros(1 << 16, np.int64)
    df[list(found)] = list(found.values())
    return Statistics(df, rows, max(1.0, total / max(1, rows)))


def _fit(some: DataFrame) -> tuple[Statistics, np.ndarray]:
    """The sample's statistics, by which documents are routed, and the cells' centres."""

    def count(batches):
        for batch in batches:
            _, term, _, length = _terms(_arrays(batch.column("ids")))
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[len(length), length.sum()], np.bincount(term, minlength=1 << 16)]).astype("<i8").tobytes()], pa.binary())], names=["counts"])

    rough = _total(some.mapInArrow(count, "counts binary"))

    def vector(column: pa.Array) -> pa.Array:
        return pa.array([v.tobytes() for v in rough.route(*_terms(_arrays(column)))], pa.binary())

    x = some.select(F.arrow_udf(vector, T.BinaryType())("ids").alias("v")).collect()
    return rough, fit_cells(np.frombuffer(b"".join(r.v for r in x), np.float32).reshape(-1, WIDTH)) if x else np.zeros((1, WIDTH), np.float32)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(retrieval_packing(table(spark, sf_dir, "documents")))


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op10_packing": op10_packing}
ORACLE_SQL: dict[str, str] = {}
