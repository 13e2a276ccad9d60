"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has exactly one token that can end its encoding: the token t for which the encoding of the rest
ends in a token s such that merging the bytes of s and t by rank gives s, t again. The table of these last tokens is all
that is stored. Appending bytes extends the table; after an edit the table is kept up to the edit, recomputed behind it, and
kept again once as many entries as the longest token has bytes agree with the old ones.

Defined results: a null text is the empty text and has no ids; lone surrogates cannot occur in Spark strings; texts of any
length are encoded whole; ids that the vocabulary lacks raise in decoding; an input column named as the output is replaced.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, put, struct, table, texts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces and token pairs that a worker keeps, of those used lately.
CACHE = 250_000


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.tokens[v] = k
        self.longest = max(map(len, ranks))
        self.tails = {k[i:] for k in ranks for i in range(len(k))}
        self._bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self._size = np.array([len(t) for t in self.tokens])
        self._start = np.cumsum(self._size) - self._size
        self._whole: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """By definition: the adjacent parts of lowest joint rank are merged, the first of equals, until none has a rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def reachable(self, token: int) -> bool:
        """Merging its bytes gives the token itself."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merged(self.tokens[token]) == [token]
        return known

    def fits(self, first: int, second: int) -> bool:
        """The two tokens may stand next to each other; then each of them is reachable as well."""
        if len(self._pairs) >= 4 * CACHE:
            self._pairs.clear()
        known = self._pairs[first << 20 | second] = self.merged(self.tokens[first] + self.tokens[second]) == [first, second]
        return known

    def extend(self, data: bytes, last: list[int], upto: int | None = None) -> list[int]:
        """Adds the last tokens of all longer prefixes of `data` to the table `last`, in which entry 0 stands for no bytes."""
        rank, tails, pair = self.ranks.get, self.tails, self._pairs.get
        for end in range(len(last), (len(data) if upto is None else upto) + 1):
            for start in range(end - 1, -1, -1):
                piece = data[start:end]
                token = rank(piece)
                if token is None:
                    if piece in tails:
                        continue
                    raise ValueError("the vocabulary lacks single bytes")
                if not start:
                    if self.reachable(token):
                        break
                elif (known := pair(last[start] << 20 | token)) or known is None and self.fits(last[start], token):
                    break
            last.append(token)
        return last

    def read(self, last: list[int]) -> list[int]:
        """The encoding that a table stands for."""
        ids, at = [], len(last) - 1
        while at > 0:
            ids.append(last[at])
            at -= len(self.tokens[last[at]])
        return ids[::-1]

    def piece(self, data: bytes) -> list[int]:
        """A whole piece; one that is a token as it stands is that token."""
        token = self.ranks.get(data)
        return [token] if token is not None else self.read(self.extend(data, [-1]))

    def edited(self, old: bytes, last: list[int], at: int, removed: int, added: bytes) -> tuple[bytes, list[int], int]:
        """`old` with `removed` bytes from `at` replaced by `added`: the new bytes, their table, and how many entries were computed."""
        new = old[:at] + added + old[at + removed :]
        shift = len(added) - removed
        table, same = last[: at + 1], 0
        while len(table) <= len(new):
            self.extend(new, table, len(table))
            end = len(table) - 1
            same = same + 1 if end > at + len(added) and table[end] == last[end - shift] else 0
            if same >= self.longest and end - self.longest >= at + len(added):
                return new, table + last[end - shift + 1 :], end - at
        return new, table, len(new) - at

    def decode(self, ids: np.ndarray) -> bytes:
        """By gathering: each output byte's place in the joined vocabulary."""
        if not len(ids):
            return b""
        size = self._size[ids]
        if not size.all():
            raise ValueError("an id that the vocabulary lacks")
        ends = np.cumsum(size)
        return self._bytes[np.repeat(self._start[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes()


@lru_cache(2)
def load(path: str) -> PrefixBPE:
    with open(path, "rb") as f:
        return PrefixBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


#: Characters that every Unicode version of the last twenty years classes alike.
SETTLED = regex.compile(r"[\x00-\u024f\u2000-\u206f\u20ac]*")


@lru_cache(1)
def _unknown_to_library() -> dict[int, int]:
    """Letters and numbers of this regex module that the tokenizer library, of an older Unicode, takes for neither."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    out: dict[int, int] = {}
    for kind in (r"\p{L}", r"\p{N}"):
        theirs = bytes(tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        out |= dict.fromkeys(set(map(ord, regex.findall(kind, every))) - set(map(ord, theirs)), 0xE000)
    return out


def split(text: str, pattern: str = public_tokenizers.PATTERN) -> list[str]:
    """The matches of the pattern, as the tokenizer library finds them."""
    found = regex.compile(pattern)
    if text.isascii() or SETTLED.fullmatch(text):
        return found.findall(text)
    return [text[m.start() : m.end()] for m in found.finditer(text.translate(_unknown_to_library()))]


@lru_cache(2)
def _pieces(path: str) -> Memo:
    """Encodings of pieces, as bytes of 32-bit ids."""
    bpe = load(path)
    return Memo(lambda piece: np.array(bpe.piece(piece.encode()), np.int32).tobytes(), CACHE)


def encode_text(text: str, path: str, pattern: str = public_tokenizers.PATTERN) -> np.ndarray:
    return np.frombuffer(b"".join(map(_pieces(path).__getitem__, split(text, pattern))), np.int32)


def _list_array(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """`docs` with an array<int> column `out`, without special tokens. `path` must hold the ranks on every machine."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(column: pa.Array) -> pa.Array:
        return _list_array([encode_text(t, path, pattern) for t in texts(column)])

    return put(docs, out, F.arrow_udf(run, T.ArrayType(T.IntegerType())).asNondeterministic()(F.col(text)))


def decode(ids: Column, path: str | None = None) -> Column:
    """The bytes that an array<int> column stands for; null stays null."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(column: pa.Array) -> pa.Array:
        bpe = load(path)
        return pa.array([bpe.decode(x.values.to_numpy()) if x.is_valid else None for x in column], pa.binary())

    return F.arrow_udf(run, T.BinaryType()).asNondeterministic()(ids)


ROUND_TRIP = struct(ids=T.ArrayType(T.IntegerType()), decoded=T.BinaryType())


def round_trip(docs: DataFrame, text: str = "text", out: str = "tokens", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """`encode`, then `decode` of those ids, in one Python worker: a struct column of `ids` and `decoded`."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(column: pa.Array) -> pa.Array:
        ids = [encode_text(t, path, pattern) for t in texts(column)]
        back = pa.array(map(load(path).decode, ids), pa.binary())
        return pa.StructArray.from_arrays([_list_array(ids), back], names=ROUND_TRIP.names)

    return put(docs, out, F.arrow_udf(run, ROUND_TRIP).asNondeterministic()(F.col(text)))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.size("tokens.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("tokens.decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op6_bpe": op6_bpe}
ORACLE_SQL: dict[str, str] = {}
