"""Maximum inner product search with score-aware, anisotropic quantisation.

A vector is its cell's centre plus a length times a direction, and directions are cut into subspaces of 16 centres each. Codes
and centres minimise a loss in which the error along the vector weighs more than the error across it, since that part moves
large inner products; the error that is left along the cell's centre, which all vectors of a cell share, is kept as a number. A query's tables, two four-bit codes to a byte, are summed over the codes of a shard; the best of every
shard are reranked with the original vectors in double precision.

Queries and vectors meet in tiles of bounded size, all queries against all vectors. The quantiser is fitted on about
`SAMPLE` vectors that hash low, twice as many at most; every vector is indexed.

Defined results: rows with a null id, and vectors that are null, zero, not of the sample's commonest length or hold null or
non-finite components, take no part; a query's own id is no candidate; rows of one id and vector count once; ties go to the
smaller id; with fewer candidates than asked for all are returned; empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, struct, table, written

SAMPLE = 8192
#: Inner products above this share of the norm matter; it fixes the weight of the parallel residual.
THRESHOLD = 0.2
SWEEPS = 3
ROUNDS = 4
CELLS = 64
#: Vectors of a shard, queries of a block, and what the tables hand on for reranking from each shard.
SHARD_ROWS = 16384
BLOCK_ROWS = 4096
SHORTLIST = 600


class AnisotropicQuantizer:
    """Cells, and centres of shape (subspaces, 16, width); an odd number of subspaces is filled up with zeros."""

    def __init__(self, dimension: int, width: int = 2):
        self.dimension, self.width = dimension, width
        self.parts = -(-dimension // width)
        self.parts += self.parts % 2
        self.weight = max(1.0, (dimension - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        self.cells = np.zeros((1, dimension))
        self.centres = np.zeros((self.parts, 16, width), np.float32)

    def _cut(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), self.parts * self.width), np.float32)
        padded[:, : self.dimension] = x
        return padded.reshape(len(x), self.parts, self.width)

    def _cell(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.cells.T - (self.cells**2).sum(1) / 2).argmax(1)

    def _split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, length and direction of what the cell leaves, and the vector's own direction."""
        cell = self._cell(x)
        rest = x - self.cells[cell]
        size = np.linalg.norm(rest, axis=1)
        return cell, size, rest / np.maximum(size, 1e-30)[:, None], x / np.linalg.norm(x, axis=1)[:, None]

    def _assign(self, rest: np.ndarray, along: np.ndarray) -> np.ndarray:
        """Nearest centres, then sweeps over the subspaces, each minimising the whole loss."""
        r, u = self._cut(rest), self._cut(along)
        distance = ((r[:, :, None, :] - self.centres[None]) ** 2).sum(-1)
        error = (r * u).sum(-1)[:, :, None] - np.einsum("nmw,mcw->nmc", u, self.centres)  # along the vector, by subspace and code
        codes = distance.argmin(-1)
        rows = np.arange(len(r))
        total = np.take_along_axis(error, codes[:, :, None], 2).sum((1, 2))
        for _ in range(SWEEPS):
            for m in range(self.parts):
                others = total - error[rows, m, codes[:, m]]
                codes[:, m] = (distance[:, m] + (self.weight - 1) * (others[:, None] + error[:, m]) ** 2).argmin(1)
                total = others + error[rows, m, codes[:, m]]
        return codes.astype(np.uint8)

    def fit(self, x: np.ndarray, seed: int = 1) -> AnisotropicQuantizer:
        rng = np.random.default_rng(seed)
        self.cells = x[rng.permutation(len(x))[:CELLS]].copy()
        for _ in range(ROUNDS):
            cell = self._cell(x)
            count = np.bincount(cell, minlength=len(self.cells))
            sums = np.zeros_like(self.cells)
            np.add.at(sums, cell, x)
            self.cells[count > 0] = sums[count > 0] / count[count > 0, None]
        _, _, rest, along = self._split(x)
        r, u = self._cut(rest), self._cut(along)
        self.centres = np.ascontiguousarray(r[rng.integers(0, len(x), 16)].transpose(1, 0, 2))
        size = self.parts * 16 * self.width
        for _ in range(ROUNDS):
            codes = self._assign(rest, along)
            # normal equations of the loss in all centres at once, with the sums of (I + (weight - 1) u u') r on the right
            pull = r + (self.weight - 1) * (r * u).sum((1, 2))[:, None, None] * u
            slot = (np.arange(self.parts) * 16 + codes) * self.width
            diagonal, right, gram = np.full(size, 1e-3), 1e-3 * self.centres.ravel().astype(np.float64), np.zeros((size, size))
            for at in range(0, len(x), 1024):
                v = np.zeros((len(x[at : at + 1024]), size), np.float32)
                for w in range(self.width):
                    here = slot[at : at + 1024] + w
                    np.put_along_axis(v, here, u[at : at + 1024, :, w], 1)
                    diagonal += np.bincount(here.ravel(), minlength=size)
                    right += np.bincount(here.ravel(), pull[at : at + 1024, :, w].ravel(), size)
                gram += v.T @ v
            gram *= self.weight - 1
            gram[np.arange(size), np.arange(size)] += diagonal
            self.centres = np.linalg.solve(gram, right).reshape(self.parts, 16, self.width).astype(np.float32)
        return self

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, two to a byte; cells; lengths; by what share of the cell's centre the code errs along it)."""
        cell, size, rest, along = self._split(vectors)
        codes = self._assign(rest, along)
        own = np.take_along_axis(self.centres[None], codes[:, :, None, None].astype(np.int64), 2).reshape(len(vectors), -1)[:, : self.dimension]
        centre = self.cells[cell]
        error = np.einsum("nd,nd->n", centre, (rest - own) * size[:, None]) / np.maximum(np.einsum("nd,nd->n", centre, centre), 1e-30)
        return codes[:, ::2] | codes[:, 1::2] << 4, cell.astype(np.int32), size.astype(np.float32), error.astype(np.float32)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For every pair of subspaces and query what each byte adds: (pairs, queries, 256)."""
        t = np.einsum("qmw,mcw->mqc", self._cut(queries), self.centres)
        return (t[1::2, :, :, None] + t[::2, :, None, :]).reshape(self.parts // 2, len(queries), 256)


def _best(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest, of equals the first."""
    if len(scores) <= n:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - n)[len(scores) - n]
    above = np.flatnonzero(scores > edge)
    return np.concatenate([above, np.flatnonzero(scores == edge)[: n - len(above)]])


def search_tile(quantizer: AnisotropicQuantizer, ids: np.ndarray, codes: np.ndarray, cells: np.ndarray, sizes: np.ndarray, shifts: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, top: int, shortlist: int = SHORTLIST):
    """(place of the query, id, score) of each query's best in one shard, whose rows are sorted by vector and id.

    Equal vectors are scanned once, and stand for as many of their least ids as can be asked for.
    """
    where, found, scores = [], [], []
    first = np.flatnonzero(np.append(True, (vectors[1:] != vectors[:-1]).any(1)))
    end = np.append(first[1:], len(ids))
    least = ids[first]
    by_id = np.argsort(least, kind="stable")  # so that of equal scores the smaller ids come first
    first, end = first[by_id], end[by_id]
    exact, cells, sizes, shifts, columns = vectors[first], cells[first], sizes[first], 1 + shifts[first], np.ascontiguousarray(codes[first].T)
    for at in range(0, len(queries), 64):
        part = queries[at : at + 64]
        near = np.zeros((len(part), len(first)), np.float32)
        for t, c in zip(quantizer.tables(part.astype(np.float32)), columns, strict=True):
            near += np.take(t, c, axis=1)
        near *= sizes
        near += (part @ quantizer.cells.T).astype(np.float32)[:, cells] * shifts
        for i, q in enumerate(part):
            some = _best(near[i], shortlist)
            s = exact[some] @ q
            edge = np.partition(s, max(0, len(s) - top - 1))[max(0, len(s) - top - 1)]  # one more, as one may be the query itself
            some, s = some[s >= edge], s[s >= edge]
            size = np.minimum(end[some] - first[some], top + 1)
            rows = np.repeat(first[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            s = np.repeat(s, size)[ids[rows] != query_ids[at + i]]
            hits = ids[rows][ids[rows] != query_ids[at + i]]
            order = np.lexsort((hits, -s))[:top]
            where.append(np.full(len(order), at + i))
            found.append(hits[order])
            scores.append(s[order])
    return np.concatenate(where), np.concatenate(found), np.concatenate(scores)


INDEX = struct(vec_id=T.LongType(), codes=T.BinaryType(), cell=T.IntegerType(), size=T.FloatType(), shift=T.FloatType(), vector=T.BinaryType())


def _matrix(column, dtype) -> np.ndarray:
    """Binary values of one size as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 20, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of `queries` its `top` nearest of `vectors` by inner product."""

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(f"`{value}`").cast("array<double>")
        sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & sound)

    own = clean(vectors)
    sample = [r.v for r in hash_sample(own, own.count(), SAMPLE, "vec_id", "v").select("v").collect()]
    dimension = Counter(map(len, sample)).most_common(1)[0][0] if sample else 1
    fitted = np.array([v for v in sample if len(v) == dimension] or [[1.0]])
    quantizer = AnisotropicQuantizer(dimension).fit(fitted)

    def encode(batches):
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().reshape(-1, dimension)
            codes, cells, sizes, shifts = quantizer.encode(v)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cells), pa.array(sizes), pa.array(shifts), pa.array([x.tobytes() for x in v], pa.binary())], names=INDEX.names)

    index = written(own.where(F.size("v") == dimension).mapInArrow(encode, INDEX), "vectors")
    asked = clean(queries).where(F.size("v") == dimension).distinct()
    asked = written(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("query")), "queries")
    shards, blocks = max(1, -(-index.count() // SHARD_ROWS)), max(1, -(-asked.count() // BLOCK_ROWS))
    left = index.select("*", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.select("*", F.pmod(F.xxhash64("query_id", "query"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = right.withColumns({"shard": F.col("shard").cast("long"), "block": F.col("block").cast("int")})
    found = struct(query_id=T.LongType(), query_hash=T.LongType(), vec_id=T.LongType(), score=T.DoubleType())

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({f.name: pa.array([], pa.float64() if f.name == "score" else pa.int64()) for f in found})
        rows = sorted(set(zip(a["vector"].to_pylist(), a["vec_id"].to_pylist(), a["codes"].to_pylist(), a["cell"].to_pylist(), a["size"].to_pylist(), a["shift"].to_pylist(), strict=True)))
        vec, ids, codes, cells, sizes, shifts = zip(*rows, strict=True)
        asked_ids, hashes = b["query_id"].to_numpy(), b["query_hash"].to_numpy()
        q = b["query"].combine_chunks().flatten().to_numpy().reshape(b.num_rows, -1)
        where, hit, s = search_tile(quantizer, np.array(ids), _matrix(pa.array(codes), np.uint8), np.array(cells), np.array(sizes, np.float32), np.array(shifts, np.float32), _matrix(pa.array(vec), np.float64), asked_ids, q, top)
        return pa.table({"query_id": pa.array(asked_ids[where]), "query_hash": pa.array(hashes[where]), "vec_id": pa.array(hit), "score": pa.array(s)})

    right = right.withColumn("query_hash", F.xxhash64("query"))
    best = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(tile, found)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


QUERIES = {"op8_nearest": op8_nearest}
ORACLE_SQL: dict[str, str] = {}
