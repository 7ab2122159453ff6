"""Nearest neighbours by score-aware quantisation.

Euclidean search is inner-product search over (x, -|x|^2 / 2) with queries (q, 1). The vector part is cut into pairs of
dimensions, each with 16 centroids. Training and encoding minimise the score-aware loss: of the residual x - x~, the
part parallel to x counts `parallel` times as much as the rest, because it is what moves high scores. Codes are chosen
by coordinate descent (the parallel part ties all pairs together), centroids by the normal equations of that loss.

Two four-bit codes make one byte; a query's tables of 16 x 16 sums are scanned over those bytes. The best `rerank` of a
shard are measured exactly, in double precision on the given vectors. With r the residual of a vector's code x~, no
vector is nearer than |q - x~| - |r|; all whose bound is within the k-th distance measured are measured too, as many as
they are, so each shard returns its own nearest k exactly. Equal vectors are one class that is measured once; of its
ids the smallest k + 1 are kept, which is all that k neighbours other than the query can need.

The quantiser learns from at most `sample_rows` rows (and SAMPLE_BYTES of them); every row is encoded, and every query
scans the codes of every shard. The number of shards follows the vectors: a shard has at most `shard_rows` of them and
SHARD_BYTES. Query blocks stream past shards: one task holds one shard and one block, and a shard travels once for
SLICE_BLOCKS blocks.

Defined results: vectors that are null, empty, zero or hold a null, NaN or infinite component take no part, as
candidates or queries; a query's candidates are the vectors of its own length but not itself (by vec_id); ties go to
the smaller vec_id; fewer candidates than k give fewer rows; a null vec_id takes no part; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.llm.graph_dedup import _binary, _matrix, usable
from leafwright.llm.runtime import dropped, stored

CENTROIDS = 16
SHARD_BYTES, SAMPLE_BYTES = 32 << 20, 64 << 20
#: Queries of a block, and blocks that one copy of a shard serves.
BLOCK, SLICE_BLOCKS = 256, 32


class Quantiser:
    """Product quantiser over pairs of dimensions, trained and applied under the score-aware loss."""

    def __init__(self, sample: np.ndarray, threshold: float = 0.2, rounds: int = 6, seed: int = 5):
        d = sample.shape[1]
        self.dim, self.pairs = d, -(-d // 4) * 2
        #: how much more a parallel error costs, for scores above `threshold` of the largest
        self.parallel = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        x = self._cut(sample)
        rng = np.random.default_rng(seed)
        pick = rng.choice(len(x), CENTROIDS, replace=len(x) < CENTROIDS)
        self.centroids = x[pick].transpose(1, 0, 2).copy()  # pairs x 16 x 2
        for _ in range(rounds):
            codes = self._codes(x)
            self._refit(x, codes)

    def _cut(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, 2 * self.pairs - self.dim))).reshape(len(x), self.pairs, 2)

    def _direction(self, x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(axis=(1, 2), keepdims=True)), 1e-300)

    def _codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        u, more = self._direction(x), self.parallel - 1
        plain = ((x[:, :, None, :] - self.centroids) ** 2).sum(axis=3)  # rows x pairs x 16
        along = ((x[:, :, None, :] - self.centroids) * u[:, :, None, :]).sum(axis=3)
        codes = plain.argmin(axis=2)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
        for _ in range(sweeps):
            for m in range(self.pairs):
                rest = total - along[rows, m, codes[:, m]]
                codes[:, m] = (plain[:, m] + more * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
                total = rest + along[rows, m, codes[:, m]]
        return codes

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        u, more = self._direction(x), self.parallel - 1
        for m in range(self.pairs):
            chosen = self.centroids[np.arange(self.pairs), codes]
            along = ((x - chosen) * u).sum(axis=2)
            rest = along.sum(axis=1) - along[:, m]
            for c in range(CENTROIDS):
                mine = codes[:, m] == c
                if mine.any():
                    v, w = x[mine, m], u[mine, m]
                    a = np.eye(2) * len(v) + more * (w.T @ w)
                    b = v.sum(axis=0) + more * (w * (rest[mine] + (v * w).sum(axis=1))[:, None]).sum(axis=0)
                    self.centroids[m, c] = np.linalg.solve(a, b)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """One byte for two pairs of dimensions."""
        out = []
        for lo in range(0, len(x), 2048):
            codes = self._codes(self._cut(x[lo : lo + 2048]))
            out.append((codes[:, ::2] * CENTROIDS + codes[:, 1::2]).astype(np.uint8))
        return np.concatenate(out)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that the bytes stand for, cut into pairs."""
        both = np.stack([codes // CENTROIDS, codes % CENTROIDS], axis=2).reshape(len(codes), self.pairs)
        return self.centroids[np.arange(self.pairs), both]

    def bounds(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row's code: the squared length, and its distance from the row."""
        square, off = np.empty(len(x)), np.empty(len(x))
        for lo in range(0, len(x), 2048):
            back = self.decode(codes[lo : lo + 2048])
            square[lo : lo + 2048] = (back * back).sum(axis=(1, 2))
            off[lo : lo + 2048] = np.sqrt(((self._cut(x[lo : lo + 2048]) - back) ** 2).sum(axis=(1, 2)))
        return square, off

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x bytes x 256 partial inner products."""
        t = np.einsum("qmd,mcd->qmc", self._cut(q), self.centroids)
        return (t[:, ::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), self.pairs // 2, 256).astype(np.float32)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of x to q, summed in the order of the dimensions."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += (x[:, k] - q[k]) ** 2
    return np.sqrt(total)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, rerank: int = 40, shard_rows: int = 8_192, sample_rows: int = 8_000, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on vec_id."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("embedding")).where("vec_id is not null")
    points = stored(_binary(usable(rows).select(F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("times"), "vector")))
    copies = points.groupBy("dim", "data", "rep").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times"))
    first = copies.withColumn("nth", F.row_number().over(Window.partitionBy("dim", "data").orderBy("rep"))).where(F.col("nth") <= k + 1)
    members = first.groupBy("dim", "data").agg(F.sort_array(F.collect_list(F.struct("rep", "times"))).alias("m"))
    ids = F.flatten(F.transform("m", lambda x: F.array_repeat(x["rep"], x["times"])))
    classes = stored(members.select(ids.alias("ids"), F.col("m")[0]["rep"].alias("rep"), "dim", "data"))
    total, widest = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    row_bytes = 8 * (widest or 1)
    shards = max(1, -(-total // max(1, min(shard_rows, SHARD_BYTES // row_bytes))))
    learn = classes.orderBy(F.xxhash64("rep"), "rep").limit(max(CENTROIDS, min(sample_rows, SAMPLE_BYTES // row_bytes))).select("dim", "data").toPandas()
    quantisers = {int(d): Quantiser(_matrix(x["data"].tolist())) for d, x in learn.groupby("dim")}
    sent = points.sparkSession.sparkContext.broadcast(quantisers)

    def index(table: pa.Table) -> pa.Table:
        first, ids = table.column("rep").to_numpy(), table.column("ids").to_pylist()
        order = np.argsort(first, kind="stable")
        raw = _matrix(table.column("data").to_pylist())[order]
        ids = [np.asarray(ids[i], np.int64) for i in order]
        at = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        quantiser = sent.value.get(raw.shape[1])  # a length that the sample has not met is measured in full
        coded = None
        if quantiser is not None:
            codes = quantiser.encode(raw)
            coded = (codes, *quantiser.bounds(raw, codes))
        value = (np.concatenate(ids), at, raw, coded)
        return pa.table({"shard": table.column("shard")[:1], "dim": table.column("dim")[:1], "data": pa.array([pickle.dumps(value, protocol=5)], pa.binary())})

    def block(table: pa.Table) -> pa.Table:
        value = (table.column("rep").to_numpy(), table.column("data").to_pylist())
        return pa.table({"dim": table.column("dim")[:1], "block": table.column("block")[:1], "data": pa.array([pickle.dumps(value, protocol=5)], pa.binary())})

    indexed = stored(classes.withColumn("shard", F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(shards))).groupBy("shard", "dim").applyInArrow(index, "shard long, dim int, data binary"))
    wanted = points.withColumnRenamed("rep", key).where(is_query).withColumnRenamed(key, "rep")
    blocks = max(1, -(-wanted.count() // BLOCK))
    queries = wanted.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(blocks))).groupBy("dim", "block").applyInArrow(block, "dim int, block long, data binary")
    slices = -(-blocks // SLICE_BLOCKS)
    asked = indexed.select("shard", "dim").join(queries, "dim").select("shard", "dim", F.pmod("block", F.lit(slices)).alias("slice"), F.lit(1).alias("kind"), "data")
    held = indexed.select("shard", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"), F.lit(0).alias("kind"), "data")
    stream = held.unionByName(asked).repartition(shards * slices, "shard", "dim", "slice").sortWithinPartitions("shard", "dim", "slice", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for row in range(batch.num_rows):
                value = pickle.loads(batch.column("data")[row].as_buffer())
                if not batch.column("kind")[row].as_py():
                    shard = value
                    continue
                out = list(zip(*_scan(value[0], _matrix(value[1]), *shard, sent.value.get(shard[2].shape[1]), k, rerank), strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    found = stream.select("kind", "data").mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    out = stored(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    dropped(points, classes, indexed)
    return out


def _scan(who: np.ndarray, q: np.ndarray, ids: np.ndarray, at: np.ndarray, raw: np.ndarray, coded: tuple | None, quantiser: Quantiser | None, k: int, rerank: int) -> list[tuple[int, int, float]]:
    """Row n of raw is the vector of ids[at[n] : at[n + 1]]."""
    out = []
    half = (raw * raw).sum(axis=1) / 2
    for lo in range(0, len(who), 32):
        part = q[lo : lo + 32]
        near = [np.arange(len(raw))] * len(part)
        if quantiser is not None:
            best, least = _bounded(part, half, *coded, quantiser, min(rerank, len(raw) - 1))
            for i in range(len(part)):
                top = _first(int(who[lo + i]), best[i], distances(raw[best[i]], part[i]), ids, at, k)[1]
                most = top[-1] * (1 + 1e-9) if len(top) == k else np.inf
                near[i] = np.union1d(best[i], np.flatnonzero(~(least[i] > most)))  # what is no number is measured
        for i in range(len(part)):
            found, score = _first(int(who[lo + i]), near[i], distances(raw[near[i]], part[i]), ids, at, k)
            out += [(int(who[lo + i]), int(x), float(y)) for x, y in zip(found, score, strict=True)]
    return out


def _bounded(q: np.ndarray, half: np.ndarray, codes: np.ndarray, square: np.ndarray, off: np.ndarray, quantiser: Quantiser, rerank: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows with the best approximate scores, and for every row what its distance is at least."""
    tables = quantiser.tables(q)
    inner = np.zeros((len(q), len(codes)), np.float32)
    with np.errstate(invalid="ignore", over="ignore"):
        for byte, table in enumerate(tables.transpose(1, 0, 2)):
            inner += table[:, codes[:, byte]]
        best = np.argpartition(half[None] - inner, rerank, axis=1)[:, : rerank + 1]
        size = (q * q).sum(axis=1)[:, None] + square[None]
        # rounding of the single-precision sums, and of the double-precision ones
        slack = (tables.shape[1] + 1) * 2.0**-22 * np.abs(tables).max(axis=2).sum(axis=1, dtype=np.float64)
        least = np.sqrt(np.maximum(size - 2 * inner.astype(np.float64) - slack[:, None] - 1e-12 * size, 0)) - off * (1 + 1e-9)
    return best, least


def _first(me: int, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest k ids other than me among the ids of some rows, and their distances."""
    size = at[rows + 1] - at[rows]
    place = np.arange(size.sum()) + np.repeat(at[rows] - np.cumsum(size) + size, size)
    found, score = ids[place], np.repeat(score, size)
    other = found != me
    found, score = found[other], score[other]
    order = np.lexsort((found, score))[:k]
    return found[order], score[order]


NEAREST_SQL = r"""
with v as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null),
ok as (
  select vec_id, e from v where e is not null and len(e) > 0
    and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
pairs as (
  select q.vec_id as query_id, c.vec_id,
         sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (c.e[i] - q.e[i]) * (c.e[i] - q.e[i])))) as score
  from ok q join ok c on c.vec_id <> q.vec_id and len(c.e) = len(q.e) where q.vec_id % 100 = 0)
select query_id, cast(row_number() over (partition by query_id order by score, vec_id) as integer) as rank, vec_id, score
from pairs qualify rank <= 10
"""
