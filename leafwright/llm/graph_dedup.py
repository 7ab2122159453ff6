"""Near-duplicate vectors: a navigable small-world graph per shard, every vector searched in every shard.

Equal vectors are one class with a count. Classes are dealt into shards by hash; the number of shards stays fixed
until a shard would outgrow `shard_rows` or SHARD_BYTES, so work grows with n log n below that and with the square of n
over a shard's rows beyond: every vector is a query to every shard. Each shard's graph is one stored row. Blocks of
queries stream past a graph: one task holds one graph and one block, and a graph travels once for SLICE_BLOCKS blocks.
Beams widen until a brute-force audit of some of the block's queries finds nothing missed; queries inside a dense group
are multiplied with the whole shard instead. Cosine is then verified in double precision on the given vectors. A task
returns link counts and a spanning forest of its links, never the links of a dense group; components joins the forests.

Defined results: vectors that are null, empty, zero or hold a null, NaN or infinite component link with nothing, and
vectors of different lengths never link; equal vectors link; a null vec_id counts as a vector but has itself as
component; repeated rows are equal vectors; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.llm.components import components
from leafwright.llm.hnsw import Graph
from leafwright.llm.runtime import dropped, stored

BLOCK, SLICE_BLOCKS = 2048, 32
SHARD_BYTES = 64 << 20
#: Bytes of a graph's vertex besides its vector.
LINK_BYTES = 400


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector takes part, with `vector` as doubles."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.withColumn("vector", v).where(F.coalesce(fine, F.lit(False)))


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _binary(rows: DataFrame) -> DataFrame:
    """rep, times, dim, data: each vector's doubles as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2)
            values = v.flatten().to_numpy(zero_copy_only=False)
            size = np.asarray(pa.compute.list_value_length(v))
            at = np.concatenate([[0], np.cumsum(size)])
            data = pa.array([values[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int32()), data], ["rep", "times", "dim", "data"])

    return rows.select("rep", "times", "vector").mapInArrow(run, "rep long, times long, dim int, data binary")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, shards: int = 8, shard_rows: int = 50_000, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("embedding"))
    fine = usable(rows).select("vec_id", "vector", F.xxhash64("vector").alias("f1"), F.xxhash64(F.lit(1), "vector").alias("f2"))
    ids = stored(fine.select("vec_id", "f1", "f2"))
    nobody = (1 << 63) - 1
    classes = stored(ids.groupBy("f1", "f2").agg(F.min(F.coalesce("vec_id", F.lit(nobody))).alias("rep"), F.count(F.lit(1)).alias("times")))
    heads = fine.join(classes.withColumnsRenamed({"f1": "g1", "f2": "g2"}), (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.coalesce("vec_id", F.lit(nobody)) == F.col("rep")))
    points = stored(_binary(heads.dropDuplicates(["rep", "f1", "f2"])))
    total, widest = points.agg(F.count(F.lit(1)), F.max("dim")).first()
    shards = max(shards, -(-total // max(1, min(shard_rows, SHARD_BYTES // (12 * (widest or 1) + LINK_BYTES)))))
    sharded = points.withColumn("shard", F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(shards)))

    def build(table: pa.Table) -> pa.Table:
        rep, data = table.column("rep").to_numpy(), table.column("data").to_pylist()
        order = np.argsort(rep)
        raw = _matrix([data[i] for i in order])
        graph = Graph(_unit(raw))
        value = (rep[order], table.column("times").to_numpy()[order], raw, graph)
        return pa.table({"shard": table.column("shard")[:1], "dim": table.column("dim")[:1], "graph": pa.array([pickle.dumps(value, protocol=5)], pa.binary())})

    graphs = stored(sharded.groupBy("shard", "dim").applyInArrow(build, "shard long, dim int, graph binary"))
    blocks = -(-total // BLOCK) or 1

    def block(table: pa.Table) -> pa.Table:
        value = (table.column("rep").to_numpy(), table.column("data").to_pylist())
        return pa.table({"dim": table.column("dim")[:1], "block": table.column("block")[:1], "queries": pa.array([pickle.dumps(value, protocol=5)], pa.binary())})

    queries = points.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(blocks))).groupBy("dim", "block").applyInArrow(block, "dim int, block long, queries binary")
    # a slice reads its graph, then its blocks; small inputs still give each core a slice
    slices = max(-(-blocks // SLICE_BLOCKS), min(blocks, -(-int(points.sparkSession.sparkContext.defaultParallelism) // shards)))
    asked = graphs.select("shard", "dim").join(queries, "dim").select("shard", "dim", F.pmod("block", F.lit(slices)).alias("slice"), F.lit(1).alias("kind"), F.col("queries").alias("data"))
    held = graphs.select("shard", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"), F.lit(0).alias("kind"), F.col("graph").alias("data"))
    stream = held.unionByName(asked).repartition(max(shards * slices, 1), "shard", "dim", "slice").sortWithinPartitions("shard", "dim", "slice", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for row in range(batch.num_rows):
                value = pickle.loads(batch.column("data")[row].as_buffer())
                if not batch.column("kind")[row].as_py():
                    shard = value
                    continue
                rep, times, raw, graph = shard
                mine, data = value
                count, a, b = _links(mine, _matrix(data), rep, times, raw, graph, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([mine, a])), pa.array(np.concatenate([count, np.zeros(len(a), np.int64)])), pa.array(np.concatenate([np.full(len(mine), -1), b])), pa.array(np.concatenate([np.zeros(len(mine), bool), np.ones(len(a), bool)]))], ["rep", "links", "other", "is_link"])

    found = stored(stream.select("kind", "data").mapInArrow(search, "rep long, links long, other long, is_link boolean"))
    dropped(points, graphs)
    links = found.where("not is_link").groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "lr")
    joined = components(found.where("is_link").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    of = ids.join(classes.withColumnsRenamed({"f1": "g1", "f2": "g2"}), (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2"))).select("vec_id", "rep", "times")
    of = of.join(links, F.col("rep") == F.col("lr"), "left").join(joined, F.col("rep") == F.col("id"), "left")
    of = stored(of.groupBy("vec_id").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("c")))
    dropped(ids, classes, found, joined)
    out = rows.select("vec_id").join(of.withColumnRenamed("vec_id", "v"), F.col("vec_id").eqNullSafe(F.col("v")), "left")
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce(F.when(F.col("c") < nobody, F.col("c")), "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The roots of some vertices, whose paths become one step long."""
    r = parent[at]
    while True:
        up = parent[r]
        if (up == r).all():
            parent[at] = r
            return r
        r = up


def _links(mine: np.ndarray, q: np.ndarray, rep: np.ndarray, times: np.ndarray, raw: np.ndarray, graph: Graph, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the number of linked vectors in the shard (itself not counted), and links that join up the same
    vertices as all of them: one from the query to each tree of the shard that it meets."""
    unit, other = _unit(q), _unit(raw)
    size, own = np.sqrt((raw * raw).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    count, a, b = np.zeros(len(mine), np.int64), [], []
    parent = np.arange(len(rep))
    step = max(32, min(512, (24 << 20) // max(len(rep), 1)))
    for lo in range(0, len(mine), step):
        u = unit[lo : lo + step]
        hits = graph.within(u.astype(np.float32), threshold - 1e-5)
        for i in np.flatnonzero(hits.any(axis=1)).tolist():
            near = np.flatnonzero(hits[i])
            cos = (raw[near] @ q[lo + i]) / (own[lo + i] * size[near])
            if not np.isfinite(cos).all():
                cos = other[near] @ u[i]
            near = near[(cos >= threshold) & (rep[near] != mine[lo + i])]
            if not len(near):
                continue
            count[lo + i] = times[near].sum()
            trees, first = np.unique(_roots(parent, near), return_index=True)
            parent[trees] = trees[0]
            a.append(np.full(len(trees), mine[lo + i]))
            b.append(rep[near[first]])
    none = [np.zeros(0, np.int64)]
    return count, np.concatenate(a or none), np.concatenate(b or none)


#: The same in SQL.
GRAPH_SQL = r"""
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings),
ok as (
  select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v
  where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach(a, b) as (
  select a, b from links
  union
  select r.a, l.b from reach r join links l on r.b = l.a),
comp as (select a, min(b) as m from reach group by a),
deg as (select a, count(*) as n from links group by a)
select vec_id, cast(coalesce(deg.n, 0) as bigint) as n_links, least(vec_id, coalesce(m, vec_id)) as component_id,
       vec_id <= coalesce(m, vec_id) as kept
from v left join comp on comp.a = vec_id left join deg on deg.a = vec_id
"""
