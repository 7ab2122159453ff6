"""Vector operators against brute force, and the registry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwright.llm import ann, graph_dedup, queries
from leafwright.llm.components import components
from leafwright.llm.hnsw import Graph

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed: int = 1, n: int = 400, d: int = 16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[50:90] = x[50] + 0.05 * rng.normal(size=(40, d))
    x[100:103] = x[100]
    return x.astype(np.float32)


def rows(x):
    out = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))]
    nan, inf = float("nan"), float("inf")
    return out + [(1000, None, 0), (1001, [0.0] * x.shape[1], 0), (1002, [nan] + [1.0] * (x.shape[1] - 1), 0), (1100, [inf] * x.shape[1], 0), (1004, [], 0), (1005, [1.0, 2.0], 0), (1006, [1.0, 2.0], 0), (1200, [None, 1.0], 0)]


def test_components(spark):
    pairs = [(5, 1), (2, 3), (3, 9), (9, 9), (1, 7), (8, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {5: 1, 7: 1, 8: 1, 3: 2, 9: 2}


def test_near_vectors(spark):
    x = vectors()
    got = {r.vec_id: r for r in graph_dedup.near_duplicates(spark.createDataFrame(rows(x), SCHEMA)).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = y @ y.T >= 0.95
    label = np.arange(len(x))
    for _ in range(50):
        label = np.array([label[np.flatnonzero(r)].min() for r in near])
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum() - 1, label[i], label[i] == i)
    for i in (1000, 1001, 1002, 1100, 1004, 1200):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[1005].n_links, got[1006].component_id) == (1, 1005)
    assert graph_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_graph_finds_dense_groups():
    x = vectors(3, 3000, 32).astype(np.float64)
    x[200:700] = x[200] + 0.02 * np.random.default_rng(1).normal(size=(500, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = Graph(x)
    q = x[190:320].astype(np.float32)
    assert (graph.within(q, 0.95) == (q @ graph.v.T >= 0.95)).mean() > 0.9999


def test_nearest(spark):
    x = vectors(2, 2500)
    got = ann.nearest(spark.createDataFrame(rows(x), SCHEMA), F.col("vec_id") % 100 == 0, rerank=60, shard_rows=1250).toPandas()
    y, hit, n = x.astype(np.float64), 0, 0
    assert not set(got.query_id) & {1000, 1100, 1200} - set(range(2500))
    for i in range(0, 2500, 100):
        d = np.sqrt(((y - y[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        mine = got[got.query_id == i].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and np.allclose(mine.score, d[mine.vec_id], rtol=1e-12)
        hit += len(set(np.lexsort((np.arange(len(d)), d))[:10]) & set(mine.vec_id))
        n += 10
    assert hit / n >= 0.9
    few = spark.createDataFrame(rows(x[:4]), SCHEMA)
    assert ann.nearest(few, F.col("vec_id") == 0).count() == 3
    assert ann.nearest(few, F.col("vec_id") == 77).count() == 0
    assert ann.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0


def test_nearest_with_copies_is_exact(spark):
    """500 equal vectors and 800 near copies among 2,500, one id twice: the same as brute force."""
    x = vectors(4, 2500, 32)
    rng = np.random.default_rng(2)
    x[np.r_[700:1200]] = x[700]
    x[1300:2100] = x[1300] + (1e-3 * rng.normal(size=(800, 32))).astype(np.float32)
    data = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))] + [(701, [float(v) for v in x[701]], 0)]
    got = ann.nearest(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 100 == 0, shard_rows=1250).toPandas()
    y, who = np.vstack([x, x[701:702]]).astype(np.float64), np.array([r[0] for r in data])
    for i in range(0, 2500, 100):
        d = ann.distances(y, y[i])
        d[who == i] = np.inf
        mine = got[got.query_id == i].sort_values("rank")
        assert mine.vec_id.tolist() == who[np.lexsort((who, d))[:10]].tolist(), i


def test_score_aware_loss_lowers_parallel_error():
    x = np.random.default_rng(0).normal(size=(1500, 16))
    error = {}
    for threshold in (0.0, 0.6):
        q = ann.Quantiser(x, threshold)
        codes = q._codes(q._cut(x))
        back = q.centroids[np.arange(q.pairs), codes].reshape(len(x), -1)[:, :16]
        r = x - back
        error[threshold] = ((r * x).sum(axis=1) ** 2 / (x * x).sum(axis=1)).mean()
    assert error[0.6] < 0.7 * error[0.0]


def test_every_operator_is_registered():
    names = queries.queries()
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.toPandas(), docs.schema)
        before = after
    assert 0 < before.select("doc_id").distinct().count() <= docs.count()
    packed = corpus_pipeline.run(spark, sf).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


@pytest.mark.parametrize("name", ["op1_perspective_rotation", "op6_line_runs", "op8_score_aware", "op10_small_worlds"])
def test_same_as_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    for t in ("documents", "conversations", "embeddings"):
        duckdb.sql(f"create or replace view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    want = duckdb.sql(queries.oracle_sql()[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
