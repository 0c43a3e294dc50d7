"""The exact vector scan against the plain expression over all pairs; blocks, copies, ties, odd vectors and ids."""

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pytest
from conftest import CHECK
from parity import connect
from parity import same as same_as_sql
from pyspark.sql import functions as F

from tracelode.functions import numeric as N
from tracelode.operators import ranking as R
from tracelode.operators import vectors as V
from tracelode.plans import registry


def plain(vectors, queries, top_k):
    q = queries.select("item_id", N.unit_vector(F.col("embedding")).alias("qv")).where("qv is not null")
    d = vectors.select("vec_id", N.unit_vector(F.col("embedding")).alias("dv")).where("dv is not null")
    score = F.round(N.dot(F.col("qv"), F.col("dv")), 6).alias("score")
    return R.ranked(d.crossJoin(q).select("item_id", "vec_id", score), ["item_id"], [F.desc("score"), F.col("vec_id")], top_k)


def same(spark, rows, queries, top_k, kind="float", ids="long", **more):
    vectors = spark.createDataFrame(rows, f"vec_id {ids}, embedding array<{kind}>").repartition(3)
    asked = spark.createDataFrame(queries, f"item_id long, embedding array<{kind}>")
    got, want = R.dense_search(vectors, asked, top_k, **more), plain(vectors, asked, top_k)
    assert got.dtypes == want.dtypes
    got, want = (sorted(map(repr, x.collect())) for x in (got, want))
    assert got == want and want


def vector(r, n=8):
    return [r.gauss(0, 1) for _ in range(n)]


@pytest.mark.parametrize("more", [{}, {"bound": 60}])
def test_same_as_all_pairs(spark, monkeypatch, more):
    monkeypatch.setattr(V, "ROWS", 64)
    r = random.Random(1)
    rows = [(k, vector(r)) for k in range(700)]
    same(spark, rows, rows[::20], 5, **more)
    same(spark, rows[:3], rows[:2], 5, **more)


def test_copies_and_scores_that_round_alike(spark):
    r = random.Random(2)
    one, other = vector(r), vector(r)
    rows = [(k, one if k % 3 else [x * (1 + r.random() * 1e-6) for x in one]) for k in range(400)]
    rows += [(k, [x * 2 for x in one]) for k in range(400, 440)] + [(k, other) for k in range(440, 500)]
    r.shuffle(rows)
    same(spark, rows, [(0, one), (1, other), (2, vector(r)), (2, vector(r))], 7)


def test_odd_vectors_and_ids(spark):
    nan, inf, tiny = float("nan"), float("inf"), 5e-324
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0]), (8, [1.0, 2.0, 3.0]), (9, [-0.0, 1.0]), (None, [1.0, 1.0]), (10, [1.0, 1.0]), (10, [1.0, -1.0]), (-(2**63), [1.0, 1.0]), (11, [3e-162, 1e-162]), (12, [tiny, tiny]), (13, [1e-160, 1e-162])]
    asked = [(0, [1.0, 1.0]), (1, [0.0, 0.0]), (2, [1.0, -1.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [0.0, -1.0]), (None, [1.0, 1.0]), (6, [1e-162, 3e-162])]
    for k in (1, 4, 20):
        same(spark, rows, asked, k, "double")
    same(spark, [(None if k is None else f"id {k}", v) for k, v in rows], asked, 4, "double", "string")


def test_no_rows_and_no_queries(spark):
    rows = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    asked = rows.withColumnRenamed("vec_id", "item_id")
    assert R.dense_search(rows.where("false"), asked).count() == 0 and R.dense_search(rows, asked.where("false")).count() == 0
    assert [tuple(x) for x in R.dense_search(rows, asked).collect()] == [(1, 1, 1.0, 1)]


def test_rounding_is_sparks(spark):
    r = random.Random(3)
    xs = [k / 2e6 + e for k in range(-40, 40) for e in (0.0, 1e-17, -1e-17, 1e-13)] + [r.uniform(-1, 1) for _ in range(300)] + [round(r.uniform(-1, 1), 7) for _ in range(300)]
    got = V.micro(np.array(xs)) / 1e6
    want = [x.r for x in spark.createDataFrame([(x,) for x in xs], "x double").select(F.round("x", 6).alias("r")).collect()]
    assert got.tolist() == want
    assert float(Decimal("0.0000005").quantize(Decimal("0.000001"), ROUND_HALF_UP)) == V.micro(np.array([5e-7]))[0] / 1e6


@pytest.mark.parametrize("name", ["dense_topk", "dense_first_relevant_rank"])
def test_no_join_pairs_rows_with_queries(spark, name):
    plan = registry.QUERIES[name](spark, CHECK)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join Inner\n" not in plan and "Join Cross" not in plan


def test_few_pairs_are_scored_one_by_one(monkeypatch):
    rng, folded, fold = np.random.default_rng(4), [], V.fold
    data = rng.normal(size=(20_000, 64)).astype(np.float32)
    column = pa.FixedSizeListArray.from_arrays(pa.array(data.ravel()), 64).cast(pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(20_000)), column], names=["vec_id", "embedding"])
    block = V.Block(pa.array(np.arange(0, 20_000, 40)), pa.array(column.take(pa.array(np.arange(0, 20_000, 40)))))
    monkeypatch.setattr(V, "fold", lambda x: (folded.append(len(x)), fold(x))[1])
    found = pa.Table.from_batches(block.search((batch.slice(k, 5000) for k in range(0, 20_000, 5000)), 10))
    assert found.num_rows == 5000 and sum(folded) - 20_000 < 0.01 * 500 * 20_000
    exact = block.groups[0][1] @ (data.astype(float) / np.linalg.norm(data.astype(float), axis=1)[:, None]).T
    assert sorted(zip(found["item_id"].to_pylist(), found["vec_id"].to_pylist(), strict=True)) == sorted((i * 40, j) for i in range(500) for j in np.argsort(-exact[i])[:10].tolist())


def test_scores_wait_to_be_ranked(monkeypatch):
    """Ranked once for each growth of the rows by half, not once for each product; rows in rising order let every score through."""
    rng, ranked, add = np.random.default_rng(5), [], V.Best.add
    data = rng.normal(size=(60_000, 8))
    exact = (data / np.linalg.norm(data, axis=1)[:, None]) @ (data[:40] / np.linalg.norm(data[:40], axis=1)[:, None]).T
    monkeypatch.setattr(V.Best, "add", lambda self, q, *x: (ranked.append(len(q)), add(self, q, *x))[1])
    for order, most, batch in ((np.arange(60_000), 20, 5000), (np.argsort(exact[:, 0]), 20, 7001)):
        ranked.clear()
        column = pa.FixedSizeListArray.from_arrays(pa.array(data[order].ravel()), 8).cast(pa.list_(pa.float64()))
        rows = pa.RecordBatch.from_arrays([pa.array(order), column], names=["vec_id", "embedding"])
        block = V.Block(pa.array(np.arange(40)), pa.array(data[:40].tolist()))
        found = pa.Table.from_batches(block.search((rows.slice(k, batch) for k in range(0, 60_000, batch)), 6))
        assert len(ranked) <= most and max(ranked) < 2 * V.PAIRS
        want = {(q, j) for q in range(40) for j in np.lexsort((np.arange(60_000), -np.round(exact[:, q], 6)))[:6].tolist()}
        assert set(zip(found["item_id"].to_pylist(), found["vec_id"].to_pylist(), strict=True)) == want


def test_blocks_are_fetched_by_few_jobs(spark):
    r = random.Random(7)
    rows = spark.createDataFrame([(k, vector(r)) for k in range(700)], "vec_id long, embedding array<float>")
    asked = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "item_id")
    spark.sparkContext.setJobGroup("blocks", "")
    try:
        blocks = R.dense_search(rows, asked, 5, bound=20)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("blocks")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert blocks >= 14 and len(jobs) <= 2 + -(-blocks // 4)  # the first ones add up the sizes


def test_blocks_hold_unit_vectors():
    block = V.Block(pa.array([1, 2, 3]), pa.array([[3.0, 4.0], None, [1.0]]))
    assert [(q.tolist(), v.tolist()) for q, v in block.groups] == [([2], [[1.0]]), ([0], [[0.6, 0.8]])]


def test_first_relevant_rank_of_the_plain_search(spark):
    v = spark.read.parquet(f"{CHECK}/embeddings.parquet")
    top = plain(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("item_id"), "embedding"), 10).collect()
    label = {x.vec_id: x.label for x in v.collect()}
    want = dict.fromkeys(k for k in label if k % 20 == 0)
    for x in sorted(top, key=lambda x: -x["rank"]):
        if x.vec_id != x.item_id and label[x.vec_id] == label[x.item_id]:
            want[x.item_id] = x["rank"]
    assert {x.item_id: x.gold_rank for x in registry.QUERIES["dense_first_relevant_rank"](spark, CHECK).collect()} == want


def test_first_relevant_rank_of_odd_labels(spark, tmp_path):
    """A lone label and a null one have no gold; a label that most rows have does; copies tie."""
    r = random.Random(6)
    some = [vector(r, 64) for _ in range(12)]
    rows = [(k, some[k % 15] if k % 15 < 12 else vector(r, 64), {20: 7, 40: None, 60: 8, 61: 8, 100: 9, 399: 9}.get(k, 1)) for k in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("part-*")).rename(tmp_path / "embeddings.parquet")
    for name in ("dense_topk", "dense_first_relevant_rank"):
        same_as_sql(registry.QUERIES[name](spark, str(tmp_path)), connect(tmp_path), registry.ORACLE_SQL[name])
    got = {x.item_id for x in registry.QUERIES["dense_first_relevant_rank"](spark, str(tmp_path)).collect()}
    assert got == set(range(0, 400, 20)) - {20, 40}
