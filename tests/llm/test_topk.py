import numpy as np
import pytest
from pyspark.sql import functions as F

from meetpoint.llm import topk


def brute(rows, k, every):
    ints = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows]
    out = []
    for q, a in ints:
        if q % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ints if i != q and len(b) == len(a))
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [0.1, 1.0, 300.0, 2e5])
def test_equals_brute_force_with_ties(spark, monkeypatch, scale):
    rng = np.random.default_rng(int(scale))
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    vectors = (rng.normal(size=(150, 6)) * scale).astype(np.float32)
    vectors[50:100] = vectors[7]  # one vector holds a third of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(500, [1.0, 2.0]), (503, [3.0, -1.0]), (510, [9.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = sorted(map(tuple, topk.exact_top_k(df, F.col("vec_id") % 10 == 0, 5).collect()))
    assert got == brute(rows, 5, 10)


def test_odd_rows(spark):
    rows = [(0, [0.5, 0.25], "a"), (1, None, "b"), (2, [float("nan"), 1.0], "c"), (3, [None, 1.0], "d"), (None, [1.0, 1.0], "e"), (4, [1.0, 1.0], None), (4, [1.0, 1.0], "g"), (5, [float("inf"), 0.0], "h")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = topk.exact_top_k(df, F.col("vec_id") % 5 == 0)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 4, 49152), (0, 2, 4, 49152)]
    assert topk.exact_top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.exact_top_k(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_each_row_of_a_repeated_id_is_a_query_and_a_candidate(spark):
    rows = [(0, [1.0, 1.0]), (0, [0.5, 0.5]), (1, [1.0, 0.0]), (0, [1.0, 1.0])]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 50 == 0, 2)
    one = 65536
    want = [(0, 1, 0, 2 * one), (0, 2, 0, one)] * 2 + [(0, 1, 0, one), (0, 2, 0, one)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_copies_of_query_blocks_are_not_broadcast_and_data_is_narrow(spark):
    rows = [(0, [1e7]), (10, [-1e7]), (21, [3.0]), (22, [-130.0]), (23, [120.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.exact_top_k(df, F.col("vec_id") % 10 == 0, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [dim" in plan and "BroadcastHashJoin [dim" not in plan
    assert sorted(map(tuple, got.collect())) == brute(rows, 2, 10)
    sizes = {}
    for some in ([21, 23], [21, 22], [0]):
        few = topk.as_integers(df.where(F.col("vec_id").isin(some))).withColumn("row", F.col("vec_id")).coalesce(1)
        sizes[len(some), some[-1]] = sum(len(r.data) for r in topk.blocks(few, 10).collect())
    assert sizes == {(2, 23): 4, (2, 22): 8, (1, 0): 8}
