import random

import pytest
from pyspark.sql import functions as F

from lexspan.operators import retrieval


@pytest.mark.parametrize("vectors,asked", [(4096, 1024), (7, 3)])
def test_blocks_give_what_all_pairs_give(spark, monkeypatch, vectors, asked):
    monkeypatch.setattr(retrieval, "VECTORS", vectors)
    monkeypatch.setattr(retrieval, "ASKED", asked)
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.25, 0.5]) for _ in range(4)], i % 2) for i in range(120)] + [(200, None, 0), (201, [1.0, 2.0], 0), (None, [0.0] * 4, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    queries = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = retrieval.vector_search(queries, df, 5, keep=F.col("label") == 0)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    want = []
    for q, x, _ in rows[:120:10]:
        scores = sorted((-max(0.0, 1 - sum((a - b) ** 2 for a, b in zip(x, y))), i) for i, y, label in rows[:120] if label == 0)
        want += [(q, i, -s, r) for r, (s, i) in enumerate(scores[:5], 1) if -s >= 0.3]
    assert sorted(map(tuple, found.select("query_id", "vec_id", "score", "rank").collect())) == sorted(want)
    assert {r["query_id"] for r in retrieval.vector_search(queries, df, 5).where("query_id = 200").collect()} == set()


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert retrieval.vector_search(none.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), none, 3).isEmpty()
