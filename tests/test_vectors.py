import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.operators import vectors
from lexspan.tables import shared_folder


def brute(rows, queries, k, least):
    out = set()
    for q, x in queries:
        far = sorted((round(float(((np.array(v, float) - np.array(x, float)) ** 2).sum()), 9), i) for i, v in rows)
        out |= {(q, i, r) for r, (d, i) in enumerate([(d, i) for d, i in far if 1 - d >= least][:k], 1)}
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 8)) * 0.4
    points = middles[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 0.1
    rows = [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]
    rows += [(1000 + i, rows[5][1]) for i in range(400)]  # one vector holds a third of all rows
    queries = [(i, v) for i, v in rows if i % 37 == 0] + [(5000, [9.0] * 8)]
    return rows, queries


@pytest.mark.parametrize("block,spread", [(1024, 65_536), (16, 40)])
def test_exact_search(spark, data, monkeypatch, block, spread):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "SPREAD", spread)
    rows, queries = data
    odd = [(None, [0.0] * 8), (7777, None)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("cell", F.lit("clash"))
    index = vectors.build(df, shared_folder(spark, "vectors"), cells=20, sample=300)
    asked = spark.createDataFrame(queries + [(6000, None), (6001, [1.0])], "query_id long, query array<float>")
    for k, least in ((10, 0.3), (3, 0.99), (100, 0.0)):
        got = vectors.search(index, asked, k, probes=2, least=least, exact=True).select("query_id", "vec_id", "rank").collect()
        assert {tuple(r) for r in got} == brute(rows, queries, k, least)
        assert len(got) == len(set(got))


def test_recall_of_probes(spark, data):
    rows, queries = data
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = vectors.build(df, shared_folder(spark, "vectors"), cells=20)
    got = {tuple(r) for r in vectors.search(index, spark.createDataFrame(queries, "query_id long, query array<float>"), 10, probes=4).select("query_id", "vec_id", "rank").collect()}
    want = brute(rows, queries, 10, 0.0)
    found = {(q, i) for q, i, _ in got}
    assert sum((q, i) in found for q, i, _ in want) >= 0.9 * len(want)


def test_recall_on_the_given_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = vectors.build(e, shared_folder(spark, "vectors"))
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    want = {(r["query_id"], r["vec_id"]) for r in vectors.search(index, asked, 10, exact=True).collect()}
    got = {(r["query_id"], r["vec_id"]) for r in vectors.search(index, asked, 10, probes=48).collect()}
    print(len(index.centres), len(want & got) / len(want))
    assert len(want & got) >= 0.9 * len(want)


def test_bounds(spark):
    schema = "vec_id long, embedding array<float>"
    index = vectors.build(spark.createDataFrame([], schema), shared_folder(spark, "vectors"))
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, query array<float>")
    assert vectors.search(index, asked, 3, exact=True).isEmpty()
    with pytest.raises(ValueError):
        vectors.search(index, asked, vectors.KEPT + 1)
