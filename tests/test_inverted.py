import random
import time

import pytest
from pyspark.sql import functions as F

from lexspan.operators import inverted
from lexspan.tables import best, shared_folder, small_side

FIELDS = {"content": 20, "title": 15, "keywords": 40}


def brute(entries, queries, k):
    out = []
    for q, words in queries:
        scores = []
        for o, content, title, keywords in entries:
            own = [(set((content or "").split()), 20), (set((title or "").split()), 15), ({x.lower() for x in keywords or [] if x}, 40)]
            if s := sum(w for word in set(words) for field, w in own if word in field):
                scores.append((-s, o))
        out += [(q, o, -s, r) for r, (s, o) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 60}"  # noqa: E731, a few words in most entries
    entries = [(o, " ".join(word() for _ in range(rng.randrange(25))), " ".join(word() for _ in range(3)), [word().upper(), None]) for o in range(500)]
    entries += [(500, None, None, None), (501, "", "w1", [])]
    queries = [(q, [word() for _ in range(rng.randrange(1, 9))]) for q in range(30)] + [(90, []), (91, ["none"]), (92, ["w1", "w1", "w2"])]
    return entries, queries


@pytest.mark.parametrize("block,shard", [(256, 65_536), (8, 100)])
def test_search_is_exhaustive(spark, data, monkeypatch, block, shard):
    monkeypatch.setattr(inverted, "BLOCK", block)
    monkeypatch.setattr(inverted, "SHARD", shard)
    entries, queries = data
    df = spark.createDataFrame(entries, "ord long, content string, title string, keywords array<string>").withColumn("word", F.lit("clash"))
    index = inverted.build(df, shared_folder(spark, "index"), FIELDS)
    asked = spark.createDataFrame(queries, "query_id long, words array<string>")
    for k in (1, 10, 1000):
        assert sorted(map(tuple, inverted.search(index, asked, k).collect())) == brute(entries, queries, k)
    postings = index.table(spark, "postings")
    assert postings.agg(F.max(F.size("ords"))).first()[0] <= block
    assert postings.where("top <> array_max(impacts)").isEmpty()


def test_bounds_leave_entries_unread(spark, data, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 8)
    entries, queries = data
    df = spark.createDataFrame(entries, "ord long, content string, title string, keywords array<string>")
    index = inverted.build(df, shared_folder(spark, "index"), FIELDS)
    named = inverted.told(index, spark.createDataFrame(queries, "query_id long, words array<string>"), 5)
    every = inverted.holding(index, named.select(F.col("query_id").alias("term_id"), "word")).select("term_id", "ord").distinct().count()
    assert inverted.candidates(index, named).count() < every / 2
    plan = inverted.candidates(index, named)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_holding(spark, data):
    entries, _ = data
    df = spark.createDataFrame(entries, "ord long, content string, title string, keywords array<string>")
    index = inverted.build(df, shared_folder(spark, "index"), FIELDS)
    got = inverted.holding(index, spark.createDataFrame([(1, "w3"), (2, "none")], "term_id long, word string")).collect()
    assert sorted((r["term_id"], r["ord"], r["impact"]) for r in got) == [(1, o, s) for _, o, s, _ in sorted(brute(entries, [(1, ["w3"])], 1000), key=lambda x: x[1])]


def test_empty(spark):
    schema = "ord long, content string, title string, keywords array<string>"
    index = inverted.build(spark.createDataFrame([], schema), shared_folder(spark, "index"), FIELDS)
    assert inverted.search(index, spark.createDataFrame([(1, ["a"])], "query_id long, words array<string>"), 3).isEmpty()


def test_best_and_small_side(spark):
    df = spark.range(1000).selectExpr("id % 3 AS key", "id", "id % 7 AS score")
    got = sorted(map(tuple, best(df, ["key"], [F.desc("score"), "id"], 4, "id").select("key", "rank", "id").collect()))
    assert got == [(key, r, i) for key in range(3) for r, (_, i) in enumerate(sorted((-(i % 7), i) for i in range(key, 1000, 3))[:4], 1)]
    assert "Broadcast" in df.join(small_side(df, 1000), "id")._jdf.queryExecution().toString()
    assert "ResolvedHint" not in small_side(df, 999)._jdf.queryExecution().toString()


@pytest.mark.parametrize("pairs", [1, 20])
def test_queries_in_parts(spark, data, monkeypatch, pairs):
    monkeypatch.setattr(inverted, "PAIRS", pairs)
    monkeypatch.setattr(inverted, "SHARD", 100)
    entries, queries = data
    df = spark.createDataFrame(entries, "ord long, content string, title string, keywords array<string>")
    index = inverted.build(df, shared_folder(spark, "index"), FIELDS)
    assert sorted(map(tuple, inverted.search(index, spark.createDataFrame(queries, "query_id long, words array<string>"), 10).collect())) == brute(entries, queries, 10)


def test_a_text_of_one_line_takes_time_by_its_length(spark):
    line = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda i: F.concat(F.lit("w"), i)))
    df = spark.range(4).select(F.col("id").alias("ord"), line.alias("content"), line.alias("title"), F.array(F.lit("w7")).alias("keywords"))
    began = time.time()
    index = inverted.build(df, shared_folder(spark, "index"), FIELDS)
    got = inverted.search(index, spark.createDataFrame([(1, ["w7", "w300000", "w300001"])], "query_id long, words array<string>"), 2)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 110, 1), (1, 1, 110, 2)]
    assert time.time() - began < 60
