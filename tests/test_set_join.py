import random

import pytest
from pyspark.sql import functions as F

from lexspan.operators import set_join


def classes(rows, key):
    out = {}
    for i, s in rows:
        if s:
            out.setdefault(key(s), set()).add(i)
    return {i: min(ids) for ids in out.values() for i in ids}


def brute(left, right, least, measure):
    """All pairs of rows, as classes."""
    lefts, rights = ({i: frozenset(x for x in s or [] if x) for i, s in rows} for rows in (left, right))
    every = set().union(*lefts.values())
    l_of = classes(lefts.items(), lambda s: s)
    r_of = classes([(i, s) for i, s in rights.items() if s & every], lambda s: (s & every, len(s)))
    out = {}
    for a, x in lefts.items():
        for b, y in rights.items():
            common = len(x & y)
            if common and common / (len(x | y) if measure == "jaccard" else len(x)) >= least:
                pair = out.setdefault((l_of[a], r_of[b]), [set(), set(), common])
                pair[0].add(a)
                pair[1].add(b)
    return {(a, b, len(x), len(y), c) for (a, b), (x, y, c) in out.items()}


@pytest.mark.parametrize("measure,least", [("containment", 0.5), ("containment", 1.0), ("containment", 0.01), ("jaccard", 0.3), ("jaccard", 0.75)])
def test_against_all_pairs(spark, measure, least):
    rng = random.Random(2)
    gram = lambda: f"g{int(rng.paretovariate(0.6)) % 40}"
    left = [(i, [gram() for _ in range(rng.randrange(8))]) for i in range(60)] + [(100, None), (101, ["g1", None, "g1"])]
    right = [(i, [gram() for _ in range(rng.randrange(14))]) for i in range(150)] + [(200, None)]
    right += [(300 + i, ["g1", "g2", f"x{i % 2}"]) for i in range(80)]  # a third of the rows nearly alike
    frame = lambda rows: spark.createDataFrame(rows + rows[:3], "id long, grams array<string>").withColumn("n", F.lit("clash"))
    got = set_join.similar(frame(left), frame(right), least, measure)
    assert {tuple(r) for r in got.pairs.select("left", "right", "n_left", "n_right", "common").collect()} == brute(left, right, least, measure)
    assert len({r["id"] for r in got.right_of.collect()}) == got.right_of.count()


def test_plan_and_arguments(spark):
    df = spark.createDataFrame([(1, ["a"])], "id long, grams array<string>")
    plan = set_join.similar(df, df, 0.5, "jaccard").pairs._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for args in ((0.5, "cosine"), (0, "jaccard")):
        with pytest.raises(ValueError):
            set_join.similar(df, df, *args)
    assert set_join.similar(df.limit(0), df, 0.5).pairs.isEmpty() and set_join.similar(df, df.limit(0), 0.5).pairs.isEmpty()


def test_shingles(spark):
    df = spark.createDataFrame([("A b, a B a",), ("one",), ("",), (None,), (" .",)], "t string")
    assert [r[0] for r in df.select(set_join.shingles(F.col("t"), 2)).collect()] == [["a b", "b a"], ["one"], [], [], []]
