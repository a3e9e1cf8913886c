import random

from pyspark.sql import functions as F

from lexspan.operators import trees


def brute(nodes):
    """nodes (tree, ord, level, value): by walking up and down."""
    out = {}
    for tree in {t for t, *_ in nodes}:
        own = sorted(n[1:] for n in nodes if n[0] == tree)
        parents = []
        for i, (_, level, _) in enumerate(own):
            parents.append(next((j for j in range(i - 1, -1, -1) if own[j][1] < level), None))

        def inside(i, j, parents=parents):
            while i is not None and i != j:
                i = parents[i]
            return i == j

        for j, (o, _, _) in enumerate(own):
            below = [i for i in range(len(own)) if inside(i, j)]
            depth, k = 0, parents[j]
            while k is not None:
                depth, k = depth + 1, parents[k]
            out[tree, o] = (j + 1, max(below) + 1, depth, None if parents[j] is None else parents[j] + 1, len(below) - 1, sum(own[i][2] or 0 for i in below))
    return out


def test_random_trees(spark):
    rng = random.Random(4)
    nodes = [(t, o * 3, rng.randrange(5), rng.choice([None, 1, 2, 7])) for t in range(40) for o in range(rng.randrange(30))]
    nodes += [(100, o, 4 - o % 5, 1) for o in range(20)] + [(101, o, o % 5, 1) for o in range(20)]
    df = spark.createDataFrame(nodes, "doc_id long, ord int, level int, value int").withColumn("before", F.lit("clash"))
    rows = trees.numbered(df, "level", value="value", levels=5)
    got = {(r["doc_id"], r["ord"]): (r["pre"], r["last"], r["depth"], r["parent_pre"], r["n_descendants"], r["subtotal"]) for r in rows.collect()}
    assert got == brute(nodes)
    assert "Join" not in rows._jdf.queryExecution().toString()
    node = next((t, o) for (t, o), x in got.items() if x[4] > 3)
    below = trees.subtree(rows, F.lit(node[0]), F.lit(got[node][0])).collect()
    assert len(below) == got[node][4] + 1 and {r["doc_id"] for r in below} == {node[0]}


def test_odd_levels_and_no_nodes(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 9), (1, 3, 0)], "doc_id long, ord int, level int")
    assert [(r["depth"], r["n_descendants"], r["subtotal"]) for r in trees.numbered(df, "level", levels=3).orderBy("ord").collect()] == [(0, 0, 1)] * 3
    assert trees.numbered(df.limit(0), "level").isEmpty()
