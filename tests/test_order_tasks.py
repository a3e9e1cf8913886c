import random

from pyspark.sql import functions as F

from lexspan import catalogue_orders, tables
from lexspan.operators import pages, rules
from tests.test_operators import folded

SF = "/root/testdata/sf0.01"


def steps(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(name)


def test_lines_of_orders_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    want = sorted(catalogue_orders._lines(spark, SF).collect())
    monkeypatch.setattr(tables, "SORTED", 1000)
    lines = catalogue_orders._lines(spark, SF)
    sizes = [r["count"] for r in lines.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) < 2000
    assert sorted(lines.collect()) == want
    assert steps(catalogue_orders.q_order_dedup(spark, SF), "Exchange") == 1


def test_findings_of_a_rule_are_sorted_once(spark):
    r = random.Random(4)
    rows = [(r.randrange(40), n, r.choice(["R1", "R2", "", None]), r.choice(["low", "medium", "high", "critical", "odd", None])) for n in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, ord long, rule_id string, risk_level string")
    best = rules.deduplicated(df)
    rank = {"low": 1, "medium": 2, "high": 3, "critical": 4}
    groups = {}
    for doc, n, rule, level in rows:
        if rule:
            groups.setdefault((doc, rule), []).append((-rank.get(level, 0), n, level))
    want = sorted((doc, rule, min(n for _, n, _ in g), min(g)[1], min(g)[2]) for (doc, rule), g in groups.items())
    assert sorted(tuple(x) for x in best.select("doc_id", "rule_id", "place", "ord", "risk_level").collect()) == want
    assert steps(best, "Sort [") == 1


def test_pages_are_joined_in_one_order_of_their_blocks(spark):
    """Pages of long documents, with ids of blocks that repeat on a page."""
    r = random.Random(5)
    rows = []
    for doc, size in enumerate([9000, 2500, *[r.randrange(1, 9) for _ in range(300)]]):
        for p in range(size):
            for o in range(r.choice([1, 1, 1, 2, 3])):
                rows.append((doc, p, o, r.choice("ab"), r.choice(["text"] * 6 + ["title", "table"]), r.choice(["cut ", "cut ", f" more {p}", "ends.", "第二条 x", "", None])))
    df = spark.createDataFrame(rows, "doc_id long, page_index int, ord int, block_id string, block_type string, content string").repartition(4)
    joined = pages.joined_pages(df)
    assert joined.columns == df.columns
    assert steps(joined, "Join") == 0 and steps(joined, "Sort [") == 1
    got, want = {}, {}
    for x in joined.collect():
        got.setdefault(x.doc_id, []).append((x.block_id, x.content or ""))
    for doc, *block, text in rows:
        want.setdefault(doc, []).append((*block, text or ""))
    assert all(sorted(got[doc]) == folded(blocks) for doc, blocks in want.items()) and got.keys() == want.keys()
