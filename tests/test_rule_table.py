import pytest
from pyspark.sql import functions as F

from lexspan import tables
from lexspan.catalogue_volume import large_pack
from lexspan.operators import rule_table, rules
from lexspan.plans.packs import BUYER, LATIN, NEUTRAL, Playbook, Rule


@pytest.fixture(scope="module")
def docs(spark):
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = [(100_001, None), (100_002, ""), (100_003, "短 文本é😀"), (100_004, "ab" * 40_000)]
    return some.unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("body", F.lit("clash")).cache()


def same(a, b):
    key = lambda df: sorted((*r[:6], round(r[6], 9)) for r in df.collect())
    assert key(a) == key(b)


ODD = [
    Rule("MISSING_9", "短、文本", "c", "high", ("contract",), "missing"),
    Rule("MISSING_8", "x", "c", "high", ("contract",), "missing", presence=("", "zz"), substance=("^$",)),
    Rule("COND_8", "x", "c", "low", ("contract",), "condition", risk=("é😀", "本", "本", ""), safe=("q",)),
    Rule("COND_7", "x", "c", "low", ("other",), "condition", risk=("a",)),
]


@pytest.mark.parametrize("doc_type,playbook", [("contract", NEUTRAL), ("contract", BUYER), ("privacy_policy", NEUTRAL), ("none", NEUTRAL), ("contract", Playbook("p", focus=("c",), levels={"MISSING_9": "low"}))])
def test_small_packs_as_compiled(spark, docs, doc_type, playbook):
    same(rule_table.findings(docs, LATIN + ODD, doc_type, playbook), rules.findings(docs, LATIN + ODD, doc_type, playbook))


@pytest.mark.parametrize("most", [tables.SMALL, 10])
def test_a_large_dictionary_is_not_told(docs, monkeypatch, most):
    monkeypatch.setattr(rule_table, "small_side", lambda df: tables.small_side(df, most))
    pack = large_pack(60)
    same(rule_table.findings(docs, pack), rules.findings(docs, pack))


def test_five_thousand_rules(docs):
    """Each block of the pack has the findings that it has alone, compiled."""
    pack = large_pack(5000)
    every = rule_table.findings(docs, pack)
    plan = every._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    every = every.cache()
    for first in (0, 2500, 4960):
        part = every.where(F.col("ord").between(first, first + 39)).withColumn("ord", F.col("ord") - first)
        same(part, rules.findings(docs, pack[first : first + 40]))


def test_a_told_dictionary_shuffles_no_text(docs):
    plan = rule_table.findings(docs, large_pack(60))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
