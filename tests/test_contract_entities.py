"""Signatures, definitions and amounts in capitals on texts of all forms."""

import random
import time

from pyspark.sql import functions as F

from lexspan import catalogue_contracts
from lexspan.operators import dialog, entities, segment
from lexspan.tables import in_order


def test_capitals_and_back(spark):
    rng = random.Random(1)
    numbers = [1, 9, 10, 11, 20, 100, 101, 110, 1001, 1010, 10_000, 10_001, 100_000, 101_000, 1_000_100, 100_000_000, 100_000_001, 120_030_004_005, 10**12 - 1]
    numbers += [rng.randrange(1, 10 ** rng.randrange(1, 13)) for _ in range(300)]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", entities.capitals(F.col("n")).alias("c"))
    for r in df.select("n", "c", entities.capital_number(F.concat("c", F.lit("元"))).alias("back")).collect():
        assert r["back"] == r["n"], r
    told = {r["n"]: r["c"] for r in df.collect()}
    assert (told[10_001], told[101_000], told[120_030_004_005]) == ("壹万零壹", "壹拾万零壹仟", "壹仟贰佰亿零叁仟万零肆仟零伍")
    odd = spark.createDataFrame([(0,), (-1,), (10**12,), (None,)], "n long").select(entities.capitals(F.col("n")))
    assert [r[0] for r in odd.collect()] == [None] * 4


def test_pairs_in_both_orders(spark):
    texts = ["1元（大写：壹元整）2元", "（壹佰元整）￥100", "(大写:人民币贰元)3", "5元 （大写伍元", "（拾）1", None]
    got = entities.amount_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["lower"], r["upper"], r["consistent"]) for r in got] == [(0, "1", "壹", True), (1, "100", "壹佰", True), (2, "3", "贰", False), (3, "5", "伍", True)]


def test_signatures(spark):
    texts = [
        "甲方：某公司\n\n\n\n甲方（盖章）", "甲方盖章 公章\n乙方\n签字\n丙方", "双方已签署", "nothing", None, "出租人：王\n承租方（签章）\n\n\n买方",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda df: sorted(((r["doc_id"], r["role"], r["has_signature"], r["has_seal"], r["line"], r["page"]) for r in df.collect()), key=str)
    text = [
        (0, "甲方", False, False, 0, None), (1, "甲方", True, True, 0, None), (1, "乙方", True, True, 1, None), (1, "丙方", True, False, 3, None), (2, "未知", True, False, None, None),
        (5, "出租", True, False, 0, None), (5, "承租", True, False, 1, None), (5, "买方", False, False, 4, None),
    ]
    assert found(entities.signatures(docs)) == sorted(text, key=str)
    blocks = [
        (0, 0, "甲方盖章", 800.0, 1000.0), (0, 0, "乙方签字", 800.0, 1000.0), (0, 1, "乙方签字盖章", 900.0, 1000.0), (3, 0, "丁方签字", 100.0, 1000.0), (3, 1, "丁方签字", 700.0, 1000.0), (3, 2, "丁方", 900.0, 0.0), (3, 3, "page 9", 900.0, 1000.0),
    ]
    pages = spark.createDataFrame(blocks, "doc_id long, page long, text string, top double, page_height double")
    assert found(entities.signatures(docs, pages)) == sorted([*text, (0, "乙方", True, True, None, 1), (3, "丁方", True, False, None, 1)], key=str)


def test_defined_terms(spark):
    texts = [
        "北京某某公司（以下简称“某某”）与上海公司(下称'乙公司')，下称“丙”",
        "前言指不算数的一句话。\n第一条 定义\n标的物指本合同所列的货物。服务是为了交付的工作；\n续行指仍在定义之内的话。\n第二条 价款\n价款指不再解释的一句话。",
        "标的物指没有那种条款时的话。", None, "",
    ]
    got = entities.defined_terms(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["form"], r["term"], r["definition"]) for r in got) == [
        (0, "named", "乙公司", "与上海公司"), (0, "named", "某某", "北京某某公司"), (0, "short", "丙", "丙"),
        (1, "means", "服务是", "了交付的工作"), (1, "means", "标的物", "本合同所列的货物"), (1, "means", "续行", "仍在定义之内的话"),
    ]


def test_numbers_in_order_and_the_oldest_half(spark):
    rows = [(i, None if i % 10 == 0 else (i * 37) % 101, i % 3 == 0) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, at long, done boolean").repartition(7)
    got = {r["id"]: r["n"] for r in in_order(df, [F.asc_nulls_first("at"), F.asc("id")]).collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted((-1 if at is None else at, i) for i, at, _ in rows), 1)}
    done = sorted((-1 if at is None else at, i) for i, at, d in rows if d)
    kept = {r["id"] for r in dialog.without_oldest_half(df, 60, F.col("done"), "at", "id").collect()}
    assert kept == {i for i, _, _ in rows} - {i for _, i in done[: len(done) // 2]}
    assert dialog.without_oldest_half(df, 100, F.col("done"), "at", "id").count() == 100


def test_equal_amounts_in_both_orders_and_forms(spark, tmp_path):
    docs = spark.createDataFrame([(1, "7元（大写：柒元整）\n（大写：柒元整）￥7元"), (2, "7元（大写：柒元整）7元（大写：柒元整）")], "doc_id long, text string")
    got = entities.amount_pairs(docs).collect()
    assert sorted((r["doc_id"], r["lower"], r["consistent"]) for r in got) == [(1, "7", True), (1, "7", True), (2, "7", True)]
    # an order whose total is the client's number and one: equal amounts of its contract are told apart
    for name, rows, schema in (
        ("orders", [(4, 6, "O", 7.5, "1995-01-02", "2-HIGH"), (3, 6, "O", 6.5, "1995-01-02", "2-HIGH")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"),
        ("customer", [(6, "c", "BUILDING", 1)], "c_custkey long, c_name string, c_mktsegment string, c_nationkey long"), ("nation", [(1, "FRANCE")], "n_nationkey long, n_name string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert {(r["doc_id"], r["n"], r["total"]) for r in catalogue_contracts.q_contract_amounts(spark, str(tmp_path)).collect()} == {(4, 6, 42.0), (3, 6, 41.0)}
    assert catalogue_contracts.q_contract_pairs(spark, str(tmp_path)).count() == 4


def test_long_texts_cost_their_lines_once(spark):
    """Lines and roles are worked out once: a text of many lines costs no square of them."""
    n = 4000
    text = "\n".join(["第一条 定义", *[f"货物{i}指合同所列的第{i}类货物。" for i in range(20)], *["甲方与乙方盖章之处"] * n, "第二条 价款", "价款指不再解释的一句话。"])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    assert {(r["role"], r["has_seal"], r["line"]) for r in entities.signatures(docs).collect()} == {("甲方", True, 21)}
    assert {r["term"] for r in entities.defined_terms(docs).collect()} == {f"货物{i}" for i in range(20)}
    assert time.time() - began < 30
    shown = segment.clauses(docs, positions=False).collect()
    assert [tuple(r) for r in shown] == [tuple(r) for r in segment.clauses(docs).select("doc_id", "clause_id", "title", "content").collect()]
