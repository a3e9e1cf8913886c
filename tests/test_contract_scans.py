"""Dates and amounts are found in one reading of a text, without a shuffle and without work in the square of its length."""

import random
import time

from pyspark.sql import functions as F

from lexspan import catalogue_contracts
from lexspan.operators import entities

SF = "/root/testdata/sf0.01"


def steps(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(name)


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_dates_of_odd_texts(spark):
    texts = ["12024-1-1", "2024-1-2024年1月1日", "自合\r同签订之日起30日内", "二〇二四年十五月一日 二〇二四年十月十一日", "2024/2/30，2024/2/30", "2024 \n 年3月4日", None, "", "😀自x起生效，2024.5.6"]
    got = sorted(((r["doc_id"], r["raw"], r["start_pos"], r["normalized"], r["role"]) for r in entities.date_mentions(docs(spark, texts)).collect()), key=str)
    assert got == [
        (0, "2024-1-1", 1, "2024-01-01", None), (1, "2024-1-20", 0, "2024-01-20", None), (1, "2024年1月1日", 7, "2024-01-01", None), (2, "自合\r同签订之日起30日内", 0, "relative:30日内", "签署日期"),
        (3, "二〇二四年十月十一日", 11, "2024-10-11", None), (4, "2024/2/30", 0, "2024-02-30", None), (5, "2024 \n 年3月4日", 0, "2024-03-04", None), (8, "2024.5.6", 7, "2024-05-06", "生效日期"),
    ]


def test_roles_come_from_the_text_around(spark):
    texts = ["签订日期" + "x" * 96 + "2024-1-2", "签订日期" + "x" * 97 + "2024-1-2", "2024-1-2" + "x" * 88 + "付款日期", "2024-1-2" + "x" * 89 + "付款日期", "2024-1-2付款日 签约日期", "自此\n起生效2024-1-2", "自此起生效2024-1-2"]
    assert {r["doc_id"]: r["role"] for r in entities.date_mentions(docs(spark, texts)).collect()} == {0: "签署日期", 1: None, 2: "付款日期", 3: "付款日期", 4: "签署日期", 5: None, 6: "生效日期"}


def test_many_dates_of_one_text(spark):
    n = 60_000
    began = time.time()
    assert entities.date_mentions(docs(spark, ["".join(f"付款期限自签订之日起{i}日内。" for i in range(n))])).where("role = '签署日期'").count() == n
    assert time.time() - began < 30


def test_contract_dates_are_not_written_before(spark):
    df = catalogue_contracts.q_contract_dates(spark, SF)
    assert steps(df, "MapInArrow") == 1 and steps(df, "regexp_extract_all") == 0
    assert all("contracts" not in f for f in df.inputFiles())


def test_numbers_as_in_columns(spark):
    r = random.Random(3)
    days = ["".join(r.choice("零一二三四五六七八九十") for _ in range(r.randrange(1, 5))) for _ in range(500)]
    for t, a, b in spark.createDataFrame([(t,) for t in days], "t string").select("t", entities.small_number(F.col("t")), entities.small_number(F.col("t"), False)).collect():
        assert (entities.small_value(t), entities.small_value(t, False)) == (a, b), t


def test_capitals_as_in_columns(spark):
    r = random.Random(4)
    sums = ["".join(r.choice("零壹贰叁肆伍陆柒捌玖拾佰仟万亿元") for _ in range(r.randrange(1, 14))) for _ in range(500)]
    for t, a in spark.createDataFrame([(t,) for t in sums], "t string").select("t", entities.capital_number(F.col("t"))).collect():
        assert entities.capital_value(t) == a, t


def test_amounts_of_odd_texts(spark):
    texts = ["合同金额为 5万，总金额:￥6", "12,345.6元，.5元", "人民币 \n 3元", "壹元整贰元", "零元 0元 ￥0", "借款 \n￥7亿圆", "RMB人民币8元 $9", None, ""]
    got = sorted((r["doc_id"], r["raw"], r["value"]) for r in entities.amounts(docs(spark, texts)).collect())
    assert got == [
        (0, "合同金额为 5万", 5e4), (0, "总金额:￥6", 6.0), (0, "￥6", 6.0), (1, "12,345.6元", 12345.6), (1, "5元", 5.0), (2, "3元", 3.0), (2, "人民币 \n 3元", 3.0), (3, "壹元整", 1.0), (3, "贰元", 2.0),
        (5, "7亿圆", 7e8), (5, "借款 \n￥7亿圆", 7e8), (5, "￥7亿", 7e8), (6, "$9", 9.0), (6, "8元", 8.0), (6, "人民币8元", 8.0),
    ]


def test_long_numbers_that_are_no_amounts(spark):
    """A number of n digits without 元 behind it is not tried from each digit to each."""
    texts = ["9" * 20_000 + " 5元", "零" * 20_000 + " 陆元"]
    began = time.time()
    assert sorted((r["doc_id"], r["raw"], r["value"]) for r in entities.amounts(docs(spark, texts)).collect()) == [(0, "5元", 5.0), (1, "陆元", 6.0)]
    assert time.time() - began < 30


def test_contract_amounts_are_added_up_where_they_are_found(spark):
    df = catalogue_contracts.q_contract_amounts(spark, SF)
    assert steps(df, "MapInArrow") == 1 and steps(df, "Aggregate") == 0
    assert all("contracts" not in f for f in df.inputFiles())
