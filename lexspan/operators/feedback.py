"""Corrections by users: joined to the clauses they are about, and told as examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.functions.text import truncated

#: fixed values: the words of an example
HEADING = "\n## 历史人工修正参考（仅供参考，不代表最终判断）\n"
ACTIONS = {
    "agree": "✅ 用户同意该判断", "false_positive": "❌ 用户标记为误报", "level_down": "⬇️ 用户降低风险等级", "level_up": "⬆️ 用户提高风险等级", "missed_risk": "➕ 用户补充了新风险",
}
LABELS = {"preview": "- 条款预览: ", "risk": "- 原始判断: ", "action": "- 用户操作: ", "user_comment": "- 用户说明: ", "corrected_level": "- 修正后等级: ", "corrected_risk_name": "- 补充风险: "}


def with_clauses(feedback: DataFrame, risks: DataFrame, clauses: DataFrame) -> DataFrame:
    """feedback (doc_id, risk_idx, ...) with risk_name, risk_level, clause_title and clause_text.

    risks carry linked_clause and count from 1 in order of ord; feedback on a
    risk that there is not is left out, a risk without a clause has empty texts.
    Both joins are on doc_id and a number, so no document meets more than its
    own rows.
    """
    from pyspark.sql import Window

    told = risks.select(
        "doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).cast("long").alias("risk_idx"), F.col("name").alias("risk_name"), "risk_level", F.col("linked_clause").alias("clause_id")
    )
    texts = clauses.select("doc_id", "clause_id", F.col("title").alias("clause_title"), F.col("content").alias("clause_text"))
    rows = feedback.join(told, ["doc_id", "risk_idx"]).join(texts, ["doc_id", "clause_id"], "left").drop("clause_id")
    return rows.fillna("", ["clause_title", "clause_text"])


def few_shot(found: DataFrame, records: DataFrame) -> DataFrame:
    """(query_id, examples): the corrections found (query_id, ord, why, rank) as text.

    Those found by text stand best first, those by risk in order of ord. records
    hold ord, clause_text, risk_name, risk_level, user_action, user_comment,
    corrected_level and corrected_risk_name; an unknown action is told as it is.
    """
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    action = some("user_action")
    for name, words in ACTIONS.items():
        action = F.when(F.col("user_action") == name, F.lit(words)).otherwise(action)
    line = lambda c: F.when(some(c) != "", F.concat(F.lit(LABELS[c]), some(c)))
    body = F.concat_ws(
        "\n", F.concat(F.lit(LABELS["preview"]), truncated(some("clause_text"), 100, "…")), F.concat(F.lit(LABELS["risk"]), some("risk_name"), F.lit(" ["), some("risk_level"), F.lit("]")),
        F.concat(F.lit(LABELS["action"]), action), line("user_comment"), line("corrected_level"), line("corrected_risk_name"), F.lit(""),
    )
    place = F.when(F.col("why") == "text", F.col("rank")).otherwise(F.col("ord"))
    rows = records.withColumn("__body", body).select("ord", "__body").join(F.broadcast(found.select("query_id", "ord", "why", "rank")), "ord")
    rows = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("__body").alias("b")))).alias("x"))
    each = F.transform("x", lambda r, i: F.concat(F.lit("### 示例 "), (i + 1).cast("string"), F.lit("\n"), r["b"]))
    return rows.select("query_id", F.concat(F.lit(HEADING + "\n"), F.array_join(each, "\n")).alias("examples"))
