"""Reports as text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.functions.text import escape_html
from lexspan.operators.rules import level_rank
from lexspan.plans.packs import LEVELS


def markdown(risks: DataFrame) -> DataFrame:
    """(doc_id, report): counts, then findings by level and order; an unknown level counts as medium."""
    line = F.concat(F.lit("- ["), F.col("risk_level"), F.lit("] "), F.col("name"), F.lit(" ("), F.col("category"), F.lit(")"))
    rows = risks.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct((-level_rank(F.col("risk_level"), 2)).alias("r"), "ord", line.alias("line")))).alias("x"),
        *[F.count_if(F.col("risk_level") == x).alias(x) for x in LEVELS],
    )
    head = F.concat_ws(", ", *[F.concat(F.lit(f"{x} "), F.col(x)) for x in LEVELS])
    return rows.select("doc_id", F.concat(F.lit("# Risks\n"), head, F.lit("\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("report"))


def html_rows(risks: DataFrame) -> DataFrame:
    cells = F.concat(*[x for c in ("risk_level", "name", "category") for x in (F.lit("<td>"), escape_html(F.col(c)), F.lit("</td>"))])
    return risks.select("doc_id", "ord", F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("html"))


#: fixed values: the words of the full report
LEVEL_ICONS = {"critical": "🟣", "high": "🔴", "medium": "🟡", "low": "🟢"}
LEVEL_NAMES = {"critical": "严重", "high": "高", "medium": "中", "low": "低"}
TYPE_NAMES = {"contract": "合同", "agreement": "协议", "privacy_policy": "隐私政策", "unknown": "法律文件"}
NO_RISKS = "\n\n✅ **未检测到明显风险**（仍需专业律师复核）"
NO_DETAILS = "\n\n未发现明显风险点。"
NO_SUGGESTIONS = "\n\n暂无额外建议。"
ADVICE = "\n\n> 💡 以上建议仅供参考，具体修改方案需结合业务实际情况并由专业律师确认。"
MASK_ADVICE = "\n\n> 💡 建议在上传前对敏感信息进行脱敏处理"
DISCLAIMER = (
    "⚠️ 免责声明：本工具生成的审查结果仅基于自动化分析，不构成正式法律意见。"
    "审查结果仅供参考，不能替代专业律师的法律意见。对于重要法律事务，"
    "建议咨询具有执业资格的律师进行复核。"
)
TIMELINESS = (
    "📅 知识库时效性声明\n\n本审查基于截至 {day} 的法律法规知识库。法律法规可能随时修订或废止，建议通过"
    "[国家法律法规数据库](https://flk.npc.gov.cn) 核实最新状态。\n\n⚠️ 本工具的法规知识库为预置静态数据，不保证实时性。"
    "对于重要法律事务，请务必核实引用的法条是否仍然有效。"
)
STATUS_NAMES = {"healthy": "健康", "needs_review": "需要复核", "critical": "存在过期数据"}


def named(c, names: dict[str, str], other):
    """The name of a value, other where it has none."""
    for value, name in names.items():
        other = F.when(c == value, F.lit(name)).otherwise(other)
    return other


def timeliness(at: str) -> str:
    """The statement on the age of the reference material, of the day of a time yyyy-MM-dd HH:mm:ss."""
    return TIMELINESS.format(day=f"{at[:4]}年{at[5:7]}月{at[8:10]}日")


def report_id(at: str) -> str:
    return "LR-" + "".join(c for c in at if c.isdigit())


def _detail(r, i, told: set[str]):
    """The section of a risk, the i-th from 0; texts that a risk does not state have no line."""

    def line(column: str, head: str, of=None, tail: str = ""):
        if column not in told:
            return F.lit("")
        value = of(r[column]) if of else r[column]
        return F.when(F.length(r[column]) > 0, F.concat(F.lit(f"\n- {head}"), value, F.lit(tail))).otherwise(F.lit(""))

    place = line("clause_title", "📍 **条款位置**: ")
    if {"clause_title", "clause_lines"} <= told:
        place = F.concat(place, F.when((F.length(r["clause_title"]) > 0) & (F.length(r["clause_lines"]) > 0), F.concat(F.lit("（"), r["clause_lines"], F.lit("）"))).otherwise(F.lit("")))
    return F.concat(
        F.lit("\n### "), named(r["risk_level"], LEVEL_ICONS, F.lit("⚪")), F.lit(" 风险 "), (i + 1).cast("string"), F.lit(": "), r["name"],
        F.lit("\n\n- **风险等级**: "), named(r["risk_level"], {k: f"{v}风险" for k, v in LEVEL_NAMES.items()}, F.lit("未知")),
        F.lit("\n- **风险类别**: "), r["category"], F.lit("\n- **风险描述**: "), r["description"],
        place, line("clause_preview", "**条款预览**: 「", lambda c: truncated(c, 100, "…"), "」"), line("legal_basis", "📖 **法律依据**: "),
        line("cited", "📚 **相关法条**: "), line("suggestion", "**修改建议**: "),
        F.lit("\n- **置信度**: "), F.bround(r["confidence"] * 100, 0).cast("int").cast("string"), F.lit("%"),
    )


_TEXTS = ("name", "category", "description", "clause_title", "clause_lines", "clause_preview", "legal_basis", "cited", "suggestion")


def _by_document(risks: DataFrame) -> DataFrame:
    """(doc_id, n, counts by level, x): a document's risks gathered in order of ord; a pack's rules bound their number."""
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in _TEXTS if c in risks.columns]
    more = [F.col(c) if c in risks.columns else F.lit(None).cast("string").alias(c) for c in ("rule_id", "clause_position")]
    row = F.struct((-level_rank(F.col("risk_level"), 2)).alias("r"), F.col("ord"), F.coalesce("risk_level", F.lit("")).alias("risk_level"), F.col("confidence"), *texts, *more)
    return risks.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("x"), F.count("*").alias("n"), *[F.count_if(F.col("risk_level") == x).alias(f"n_{x}") for x in LEVELS])


def full(docs: DataFrame, risks: DataFrame, items: DataFrame, at: str, freshness: str = "") -> DataFrame:
    """(doc_id, report): the whole review of each document as Markdown.

    docs hold doc_id, document_name, doc_type and security_warning, risks the
    findings with description, legal_basis and suggestion and, where known,
    clause_title, clause_lines, clause_preview and cited; items (doc_id, type,
    start_pos, masked_value) are told up to ten a document, under a warning only.
    Documents without risks have their report too. Every document's risks and
    items are gathered before the joins by doc_id.
    """
    told = {c for c in _TEXTS if c in risks.columns}
    listed = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "type", "masked_value"))).alias("__items"))
    rows = docs.join(_by_document(risks), "doc_id", "left").join(listed, "doc_id", "left")
    n, count = F.coalesce("n", F.lit(0)), lambda x: F.coalesce(f"n_{x}", F.lit(0)).cast("string")
    head = F.concat(
        F.lit(f"# 📋 法务审查报告\n\n| 项目 | 内容 |\n|------|------|\n| 报告编号 | {report_id(at)} |\n| 文件名称 | "), "document_name",
        F.lit(" |\n| 文件类型 | "), named(F.col("doc_type"), TYPE_NAMES, F.col("doc_type")), F.lit(f" |\n| 审查时间 | {at} |"),
    )
    item = F.transform(F.slice("__items", 1, 10), lambda x: F.concat(F.lit("\n| "), x["type"], F.lit(" | "), x["masked_value"], F.lit(" |")))
    table = F.when(F.col("__items").isNotNull(), F.concat(F.lit("\n\n### 检测到的敏感信息\n\n| 类型 | 原始值（已脱敏） |\n|------|-----------------|"), F.array_join(item, ""), F.lit(MASK_ADVICE))).otherwise(F.lit(""))
    security = F.when(F.length("security_warning") > 0, F.concat(F.lit("## 🔒 安全提示\n\n"), "security_warning", table))
    counts = [x for k, v in LEVEL_NAMES.items() for x in (F.lit(f"\n| {LEVEL_ICONS[k]} {v}风险 | "), count(k), F.lit(" |"))]
    overview = F.concat(F.lit("## 📊 风险概览\n\n| 风险等级 | 数量 |\n|----------|------|"), *counts, F.lit("\n| **合计** | **"), n.cast("string"), F.lit("** |"), F.when(n == 0, NO_RISKS).otherwise(""))
    details = F.concat(F.lit("## 📝 详细风险分析"), F.coalesce(F.concat(F.lit("\n"), F.array_join(F.transform("x", lambda r, i: _detail(r, i, told)), "\n")), F.lit(NO_DETAILS)))
    by_place = F.array_sort("x", lambda a, b: (a["ord"] - b["ord"]).cast("int"))
    advised = F.transform(
        F.filter(by_place, lambda r: F.length(r["suggestion"]) > 0), lambda r: F.concat(F.lit("- ["), named(r["risk_level"], LEVEL_NAMES, r["risk_level"]), F.lit("] "), r["name"], F.lit(": "), r["suggestion"])
    )
    advice = F.concat(F.lit("## 💡 合规建议"), F.when(F.size(advised) > 0, F.concat(F.lit("\n\n"), F.array_join(advised, "\n"), F.lit(ADVICE))).otherwise(F.lit(NO_SUGGESTIONS)))
    end = F.lit(f"---\n\n## ⚖️ 免责声明\n\n{DISCLAIMER}\n\n---\n\n{timeliness(at)}\n\n---\n*本报告由 AI 辅助生成，审查时间：{at}*")
    fresh = [F.lit(freshness)] if freshness else []
    return rows.select("doc_id", F.concat_ws("\n\n", head, security, overview, details, advice, *fresh, end).alias("report"))


def dictionary(docs: DataFrame, risks: DataFrame, at: str) -> DataFrame:
    """(doc_id, report): the review as a JSON object, its risks in order of ord.

    A risk's id is that of its rule; its clause_position, the title of the
    clause that it is about, is null where risks have no such column.
    """
    rows = docs.join(_by_document(risks), "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    summary = F.struct(*[zero(f"n_{x}").alias(x) for x in LEVELS], zero("n").alias("total"))
    by_place = F.array_sort("x", lambda a, b: (a["ord"] - b["ord"]).cast("int"))
    one = lambda r: F.struct(
        r["rule_id"].alias("id"), *[r[c].alias(c) for c in ("name", "category", "risk_level")], named(r["risk_level"], LEVEL_NAMES, F.lit("中")).alias("risk_level_cn"),
        *[r[c].alias(c) for c in ("description", "clause_position", "legal_basis", "suggestion", "confidence")],
    )
    listed = F.transform(by_place, one)
    body = F.struct(
        F.lit(report_id(at)).alias("report_id"), "document_name", F.col("doc_type").alias("document_type"), F.lit(at).alias("review_time"), summary.alias("risk_summary"),
        F.coalesce(listed, F.array().cast("array<struct<id:string,name:string,category:string,risk_level:string,risk_level_cn:string,description:string,clause_position:string,legal_basis:string,suggestion:string,confidence:double>>")).alias("risks"),
        "security_warning", F.lit(DISCLAIMER).alias("disclaimer"), F.lit(timeliness(at)).alias("timeliness_disclaimer"),
    )
    return rows.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def freshness_section(items: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row (section): the state of the reference material; empty where it is healthy without warnings.

    items (item_type, status) and warnings as dialog.freshness_warnings gives
    them; the first five critical ones are told, in order of ord. The material is
    a fixed, small set, its counts are one row each.
    """
    from lexspan.operators.dialog import freshness_status

    severe = F.array_sort(F.collect_list(F.when(F.col("severity") == "critical", F.struct("ord", "place", "name", "message"))))
    told = warnings.agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("bad"), F.count_if("old").alias("old"), severe.alias("x"))
    totals = items.agg(
        F.count_if(F.col("item_type") == "provision").alias("laws"), F.count_if((F.col("item_type") == "provision") & (F.col("status") == "active")).alias("active"),
        F.count_if(F.col("item_type") == "case").alias("cases"),
    )
    status = freshness_status(F.col("bad"), F.col("old"), F.col("laws") + F.col("cases"))
    first = F.transform(F.slice("x", 1, 5), lambda w: F.concat(F.lit("\n- **"), w["name"], F.lit("**: "), w["message"]))
    severe_text = F.when(F.col("bad") > 0, F.concat(F.lit("\n\n🔴 发现 "), F.col("bad").cast("string"), F.lit(" 条严重时效性警告:\n"), F.array_join(first, ""))).otherwise(F.lit(""))
    text = F.concat(
        F.lit("## 📅 知识库新鲜度报告\n知识库整体状态: **"), named(status, STATUS_NAMES, F.lit("未知")), F.lit("**\n法条总数: "), F.col("laws").cast("string"), F.lit(" | 现行有效: "),
        F.col("active").cast("string"), F.lit("\n案例总数: "), F.col("cases").cast("string"), severe_text, F.lit("\n"),
    )
    # one row on either side
    return totals.crossJoin(F.broadcast(told)).select(F.when((status == "healthy") & (F.col("n") == 0), "").otherwise(text).alias("section"))


def redline_candidates(risks: DataFrame, most: int = 5) -> DataFrame:
    """The findings of a document with suggestion and preview, by level, at most five."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy(F.desc(level_rank(F.col("risk_level"))), "ord")
    full = risks.where("length(suggestion) > 0 and length(clause_preview) > 0")
    return full.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")
