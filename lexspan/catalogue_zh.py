"""Registered queries over Chinese packs, full reports, corrections and reference material."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from lexspan import catalogue as base
from lexspan.operators import classify, dialog, feedback, pages, privacy, redline, report, retrieval, rules
from lexspan.plans.packs import LATIN, LEVELS, PLAYBOOKS, load_rules
from lexspan.registry import ORACLE_SQL, bag_sql, cosine_sql, fixture, lit, query, table, values

PACK = load_rules(Path(__file__).parent / "plans" / "contract_zh.yaml")
PARTY_A = next(p for p in PLAYBOOKS if p.playbook_id == "party_a")

# Chinese texts, a text for each row of documents: the clauses that its id chooses

CLAUSES = [
    "本合同由甲方与乙方签订，双方约定如下。", "乙方应在30日内向甲方付款，价款以发票为准。", "甲方应向乙方支付人民币5000元作为报酬。", "因履行产生的争议提交北京仲裁委员会仲裁。",
    "争议由甲方所在地法院管辖。", "甲方有权随时解除本协议，对乙方的损失概不负责。", "协商一致后双方均有权解除。", "甲方可以变更服务条款。", "平台收集用户信息并向第三方提供。",
    "经用户同意，平台可以共享个人信息。", "隐私政策说明数据收集的目的和Cookie的使用。", "def main(): return self.config", "from src/app.py import logger  # TODO refactor", "违约方应赔偿损失，授权和许可不得转让。",
    "双方的合作以担保和抵押为条件。", "npm install; git commit; merge branch",
]
_CHOSEN = [(f"(doc_id * {2 * k + 3} + {k * k}) % 7 < 3", t) for k, t in enumerate(CLAUSES)]
ZH_SQL = "(SELECT doc_id, concat_ws(chr(10), " + ", ".join(f"CASE WHEN {c} THEN {lit(t)} END" for c, t in _CHOSEN) + ") AS text FROM documents)"


def _zh(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", *[F.when(F.expr(c), t) for c, t in _CHOSEN]).alias("text"))


def _told(of, pack):
    return f"CASE rule_id {' '.join(f'WHEN {lit(r.rule_id)} THEN {lit(getattr(r, of))}' for r in pack)} END AS {of}"


def _described_sql(sql, pack):
    return f"SELECT *, {', '.join(_told(c, pack) for c in ('description', 'legal_basis', 'suggestion'))} FROM ({sql})"


_RULES_ZH = base._rules_sql(PACK, "contract", PARTY_A).replace("FROM documents", f"FROM {ZH_SQL}")


@query(_described_sql(_RULES_ZH, PACK))
def q_rule_risks_zh(spark, sf_dir):
    found = rules.findings(_zh(spark, sf_dir), PACK, "contract", PARTY_A).withColumn("confidence", F.round("confidence", 6))
    return rules.described(found, PACK)


def _any(words):
    return "(" + "+".join(f"contains(t,{lit(w)})::INT" for w in words) + ")"


def _code(w):
    escaped = "".join(f"\\{c}" if c in ".()[]+*?|^$\\" else c for c in w)
    return f"regexp_matches(t,{lit(f'(^|[^a-zA-Z]){escaped}([^a-zA-Z]|$)')})::INT" if w.isascii() and len(w) <= 7 else f"contains(t,{lit(w)})::INT"


_TYPES = {k: _any(w) for k, w in classify.TYPE_WORDS.items()}
_TYPE_ZH = f"""SELECT doc_id, CASE WHEN b>=2 AND h/w>=0.005 THEN best WHEN h>=least_hits AND h/w>=0.005 THEN CASE WHEN b>0 THEN best ELSE 'contract' END ELSE 'unknown' END AS doc_type
FROM (SELECT *, greatest(contract, agreement, privacy_policy) AS b, CASE WHEN contract>=greatest(agreement, privacy_policy) THEN 'contract' WHEN agreement>=privacy_policy THEN 'agreement' ELSE 'privacy_policy' END AS best,
CASE WHEN c>=5 THEN 5+c ELSE 5 END AS least_hits FROM (SELECT doc_id, {', '.join(f'{s} AS {k}' for k, s in _TYPES.items())}, {_any(classify.SIGNALS)}::DOUBLE AS h, ({'+'.join(map(_code, classify.CODE))}) AS c,
greatest(1, len(regexp_extract_all(t, '[一-鿿]+|[a-zA-Z]+'))) AS w FROM (SELECT doc_id, lower(text) AS t FROM {ZH_SQL})))"""


def _typed(spark, sf_dir):
    kind = classify.document_type(F.col("text"), classify.TYPE_WORDS, classify.SIGNALS, classify.CODE)
    return _zh(spark, sf_dir).select("doc_id", kind.alias("doc_type"))


@query(_TYPE_ZH)
def q_doc_type_zh(spark, sf_dir):
    return _typed(spark, sf_dir)


@query(f"SELECT doc_id, doc_type<>'unknown' AS reviewed FROM ({_TYPE_ZH})")
def q_scope_gate(spark, sf_dir):
    known, others = classify.gated(_typed(spark, sf_dir))
    return known.select("doc_id", F.lit(True).alias("reviewed")).unionByName(others.select("doc_id", F.lit(False).alias("reviewed")))


@query(f"SELECT * FROM {values('playbook_id,role,strictness,n_focus,n_levels', [(p.playbook_id, p.role, p.strictness, len(p.focus), len(p.levels)) for p in PLAYBOOKS])}")
def q_playbooks(spark, sf_dir):
    rows = [(p.playbook_id, p.role, p.strictness, len(p.focus), len(p.levels)) for p in PLAYBOOKS]
    return fixture(spark, "playbook_id string, role string, strictness string, n_focus int, n_levels int", rows)


# reports

AT = "2026-09-01 08:30:00"
_FOUND = f"SELECT * FROM ({_described_sql(base.RULES_SQL, LATIN)})"
_LEVEL = "CASE risk_level WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'low' THEN 1 ELSE 2 END"


def _name(of, names, other):
    return f"CASE {of} {' '.join(f'WHEN {lit(k)} THEN {lit(v)}' for k, v in names.items())} ELSE {other} END"


def _if(c, head, tail=""):
    return f"CASE WHEN {c}<>'' THEN {lit(head)}||{c}||{lit(tail)} ELSE '' END"


_DETAIL = f"""chr(10)||'### '||{_name('risk_level', report.LEVEL_ICONS, "'⚪'")}||' 风险 '||place||': '||name||{lit(chr(10) * 2)}||'- **风险等级**: '||{_name('risk_level', report.LEVEL_NAMES, "'未知'")}||'风险'
||{lit(chr(10) + '- **风险类别**: ')}||category||{lit(chr(10) + '- **风险描述**: ')}||description||{_if('legal_basis', chr(10) + '- 📖 **法律依据**: ')}||{_if('suggestion', chr(10) + '- **修改建议**: ')}
||{lit(chr(10) + '- **置信度**: ')}||round_even(confidence*100,0)::INT||'%'"""
_ADVICE = f"'- ['||{_name('risk_level', report.LEVEL_NAMES, 'risk_level')}||'] '||name||': '||suggestion"
_DETAILS = f"SELECT doc_id, count(*) AS n, {', '.join(f'count(*) FILTER (risk_level={lit(x)}) AS n_{x}' for x in LEVELS)}, string_agg({_DETAIL}, chr(10) ORDER BY place) AS details, string_agg({_ADVICE}, chr(10) ORDER BY ord) FILTER (suggestion<>'') AS advice FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_LEVEL} DESC, ord) AS place FROM ({_FOUND})) GROUP BY doc_id"
_COUNTS = "||".join(f"{lit(chr(10) + '| ' + report.LEVEL_ICONS[k] + ' ' + v + '风险 | ')}||coalesce(n_{k},0)||' |'" for k, v in report.LEVEL_NAMES.items())
_REPORT_DOCS = f"""SELECT doc_id, 'doc-'||doc_id AS document_name, t.doc_type, '检测到'||m.warning AS security_warning, coalesce(i.items, []) AS items FROM documents JOIN ({ORACLE_SQL['q_doc_type']}) t USING (doc_id)
JOIN ({ORACLE_SQL['q_pii_mask']}) m USING (doc_id) LEFT JOIN (SELECT doc_id, list('| '||type||' | '||masked_value||' |' ORDER BY start_pos) AS items FROM ({ORACLE_SQL['q_pii_spans']}) GROUP BY doc_id) i USING (doc_id)"""


def _report_docs(spark, sf_dir):
    kind = classify.document_type(F.col("text"), classify.LATIN_TYPES, classify.LATIN_SIGNALS, classify.LATIN_CODE)
    docs = table(spark, sf_dir, "documents")
    warned = privacy.masked_texts(docs).select("doc_id", F.concat(F.lit("检测到"), "warning").alias("security_warning"))
    return docs.select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("document_name"), kind.alias("doc_type")).join(warned, "doc_id")


def _report_risks(spark, sf_dir):
    return rules.described(base._risks(spark, sf_dir), LATIN)


@query(f"""SELECT doc_id, {lit(f'# 📋 法务审查报告{chr(10)}{chr(10)}| 项目 | 内容 |{chr(10)}|------|------|{chr(10)}| 报告编号 | {report.report_id(AT)} |{chr(10)}| 文件名称 | ')}||document_name||{lit(' |' + chr(10) + '| 文件类型 | ')}
||{_name('doc_type', report.TYPE_NAMES, 'doc_type')}||{lit(f' |{chr(10)}| 审查时间 | {AT} |{chr(10)}{chr(10)}')}
||CASE WHEN security_warning<>'' THEN {lit(f'## 🔒 安全提示{chr(10)}{chr(10)}')}||security_warning||CASE WHEN len(items)>0 THEN {lit(f'{chr(10)}{chr(10)}### 检测到的敏感信息{chr(10)}{chr(10)}| 类型 | 原始值（已脱敏） |{chr(10)}|------|-----------------|')}
||array_to_string(list_transform(items[1:10], lambda x: chr(10)||x), '')||{lit(report.MASK_ADVICE)} ELSE '' END||{lit(chr(10) * 2)} ELSE '' END
||{lit(f'## 📊 风险概览{chr(10)}{chr(10)}| 风险等级 | 数量 |{chr(10)}|----------|------|')}||{_COUNTS}||{lit(chr(10) + '| **合计** | **')}||coalesce(n,0)||'** |'||CASE WHEN n IS NULL THEN {lit(report.NO_RISKS)} ELSE '' END
||{lit(f'{chr(10)}{chr(10)}## 📝 详细风险分析')}||coalesce(chr(10)||details, {lit(report.NO_DETAILS)})||{lit(f'{chr(10)}{chr(10)}## 💡 合规建议')}||coalesce({lit(chr(10) * 2)}||advice||{lit(report.ADVICE)}, {lit(report.NO_SUGGESTIONS)})
||{lit(f'{chr(10)}{chr(10)}---{chr(10)}{chr(10)}## ⚖️ 免责声明{chr(10)}{chr(10)}{report.DISCLAIMER}{chr(10)}{chr(10)}---{chr(10)}{chr(10)}{report.timeliness(AT)}{chr(10)}{chr(10)}---{chr(10)}*本报告由 AI 辅助生成，审查时间：{AT}*')} AS report
FROM ({_REPORT_DOCS}) LEFT JOIN ({_DETAILS}) USING (doc_id)""")
def q_full_report(spark, sf_dir):
    items = privacy.pii_spans(table(spark, sf_dir, "documents"))
    return report.full(_report_docs(spark, sf_dir), _report_risks(spark, sf_dir), items, AT)


_JSON_RISK = f"{{id: rule_id, name: name, category: category, risk_level: risk_level, risk_level_cn: {_name('risk_level', report.LEVEL_NAMES, lit('中'))}, description: description, clause_position: NULL, legal_basis: legal_basis, suggestion: suggestion, confidence: confidence}}"
_SUMMARY = "{" + ", ".join(f"{x}: coalesce(n_{x},0)" for x in LEVELS) + ", total: coalesce(n,0)}"


@query(f"""SELECT doc_id, to_json({{report_id: {lit(report.report_id(AT))}, document_name: document_name, document_type: doc_type, review_time: {lit(AT)}, risk_summary: {_SUMMARY}, risks: coalesce(risks, []),
security_warning: security_warning, disclaimer: {lit(report.DISCLAIMER)}, timeliness_disclaimer: {lit(report.timeliness(AT))}}})::VARCHAR AS report FROM ({_REPORT_DOCS}) LEFT JOIN (
SELECT doc_id, count(*) AS n, {', '.join(f'count(*) FILTER (risk_level={lit(x)}) AS n_{x}' for x in LEVELS)}, list({_JSON_RISK} ORDER BY ord) AS risks FROM ({_FOUND}) GROUP BY doc_id) USING (doc_id)""")
def q_report_json(spark, sf_dir):
    return report.dictionary(_report_docs(spark, sf_dir), _report_risks(spark, sf_dir), AT)


FX_MATERIAL = [
    (1, "provision", "甲法第一条", "active", "2026-05-01", ""), (2, "provision", "乙法第二条", "repealed", "2020-01-01", "丙法"), (3, "provision", "丁法第三条", "amended", "2025-12-01", ""),
    (4, "case", "甲案", "active", "2024-01-01", ""), (5, "case", "乙案", "active", "2026-01-01", ""), (6, "provision", "戊法第四条", "active", "not a day", ""), (7, "provision", "己法第五条", "repealed", None, ""),
]
_DAYS = "date_diff('day', try_cast(last_verified AS DATE), DATE '2026-09-01')"
_WARNED = f"""SELECT ord, item_type, name, message, severity, old FROM (SELECT *, {_DAYS} AS days FROM {values('ord,item_type,name,status,last_verified,repealed_by', FX_MATERIAL)}), LATERAL (
SELECT '该法条已 '||days||' 天未验证（超过 365 天），建议核实是否仍然有效' AS message, 'critical' AS severity, true AS old WHERE item_type='provision' AND days>365
UNION ALL SELECT '该法条已 '||days||' 天未验证，建议核实最新状态', 'warning', false WHERE item_type='provision' AND days>180 AND days<=365
UNION ALL SELECT '该法条已废止'||CASE WHEN repealed_by<>'' THEN '（被'||repealed_by||'取代）' ELSE '' END, 'critical', false WHERE item_type='provision' AND status='repealed'
UNION ALL SELECT '该法条已修订，请使用最新版本', 'warning', false WHERE item_type='provision' AND status='amended'
UNION ALL SELECT '该案例已 '||days||' 天未验证，裁判规则可能已变化', 'critical', true WHERE item_type='case' AND days>365)"""


def _material(spark):
    return fixture(spark, "ord long, item_type string, name string, status string, last_verified string, repealed_by string", FX_MATERIAL)


@query(f"SELECT ord::BIGINT AS ord, item_type, name, message, severity, old FROM ({_WARNED})")
def q_freshness_warnings(spark, sf_dir):
    return dialog.freshness_warnings(_material(spark), "2026-09-01").select("ord", "item_type", "name", "message", "severity", "old")


@query(f"""SELECT {lit(f'## 📅 知识库新鲜度报告{chr(10)}知识库整体状态: **存在过期数据**{chr(10)}法条总数: ')}||(SELECT count(*) FILTER (item_type='provision') FROM {values('ord,item_type,name,status,last_verified,repealed_by', FX_MATERIAL)})||' | 现行有效: '
||(SELECT count(*) FILTER (item_type='provision' AND status='active') FROM {values('ord,item_type,name,status,last_verified,repealed_by', FX_MATERIAL)})||{lit(chr(10) + '案例总数: ')}||(SELECT count(*) FILTER (item_type='case') FROM {values('ord,item_type,name,status,last_verified,repealed_by', FX_MATERIAL)})
||{lit(f'{chr(10)}{chr(10)}🔴 发现 ')}||count(*)||{lit(' 条严重时效性警告:' + chr(10))}||string_agg(chr(10)||'- **'||name||'**: '||message, '' ORDER BY ord, old DESC)||chr(10) AS section FROM ({_WARNED}) WHERE severity='critical'""")
def q_freshness_section(spark, sf_dir):
    """Four warnings are critical, so all are told."""
    items = _material(spark)
    return report.freshness_section(items, dialog.freshness_warnings(items, "2026-09-01"))


# searches with filters

COURTS = ["最高人民法院", "北京市第一中级人民法院"]
_CASES = [(k[0], k[3], k[2], k[4], k[5], COURTS[k[0] % 2], "指导案例" if k[0] < 4 else "典型案例") for k in base.KB]


@query(f"SELECT query_id, ord, score FROM ({ORACLE_SQL['q_case_search']}) WHERE ord IN (SELECT ord FROM {values('ord,title,issue,holding,keywords,court,case_type', _CASES)} WHERE contains(court,'北京') AND case_type='指导案例')")
def q_case_filter(spark, sf_dir):
    cases = fixture(spark, "ord long, title string, issue string, holding string, keywords array<string>, court string, case_type string", _CASES)
    found = retrieval.case_search(base._asked(spark)[0], cases, court="北京", case_type="指导案例")
    return found.select("query_id", "ord", F.round("score", 6).alias("score"))


@query(f"SELECT query_id, ord, score FROM ({ORACLE_SQL['q_keyword_search']}) WHERE ord IN (SELECT ord FROM {values(base.KB_NAMES, base.KB)} WHERE category='privacy')")
def q_keyword_filter(spark, sf_dir):
    asked, terms, kb = base._asked(spark)
    found = retrieval.keyword_search(retrieval.expanded(asked, terms), kb, 10, base.LEGAL, category="privacy")
    return found.select("query_id", "ord", F.round(F.col("score").cast("double"), 6).alias("score"))


@query(ORACLE_SQL["q_vector_topk"].replace("FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0", "FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0 AND c.label = 1"))
def q_vector_filter(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.vector_search(queries, e, 10, keep=F.col("label") == 1).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def q_to_embed(spark, sf_dir):
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return retrieval.absent(table(spark, sf_dir, "documents").select("doc_id"), known, "doc_id")


@query(f"SELECT ord::BIGINT AS ord, '《'||law||'》'||article||'（'||title||'）' AS citation FROM {values(base.KB_NAMES, base.KB)}")
def q_citation_text(spark, sf_dir):
    return base._asked(spark)[2].select("ord", redline.citation_text(F.col("law"), F.col("article"), F.col("title")).alias("citation"))


# corrections

_LINKED = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS risk_idx, name, risk_level, t.linked_clause AS clause_id FROM ({base.RULES_SQL}) LEFT JOIN ({ORACLE_SQL['q_risk_trace']}) t USING (doc_id, ord)"


@query(f"""SELECT l.doc_id, l.doc_id % 3 + 1 AS risk_idx, r.name AS risk_name, r.risk_level, coalesce(c.title,'') AS clause_title, md5(coalesce(c.content,'')) AS clause_md5 FROM labels l
JOIN ({_LINKED}) r ON r.doc_id=l.doc_id AND r.risk_idx=l.doc_id % 3 + 1 LEFT JOIN ({base._CLAUSES}) c ON c.doc_id=l.doc_id AND c.clause_id=r.clause_id""")
def q_feedback_clauses(spark, sf_dir):
    """A correction of each labelled document: of its first, second or third finding, by its id."""
    given = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 3 + 1).alias("risk_idx"))
    traced = base.QUERIES["q_risk_trace"](spark, sf_dir)
    risks = base._risks(spark, sf_dir).withColumn("ord", F.col("ord").cast("long")).join(traced, ["doc_id", "ord"], "left")
    out = feedback.with_clauses(given, risks, base._clauses(spark, sf_dir))
    return out.select("doc_id", "risk_idx", "risk_name", "risk_level", "clause_title", F.md5("clause_text").alias("clause_md5"))


FX_RECORDS = [
    (o, t, n, level, action, say, corrected, more)
    for (o, t, n), (level, action, say, corrected, more) in zip(
        base.FX_CORRECTED, [("high", "level_down", "usual here", "low", ""), ("high", "agree", "", "", None), ("low", "missed_risk", "", "", "costs"), ("medium", "other", None, "", ""), (None, None, None, None, None)]
    )
]
_RECORDS = "ord,clause_text,risk_name,risk_level,user_action,user_comment,corrected_level,corrected_risk_name"
_EXAMPLE = f"""{lit(feedback.LABELS['preview'])}||CASE WHEN length(clause_text)>100 THEN left(clause_text,100)||'…' ELSE coalesce(clause_text,'') END||{lit(chr(10) + feedback.LABELS['risk'])}||coalesce(risk_name,'')||' ['||coalesce(risk_level,'')||']'
||{lit(chr(10) + feedback.LABELS['action'])}||{_name('user_action', feedback.ACTIONS, "coalesce(user_action,'')")}||{'||'.join(f"CASE WHEN {c}<>'' THEN {lit(chr(10) + feedback.LABELS[c])}||{c} ELSE '' END" for c in ('user_comment', 'corrected_level', 'corrected_risk_name'))}||chr(10)"""


@query(f"""SELECT query_id, {lit(feedback.HEADING + chr(10))}||string_agg('### 示例 '||i||chr(10)||body, chr(10) ORDER BY i) AS examples FROM (
SELECT f.query_id, row_number() OVER (PARTITION BY f.query_id ORDER BY CASE WHEN f.why='text' THEN f.rank ELSE f.ord END) AS i, {_EXAMPLE} AS body
FROM ({ORACLE_SQL['q_corrections']}) f JOIN {values(_RECORDS, FX_RECORDS)} ON t.ord=f.ord) GROUP BY query_id""")
def q_few_shot(spark, sf_dir):
    records = fixture(spark, "ord long, clause_text string, risk_name string, risk_level string, user_action string, user_comment string, corrected_level string, corrected_risk_name string", FX_RECORDS)
    return feedback.few_shot(base.QUERIES["q_corrections"](spark, sf_dir), records)


# steps and pages

_STEPS = "SELECT conv_id AS run_id, turn AS step, CASE WHEN role='user' THEN 'tool_call' ELSE 'tool_result' END AS action, CASE WHEN (conv_id + turn) % 3 > 0 AND conv_id % 4 = 0 THEN 'not found: '||turn WHEN conv_id % 4 = 1 THEN left(text, 24) ELSE left(text, 60) END AS content FROM conversations"


_NONE = " OR ".join(f"contains(content,{lit(w)})" for w in dialog.NOTHING_FOUND)


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS n, substr(lower(content),1,2000) AS c FROM ({_STEPS})), b AS (SELECT *, {bag_sql('c')} AS bag FROM s WHERE action='tool_result'),
r AS (SELECT run_id, step, n, ({_NONE}) AS e FROM s WHERE action='tool_result'),
g AS (SELECT *, sum((NOT e)::INT) OVER (PARTITION BY run_id ORDER BY step) AS grp FROM r)
SELECT g.run_id, g.step, coalesce(l.low, false) AS low_gain, e AND sum(e::INT) OVER (PARTITION BY g.run_id, grp ORDER BY g.step) > 2 AS no_results FROM g LEFT JOIN (
SELECT x.run_id, x.n, bool_or(CASE WHEN x.c='' OR y.c='' THEN false WHEN x.c=y.c THEN true ELSE {cosine_sql('x.bag', 'y.bag')} > 0.8 END) AS low FROM b x JOIN b y ON x.run_id=y.run_id AND y.n BETWEEN x.n-4 AND x.n-1 GROUP BY 1,2) l ON l.run_id=g.run_id AND l.n=g.n""")
def q_information_gain(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    kind, text = F.col("conv_id") % 4, F.col("text")
    content = F.when(((F.col("conv_id") + F.col("turn")) % 3 > 0) & (kind == 0), F.concat(F.lit("not found: "), "turn")).when(kind == 1, F.left(text, F.lit(24))).otherwise(F.left(text, F.lit(60)))
    steps = c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("step"), F.when(F.col("role") == "user", "tool_call").otherwise("tool_result").alias("action"), content.alias("content"))
    return dialog.information_gain(steps).select("run_id", "step", "low_gain", "no_results")


@query("SELECT doc_id::BIGINT AS doc_id, round(coalesce(avg(c),0),6) AS confidence FROM (VALUES (1, 0.9), (1, 0.8), (1, NULL), (2, NULL)) AS t(doc_id, c) GROUP BY 1")
def q_page_confidence(spark, sf_dir):
    rows = [(1, 0.9), (1, 0.8), (1, None), (2, None)]
    return pages.mean_confidence(fixture(spark, "doc_id long, confidence double", rows)).select("doc_id", F.round("confidence", 6).alias("confidence"))
