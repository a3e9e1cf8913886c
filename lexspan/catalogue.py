"""Registered queries over the library's operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexspan.functions.edit import difference, indel_ratio
from lexspan.functions.text import grams, jaccard, occurrences, similarity
from lexspan.operators import classify, dialog, entities, metadata, pages as layout, privacy, redline, report, responses, retrieval, rules, segment, structure, tables
from lexspan.plans.packs import BUYER, LATIN, LEVELS, NEUTRAL, Playbook, Rule
from lexspan.registry import ORACLE_SQL, QUERIES, fixture, lit, query, similarity_sql, table, values  # noqa: F401
from lexspan.sources import files, word

# rules over documents


def _hits(words) -> str:
    return "(" + "+".join([f"contains(lower(text),{lit(w)})::INT" for w in words] or ["0"]) + ")"


def _rules_sql(pack: list[Rule], doc_type: str, playbook: Playbook) -> str:
    parts = []
    for i, r in enumerate(pack):
        if doc_type not in r.types or r.rule_id in playbook.excluded:
            continue
        if r.missing:
            p = "(" + " OR ".join([f"regexp_matches(lower(text),{lit(x)})" for x in r.substance] or ["false"]) + ")"
            h = _hits(r.presence)
            c, level = f"CASE WHEN {h}=0 THEN 0.9 WHEN NOT {p} THEN greatest(0.3, 0.7-0.3*({h}/{float(max(len(r.presence), 1))})) END", playbook.levels.get(r.rule_id, r.level)
        else:
            a, s = _hits(r.risk), _hits(r.safe)
            no = f"{a}=0 OR ({s}>={a} AND {s}>0)" + (f" OR {s}>0" if r.require_safe_absence else "")
            c = f"CASE WHEN NOT ({no}) THEN greatest(0.3, least(0.95, 0.5+0.4*({a}/{float(max(len(r.risk), 1))})-0.4*({s}/{float(max(len(r.safe), 1))}))) END"
            level = "high" if r.category in playbook.focus and LEVELS.get(r.level, 2) < 3 else r.level
        parts.append(f"SELECT doc_id, {i} AS ord, {lit(r.rule_id)} AS rule_id, {lit(r.name)} AS name, {lit(r.category)} AS category, {lit(level)} AS risk_level, round(CAST({c} AS DOUBLE),6) AS confidence FROM documents")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE confidence IS NOT NULL"


RULES_SQL = _rules_sql(LATIN, "contract", NEUTRAL)


def _risks(spark, sf_dir, playbook=NEUTRAL):
    return rules.findings(table(spark, sf_dir, "documents"), LATIN, "contract", playbook).withColumn("confidence", F.round("confidence", 6))


@query(RULES_SQL)
def q_rule_risks(spark, sf_dir):
    return _risks(spark, sf_dir)


@query(f"SELECT doc_id, count(*) AS n_risks, {', '.join(f'count(*) FILTER (risk_level={lit(x)}) AS n_{x}' for x in LEVELS)} FROM ({RULES_SQL}) GROUP BY doc_id")
def q_rule_counts(spark, sf_dir):
    return rules.level_counts(_risks(spark, sf_dir))


@query(f"SELECT doc_id, string_agg('['||rule_id||']'||name||'('||risk_level||')', '; ' ORDER BY ord) AS summary FROM ({RULES_SQL}) GROUP BY doc_id")
def q_rule_summary(spark, sf_dir):
    return rules.summary(_risks(spark, sf_dir))


@query(_rules_sql(LATIN, "contract", BUYER))
def q_playbook_adjusted(spark, sf_dir):
    return _risks(spark, sf_dir, BUYER)


_TYPE = {t: _hits(w) for t, w in classify.LATIN_TYPES.items()}
_BEST = f"greatest({','.join(_TYPE.values())})"
_CODE = "(" + "+".join(f"contains(lower(text),{lit(w)})::INT" for w in classify.LATIN_CODE) + ")"


@query(f"""SELECT doc_id, CASE WHEN b>=2 AND h/w>=0.005 THEN best WHEN h>=least_hits AND h/w>=0.005 THEN CASE WHEN b>0 THEN best ELSE 'contract' END ELSE 'unknown' END AS doc_type
FROM (SELECT doc_id, {_BEST} AS b, CASE {' '.join(f"WHEN {s}={_BEST} THEN {lit(t)}" for t, s in _TYPE.items())} END AS best, {_hits(classify.LATIN_SIGNALS)}::DOUBLE AS h,
greatest(1, len(regexp_extract_all(lower(text), '[一-鿿]+|[a-zA-Z]+'))) AS w, CASE WHEN {_CODE}>=5 THEN 5+{_CODE} ELSE 5 END AS least_hits FROM documents)""")
def q_doc_type(spark, sf_dir):
    t = classify.document_type(F.col("text"), classify.LATIN_TYPES, classify.LATIN_SIGNALS, classify.LATIN_CODE)
    # the Latin code words hold no letters, so the look-around never bites and plain containment is the same
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("doc_type"))


FX_RISKS = [
    (1, 1, "R1", "late payment", "high", "the buyer pays late fees each month"), (1, 2, "R1", "late payment", "critical", "x"), (1, 3, "R2", "venue", "low", "court of the seller"),
    (1, 4, "", "Model risk", "low", "the supplier may change prices at any time"), (1, 5, "", "model risk", "high", "the supplier may change prices at any times"), (1, 6, "", "model risk", "low", ""),
    (2, 1, "R1", "late payment", "weird", "y"), (2, 2, "R1", "late payment", "low", "z"),
]
_RANK = "CASE risk_level WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query(f"""SELECT doc_id, place::BIGINT AS place, rule_id, risk_level FROM (SELECT *, min(ord) OVER (PARTITION BY doc_id, rule_id) AS place, row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY {_RANK} DESC, ord) AS rn
FROM {values('doc_id,ord,rule_id,name,risk_level,clause_preview', FX_RISKS)} WHERE rule_id<>'') WHERE rn=1""")
def q_risk_dedup(spark, sf_dir):
    df = fixture(spark, "doc_id long, ord long, rule_id string, name string, risk_level string, clause_preview string", FX_RISKS)
    return rules.deduplicated(df.where("rule_id <> ''")).select("doc_id", "place", "rule_id", "risk_level")


_LOOSE = f"(SELECT * FROM {values('doc_id,ord,rule_id,name,risk_level,clause_preview', FX_RISKS)} WHERE rule_id='')"


@query(f"""SELECT doc_id, ord, rule_id, risk_level FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY {_RANK} DESC, ord) AS rn FROM {values('doc_id,ord,rule_id,name,risk_level,clause_preview', FX_RISKS)} WHERE rule_id<>'') WHERE rn=1
UNION ALL SELECT doc_id, ord, rule_id, risk_level FROM {_LOOSE} a WHERE NOT EXISTS (SELECT 1 FROM {_LOOSE} b WHERE a.doc_id=b.doc_id AND lower(a.name)=lower(b.name) AND a.ord>b.ord AND a.clause_preview<>'' AND b.clause_preview<>''
AND {similarity_sql('substr(a.clause_preview,1,100)', 'substr(b.clause_preview,1,100)')}>0.8)""")
def q_risk_dedup_fuzzy(spark, sf_dir):
    df = fixture(spark, "doc_id long, ord long, rule_id string, name string, risk_level string, clause_preview string", FX_RISKS)
    return rules.deduplicated(df).select("doc_id", "ord", "rule_id", "risk_level")


# segments

#: headers of the synthetic documents: lines of capitals only, and license lines
LATIN_HEADERS = [r"^Licensed under", r"^[A-Z][a-z]+\.$"]
_LINES = "SELECT doc_id, pos, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"
_CLAUSES = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg) AS clause_id, title, content FROM (
SELECT doc_id, seg, max(line) FILTER (head=1) AS title, regexp_replace(string_agg(line, chr(10) ORDER BY pos) FILTER (head=0), '^\\s+|\\s+$', '', 'g') AS content FROM (
SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY pos) AS seg, sum(head) OVER (PARTITION BY doc_id) AS heads FROM (
SELECT *, (regexp_matches(line, '^Licensed under') OR regexp_matches(line, '^[A-Z][a-z]+\\.$'))::INT AS head FROM ({_LINES}))) WHERE seg>0 OR heads=0 GROUP BY doc_id, seg) WHERE content<>''"""


def _clauses(spark, sf_dir):
    return segment.clauses(table(spark, sf_dir, "documents"), LATIN_HEADERS, [])


@query("""
    with raw as (
        select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents
    ), lines as (
        select doc_id, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') as line, length(raw) - length(regexp_replace(raw, '^\\s+', '')) as lead,
            (sum(length(raw) + 1) over (partition by doc_id order by pos) - length(raw) - 1)::bigint as place
        from raw
    ), marked as (select *, (regexp_matches(line, '^Licensed under') or regexp_matches(line, '^[A-Z][a-z]+\\.$'))::int as head from lines),
    numbered as (select *, sum(head) over (partition by doc_id order by pos) as seg, sum(head) over (partition by doc_id) as heads from marked),
    found as (
        select doc_id, seg, max(line) filter (head = 1) as title, regexp_replace(string_agg(line, chr(10) order by pos) filter (head = 0), '^\\s+|\\s+$', '', 'g') as content,
            min(place + lead) filter (head = 0 and line <> '') as start_pos, max(place + lead + length(line)) filter (head = 0 and line <> '') as end_pos
        from numbered where seg > 0 or heads = 0 group by doc_id, seg
    )
    select doc_id, row_number() over (partition by doc_id order by seg) as clause_id, title, content, start_pos, end_pos from found where content <> ''""")
def q_clause_split(spark, sf_dir):
    return _clauses(spark, sf_dir)


LATIN_CLAUSES = [("license", ["licensed", "version"]), ("contact", ["@mail", "555-"]), ("table", [" | "])]


@query(f"""SELECT doc_id, clause_id, CASE {' '.join(f"WHEN {' OR '.join(f'contains(t,{lit(w)})' for w in ws)} THEN {lit(n)}" for n, ws in LATIN_CLAUSES)} END AS clause_type
FROM (SELECT doc_id, clause_id, lower(coalesce(title,'')||' '||substr(content,1,500)) AS t FROM ({_CLAUSES}))""")
def q_clause_type(spark, sf_dir):
    return _clauses(spark, sf_dir).select("doc_id", "clause_id", classify.clause_type(F.col("title"), F.col("content"), LATIN_CLAUSES).alias("clause_type"))


@query(f"""WITH c AS ({_CLAUSES}), r AS (SELECT doc_id, ord FROM ({RULES_SQL}) WHERE rule_id IN ('COND_001','COND_003')),
p AS (SELECT doc_id, max(content) AS last, min(content) AS first, min(title) AS title FROM c GROUP BY doc_id),
a AS (SELECT r.doc_id, r.ord, CASE WHEN r.doc_id % 4 = 0 THEN coalesce(p.title,'') ELSE '' END AS t, CASE WHEN r.doc_id % 4 = 1 THEN substr(p.last,1,60) WHEN r.doc_id % 4 = 2 THEN substr(p.first,11,60) WHEN r.doc_id % 4 = 3 THEN substr(p.first,3,12) ELSE '' END AS v FROM r JOIN p USING (doc_id)),
j AS (SELECT a.doc_id, a.ord, c.clause_id, (contains(lower(c.content),' | ')::INT + contains(lower(c.content),'token')::INT + contains(lower(c.content),'***')::INT) AS score,
CASE WHEN a.t<>'' AND coalesce(c.title,'')<>'' AND (contains(c.title,a.t) OR contains(a.t,c.title)) THEN 1 WHEN length(a.v)>20 AND starts_with(c.content,substr(a.v,1,40)) THEN 2 WHEN length(a.v)>20 AND contains(c.content,substr(a.v,1,50)) THEN 3 END AS s FROM a JOIN c USING (doc_id))
SELECT doc_id, ord::BIGINT AS ord, CASE WHEN s IS NOT NULL OR score>0 THEN clause_id END AS linked_clause FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY coalesce(s, CASE WHEN score>0 THEN 4 ELSE 9 END), CASE WHEN s IS NULL THEN score ELSE 0 END DESC, clause_id) AS rn FROM j) WHERE rn=1""")
def q_risk_trace(spark, sf_dir):
    found = _risks(spark, sf_dir).where("rule_id in ('COND_001', 'COND_003')")
    clauses = _clauses(spark, sf_dir)
    told = clauses.groupBy("doc_id").agg(F.max("content").alias("last"), F.min("content").alias("first"), F.min("title").alias("title"))
    # documents whose every line is a header have no clauses and no trace; by id, previews and titles take turns
    kind = F.col("doc_id") % 4
    preview = F.when(kind == 1, F.substring("last", 1, 60)).when(kind == 2, F.substring("first", 11, 60)).when(kind == 3, F.substring("first", 3, 12)).otherwise("")
    asked = found.join(told, "doc_id").select(
        "doc_id", F.col("ord").cast("long").alias("ord"), "name", F.when(kind == 0, F.coalesce("title", F.lit(""))).otherwise("").alias("clause_title"), preview.alias("clause_preview"),
        F.array(F.lit(" | "), F.lit("TOKEN"), F.lit("***")).alias("keywords"),
    )
    return rules.traced(asked, clauses).select("doc_id", "ord", "linked_clause")


def _last(mark: str, n: int) -> str:
    """SQL of the last place of a mark in the first 5,000 characters, from 0, or -1."""
    at = f"instr(reverse(left(rest,5000)), {mark})"
    return f"CASE WHEN {at}>0 THEN 5001-{n}-{at} ELSE -1 END"


_CUTS = f"""WITH RECURSIVE s(doc_id, piece, content, rest) AS (SELECT doc_id, -1, NULL::VARCHAR, coalesce(text,'') FROM documents UNION ALL
SELECT doc_id, piece+1, CASE WHEN length(rest)<=5000 THEN rest ELSE left(rest,place+1) END, CASE WHEN length(rest)>5000 THEN CASE WHEN length(rest)-place-1>5000 OR regexp_matches(substr(rest,place+2),'\\S') THEN substr(rest,place+2) END END
FROM (SELECT *, CASE WHEN blank>=1666 THEN blank WHEN line>=1666 THEN line WHEN stop>=1666 THEN stop ELSE 5000 END AS place FROM (
SELECT *, {_last('chr(10)||chr(10)', 2)} AS blank, {_last('chr(10)', 1)} AS line, {_last("'。'", 1)} AS stop FROM s WHERE rest IS NOT NULL)))
SELECT doc_id, piece, content, count(*) OVER (PARTITION BY doc_id) AS n FROM s WHERE piece>=0"""


@query(f"SELECT doc_id, piece::BIGINT AS piece, length(content)::BIGINT AS n_chars FROM ({_CUTS}) WHERE n<=3 OR piece IN (0, n//2, n-1)")
def q_segments(spark, sf_dir):
    cut = segment.pieces(table(spark, sf_dir, "documents"))
    return segment.first_middle_last(cut, "doc_id", "piece").select("doc_id", "piece", F.length("content").cast("long").alias("n_chars"))


FX_TITLES = [(1, 1, "第一章 总则"), (1, 2, "第一条 定义"), (1, 3, "（一）术语"), (1, 4, "第二条 价款"), (1, 5, "说明"), (1, 6, "第二章 付款"), (1, 7, "第三条 付款"), (1, 8, "1.2 分期"), (1, 9, "Article 4 Term"), (1, 10, "2.1.3 x"), (2, 1, "前言"), (2, 2, "一、内容"), (3, 1, "(1) a"), (3, 2, "1、 b"), (3, 3, "Article IV x"), (3, 4, "1.1. c"), (3, 5, "1.2.3.4.5 d")]
_TREE = [
    (1, 1, "chapter", 1, None), (1, 2, "article", 1, 1), (1, 3, "item", 1, 2), (1, 4, "article", 2, 1), (1, 5, None, None, 4), (1, 6, "chapter", 2, None), (1, 7, "article", 3, 6),
    (1, 8, "paragraph", 2, 7), (1, 9, "article", 4, 6), (1, 10, "subitem", 3, 9), (2, 1, None, None, None), (2, 2, "article", 1, None),
    (3, 1, "item", 1, None), (3, 2, "article", 1, None), (3, 3, "article", 0, None), (3, 4, "paragraph", 1, 3), (3, 5, "item", 5, 4),
]


@query(f"SELECT doc_id::BIGINT AS doc_id, ord::BIGINT AS ord, level, number::BIGINT AS number, parent::BIGINT AS parent FROM {values('doc_id,ord,level,number,parent', _TREE)}")
def q_clause_tree(spark, sf_dir):
    return structure.clause_tree(fixture(spark, "doc_id long, ord long, title string", FX_TITLES)).select("doc_id", "ord", "level", F.col("number").cast("long").alias("number"), "parent")


@query("""SELECT doc_id, (generate_subscripts - 1)::BIGINT AS line, len(list_filter(string_split(line,' | '), lambda x: trim(x)<>''))::BIGINT AS n_cells, list_filter(string_split(line,' | '), lambda x: trim(x)<>'')[1] AS first_cell
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS generate_subscripts FROM documents) WHERE contains(line,' | ')""")
def q_pipe_tables(spark, sf_dir):
    return structure.pipe_rows(table(spark, sf_dir, "documents"))


FX_BLOCKS = [
    (1, 0, "h", "header", 0.0, 0.0, 100.0, 5.0), (1, 0, "f", "footer", 0.0, 95.0, 100.0, 100.0), (1, 0, "l1", "text", 0.0, 10.0, 45.0, 20.0), (1, 0, "r1", "text", 55.0, 10.0, 100.0, 20.0),
    (1, 0, "l2", "text", 0.0, 30.0, 45.0, 40.0), (1, 0, "r2", "title", 55.0, 30.0, 100.0, 40.0), (2, 0, "a", "text", 0.0, 50.0, 100.0, 60.0), (2, 0, "b", "text", 0.0, 10.0, 100.0, 20.0), (2, 0, "c", "image", 0.0, 15.0, 10.0, 18.0),
]
_READ = [(1, "h", 0, 2), (1, "l1", 1, 2), (1, "l2", 2, 2), (1, "r1", 3, 2), (1, "r2", 4, 2), (1, "f", 5, 2), (2, "b", 0, 1), (2, "c", 1, 1), (2, "a", 2, 1)]


@query(f"SELECT doc_id::BIGINT AS doc_id, block_id, reading_order::BIGINT AS reading_order, n_columns::BIGINT AS n_columns FROM {values('doc_id,block_id,reading_order,n_columns', _READ)}")
def q_reading_order(spark, sf_dir):
    df = fixture(spark, "doc_id long, page_index int, block_id string, block_type string, x1 double, y1 double, x2 double, y2 double", FX_BLOCKS)
    return structure.reading_order(df).select("doc_id", "block_id", F.col("reading_order").cast("long").alias("reading_order"), F.col("n_columns").cast("long").alias("n_columns"))


FX_PAGES = [(1, 100.0, 100.0, 0, 9000.0), (1, 100.0, 100.0, 5, 8000.0), (2, 600.0, 800.0, 2000, 0.0), (3, 600.0, 800.0, 3, 0.0), (4, 600.0, 800.0, 500, 1000.0), (4, 600.0, 800.0, 10, 1000.0), (4, 600.0, 800.0, 10, 1000.0), (4, 600.0, 800.0, 10, 1000.0)]


@query(f"""SELECT doc_id::BIGINT AS doc_id, pages, CASE WHEN density<0.3 AND ratio>0.5 THEN 'images' WHEN pages>1 AND tp<0.3*pages AND ip>0.5*pages THEN 'pages' WHEN density<0.09 AND tp=0 THEN 'empty' END AS reason FROM (
SELECT doc_id, count(*) AS pages, sum(c)/greatest(sum(w*h)/1e4,1) AS density, sum(i)/greatest(sum(w*h),1) AS ratio, count(*) FILTER (c>20) AS tp, count(*) FILTER (i>0) AS ip FROM {values('doc_id,w,h,c,i', FX_PAGES)} GROUP BY doc_id)""")
def q_scan_detect(spark, sf_dir):
    df = fixture(spark, "doc_id long, width double, height double, char_count int, image_area double", FX_PAGES)
    return structure.scan_check(df).select("doc_id", "pages", "reason")


# personal data

_MAIL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"


def _matches_sql(k: int, kind: str, pattern: str, value: str = "v", where: str = "true") -> str:
    """Matches of a pattern with their places: each is put between two marks, and the lengths of the pieces add up."""
    return f"""
        select doc_id, {k} as k, s, s + length(v) as e, v, {lit(kind)} as type from (
            select doc_id, {value} as v, s from (
                select doc_id, split_part(piece, chr(2), 1) as v, split_part(piece, chr(2), 2) as tail, n, n = max(n) over (partition by doc_id) as last,
                    (sum(length(piece) - case when n = 1 then 0 else 1 end) over (partition by doc_id order by n) - length(piece) + 1)::bigint as s
                from (
                    select doc_id, unnest(pieces) as piece, generate_subscripts(pieces, 1) as n
                    from (select doc_id, string_split(regexp_replace(text, {lit('(' + pattern + ')')}, chr(1) || '\\1' || chr(2), 'g'), chr(1)) as pieces from documents)
                )
            ) where n > 1
        ) where {where}"""


_LUHN = "list_sum(list_transform(range(1, length(v) + 1), lambda i: case when i % 2 = 1 then ascii(substr(v, -i, 1)) - 48 else (2 * (ascii(substr(v, -i, 1)) - 48)) % 10 + (2 * (ascii(substr(v, -i, 1)) - 48)) // 10 end)) % 10 = 0"
# a match that no digit may precede or follow is a whole run of digits
_KINDS_SQL = [
    _matches_sql(0, "身份证号", "[0-9]+", "case when length(v) = 17 and (regexp_matches(tail, '(?s)^[Xx].') or lower(tail) = 'x' and last) then v || tail[1] else v end", "length(v) = 18"),
    _matches_sql(1, "手机号", "[0-9]+", where="length(v) = 11 and v[1] = '1' and v[2] between '3' and '9'"),
    _matches_sql(2, "邮箱", _MAIL),
    _matches_sql(3, "银行卡号", "[0-9]+", where=f"length(v) between 16 and 19 and {_LUHN}"),
    _matches_sql(4, "统一社会信用代码", "[0-9A-HJ-NPQRTUWXY]{2}[0-9]{6}[0-9A-HJ-NPQRTUWXY]{10}"),
]
_MASK_SQL = """case k when 1 then substr(v, 1, 3) || '****' || right(v, 4) when 3 then substr(v, 1, 4) || '****' || right(v, 4)
    when 2 then substr(split_part(v, '@', 1), 1, greatest(1, length(split_part(v, '@', 1)) // 2)::int) || '***@' || split_part(v, '@', 2) else substr(v, 1, 6) || '****' || right(v, 4) end"""
_ACCEPTED_SQL = "with " + ", ".join(
    f"a{k} as ({'select * from a' + str(k - 1) + ' union all ' if k else ''}select c.* from ({one}) c"
    + (f" where not exists (select 1 from a{k - 1} a where a.doc_id = c.doc_id and a.s < c.e and c.s < a.e))" if k else ")")
    for k, one in enumerate(_KINDS_SQL)
)


@query(f"{_ACCEPTED_SQL} select doc_id, type, s as start_pos, e as end_pos, {_MASK_SQL} as masked_value from a4")
def q_pii_spans(spark, sf_dir):
    return privacy.pii_spans(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, {lit(_MAIL)}))::BIGINT AS n FROM documents WHERE regexp_matches(text, {lit(_MAIL)})")
def q_pii_email_counts(spark, sf_dir):
    return q_pii_spans(spark, sf_dir).where(F.col("type") == "邮箱").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    _ACCEPTED_SQL
    + f""", parts as (
        select doc_id, string_agg(substr(text, before + 1, s - before) || {_MASK_SQL}, '' order by s) as head, max(e) as last, count(*) as n_spans,
            array_to_string([w[2] for w in [{', '.join(f"['{k}', {lit(privacy.WARNINGS[x])}]" for k, x in enumerate(privacy.KINDS))}] if list_contains(list(k::varchar), w[1])], '、') as warning
        from (select *, coalesce(lag(e) over (partition by doc_id order by s), 0) as before from a4) join documents using (doc_id) group by doc_id
    )
    select doc_id, md5(coalesce(head || substr(text, last + 1), text)) as masked_md5, coalesce(n_spans, 0) as n_spans, warning from documents left join parts using (doc_id)"""
)
def q_pii_mask(spark, sf_dir):
    return privacy.masked_texts(table(spark, sf_dir, "documents")).select("doc_id", F.md5("masked").alias("masked_md5"), "n_spans", "warning")


FX_SCOPE = [(1, "判处有期徒刑三年"), (2, "适用法律与管辖,有期徒刑"), (3, "普通合同"), (4, "死刑与刑罚"), (5, "合规,拘役")]


@query(f"SELECT id::BIGINT AS id, reason FROM {values('id,reason', [(1, '有期徒刑'), (2, None), (3, None), (4, '刑罚'), (5, '拘役')])}")
def q_out_of_scope(spark, sf_dir):
    return fixture(spark, "id long, text string", FX_SCOPE).select("id", classify.out_of_scope(F.col("text")).alias("reason"))


# retrieval


@query("""SELECT q.vec_id AS query_id, e.vec_id, e.rank::BIGINT AS rank, e.score FROM (SELECT 1) JOIN LATERAL (SELECT 1) ON true JOIN embeddings q ON q.vec_id % 100 = 0 JOIN (
SELECT query_id, vec_id, round(s,6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (
SELECT q.vec_id AS query_id, c.vec_id, greatest(0.0, 1 - list_sum(list_transform(list_zip(c.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS s
FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0) WHERE s >= 0.3) e ON e.query_id = q.vec_id AND e.rank <= 10""")
def q_vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.vector_search(queries, e, 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


KB = [
    (1, "Contract code", "Article 585", "Liquidated damages", "the parties may agree on liquidated damages for breach", ["damages", "breach"], "contract"),
    (2, "Contract code", "Article 563", "Termination", "a party may terminate where the other fails to perform", ["termination"], "contract"),
    (3, "Data act", "Article 13", "Consent", "personal data needs consent of the person", ["consent", "data"], "privacy"),
    (4, "Data act", "Article 47", "Deletion", "data is deleted when the purpose ends or consent is withdrawn", ["deletion", "data"], "privacy"),
]
KB_NAMES, KB_TYPES = "ord,law,article,title,content,keywords,category", "ord long, law string, article string, title string, content string, keywords array<string>, category string"
ASKED = [(1, "breach"), (2, "personal data"), (3, "consent"), (4, "nothing here"), (5, "default of the seller")]
TERMS = [("breach", "exact", "default", True), ("breach", "related", "damages", True), ("consent", "related", "approval", False), ("personal data", "exact", "data", True), ("data", "force", "personal", True), ("consent", "force", "consent", True)]
LEGAL = ["damages", "consent"]
_TERMS_SQL = f"(SELECT * FROM {values('term,kind,variant,expandable', TERMS).replace('True', 'true').replace('False', 'false')})"
_EXPANDED = f"""SELECT q.id, q.query, list_sort(list_distinct(list_concat([q.query], coalesce(list(t.variant) FILTER (t.variant IS NOT NULL), [])))) AS e
FROM {values('id,query', ASKED).replace(' AS t(', ' AS q(')} LEFT JOIN (SELECT DISTINCT a.id, x.term FROM {values('id,query', ASKED).replace(' AS t(', ' AS a(')}, {_TERMS_SQL} x WHERE x.kind<>'force' AND (contains(a.query,x.term) OR (x.kind='exact' AND contains(a.query,x.variant)))) n ON n.id=q.id
LEFT JOIN {_TERMS_SQL} t ON t.term=n.term AND t.kind<>'force' AND (t.kind='exact' OR t.expandable) GROUP BY q.id, q.query"""
_KEYWORD = f"""SELECT id, ord, s FROM (SELECT q.id, k.ord, least(2.0, CASE WHEN contains(k.txt,lower(q.query)) THEN 0.5 ELSE 0 END
+ 0.2*len(list_filter(q.e, lambda x: contains(k.txt, lower(x)))) + list_sum(list_transform(k.keywords, lambda w: CASE WHEN w IN ('damages','consent') THEN 0.4 ELSE 0.15 END))
+ CASE WHEN contains(lower(k.title),lower(q.query)) THEN 0.3 ELSE 0 END + 0.15*len(list_filter(q.e, lambda x: contains(lower(k.title),lower(x))))) AS s
FROM ({_EXPANDED}) q, (SELECT *, lower(law||' '||article||' '||title||' '||content||' '||array_to_string(keywords,' ')) AS txt FROM {values(KB_NAMES, KB)}) k) WHERE s>0.1"""
#: scores of a vector search of the same queries
NEAR = [(1, 2, 0.8), (2, 4, 0.9), (2, 3, 0.5), (4, 1, 0.35), (5, 1, 0.6)]
_FORCE = f"""SELECT DISTINCT q.id, k.ord, 0.7 AS s FROM {values('id,query', ASKED).replace(' AS t(', ' AS q(')} JOIN {values('term,kind,variant,expandable', TERMS)} ON t.kind='force' AND contains(q.query,t.variant) JOIN {values(KB_NAMES, KB).replace(' AS t(', ' AS k(')} ON list_contains(k.keywords, t.term)"""


def _asked(spark):
    return fixture(spark, "query_id long, query string", ASKED), fixture(spark, "term string, kind string, variant string, expandable boolean", TERMS), fixture(spark, KB_TYPES, KB)


@query(f"SELECT id::BIGINT AS query_id, array_to_string(e, '|') AS expansions FROM ({_EXPANDED})")
def q_expand(spark, sf_dir):
    asked, terms, _ = _asked(spark)
    return retrieval.expanded(asked, terms).select("query_id", F.array_join("expansions", "|").alias("expansions"))


@query(f"SELECT id::BIGINT AS query_id, ord::BIGINT AS ord, round(s::DOUBLE,6) AS score FROM ({_KEYWORD})")
def q_keyword_search(spark, sf_dir):
    asked, terms, kb = _asked(spark)
    return retrieval.keyword_search(retrieval.expanded(asked, terms), kb, 10, LEGAL).select("query_id", "ord", F.round(F.col("score").cast("double"), 6).alias("score"))


@query(f"SELECT id::BIGINT AS query_id, ord::BIGINT AS ord FROM ({_FORCE})")
def q_force_recall(spark, sf_dir):
    asked, terms, kb = _asked(spark)
    return retrieval.forced(asked, terms, kb).select("query_id", "ord")


_UNION = f"SELECT id, ord, max(v) AS v, max(s) AS k FROM (SELECT id, ord, s::DOUBLE AS s, 0 AS v FROM ({_KEYWORD}) UNION ALL SELECT id, ord, s::DOUBLE AS s, 0 AS v FROM ({_FORCE}) UNION ALL SELECT id, ord, 0 AS s, v::DOUBLE AS v FROM {values('id,ord,v', NEAR)}) GROUP BY id, ord"


_FUSED = f"""SELECT id, ord, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS rank FROM (
SELECT id, ord, 1.0/(row_number() OVER (PARTITION BY id ORDER BY v DESC, ord)+60) + 1.0/(row_number() OVER (PARTITION BY id ORDER BY k DESC, ord)+60) AS score FROM ({_UNION})))"""


def _hybrid(spark, k):
    asked, terms, kb = _asked(spark)
    near = fixture(spark, "query_id long, ord long, score double", NEAR)
    words = retrieval.keyword_search(retrieval.expanded(asked, terms), kb, 10, LEGAL).select("query_id", "ord", "score")
    return retrieval.fused(near, words, retrieval.forced(asked, terms, kb), k)


@query(f"SELECT id::BIGINT AS query_id, ord::BIGINT AS ord, rank::BIGINT AS rank, round(score,6) AS score FROM ({_FUSED}) WHERE rank<=3")
def q_hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, 3).select("query_id", "ord", "rank", F.round("score", 6).alias("score"))


_MATCH = """least(1.0, 0.3*len(list_filter(k.keywords, lambda w: contains({0}, lower(w)))) + CASE WHEN contains({0}, lower(k.title)) THEN 0.3 ELSE 0 END + CASE WHEN k.category='privacy' THEN 0.2 ELSE 0 END)"""


@query(f"""WITH h AS (SELECT id, ord, score FROM ({_FUSED}) WHERE rank<=2), k AS (SELECT * FROM {values(KB_NAMES, KB)}), q AS ({_EXPANDED}),
o AS (SELECT q.id, k.ord, {_MATCH.format('lower(q.query)')} AS own, coalesce(list_max(list_transform(list_filter(q.e, lambda x: x<>q.query), lambda x: {_MATCH.format('lower(x)')})),0) AS best FROM q, k
WHERE k.article NOT IN (SELECT k2.article FROM h JOIN k k2 USING (ord) WHERE h.id=q.id)),
u AS (SELECT id, ord, score, 0 AS place FROM h UNION ALL SELECT id, ord, CASE WHEN own<0.3 THEN greatest(own, best) ELSE own END, 1 FROM o WHERE CASE WHEN own<0.3 THEN greatest(own, best) ELSE own END > 0.3),
r AS (SELECT u.*, row_number() OVER (PARTITION BY id ORDER BY score DESC, place, ord) AS rank FROM u)
SELECT r.id::BIGINT AS risk_id, r.ord::BIGINT AS ord, k.article, CASE WHEN len(list_filter(k.keywords, lambda w: contains(lower(q.query), lower(w))))>0 THEN '匹配关键词：'||array_to_string(list_filter(k.keywords, lambda w: contains(lower(q.query), lower(w))), ', ') ELSE '与风险描述相关' END AS reason,
round(r.score::DOUBLE,6) AS score, r.rank::BIGINT AS rank FROM r JOIN k USING (ord) JOIN q ON q.id=r.id WHERE r.rank<=5""")
def q_statute_match(spark, sf_dir):
    """Every query as a risk of the category privacy; the search gives two provisions, so keywords add theirs."""
    asked, terms, kb = _asked(spark)
    risks = retrieval.expanded(asked, terms).select(F.col("query_id").alias("risk_id"), F.col("query").alias("description"), F.lit("privacy").alias("category"), "expansions")
    out = retrieval.statutes(risks, _hybrid(spark, 2), kb)
    return out.select("risk_id", "ord", "article", "reason", F.round(F.col("score").cast("double"), 6).alias("score"), "rank")


@query(f"SELECT ord::BIGINT AS ord, law, article FROM {values(KB_NAMES, KB)} WHERE contains(lower(content),'consent') OR contains(lower(title),'consent') OR list_contains(keywords,'consent')")
def q_provision_search(spark, sf_dir):
    return retrieval.provisions_with(_asked(spark)[2], "Consent").select("ord", "law", "article")


@query(f"SELECT ord::BIGINT AS ord, title FROM {values(KB_NAMES, KB)} WHERE contains(law,'Data') AND contains(article,'4') ORDER BY ord LIMIT 1")
def q_citation(spark, sf_dir):
    return retrieval.citation(_asked(spark)[2], "Data", "4").select("ord", "title")


@query(f"SELECT DISTINCT law, category FROM {values(KB_NAMES, KB)}")
def q_law_list(spark, sf_dir):
    return _asked(spark)[2].select("law", "category").distinct()


def _grams_sql(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i::INT, 2)))"


@query(f"""SELECT id::BIGINT AS query_id, ord::BIGINT AS ord, round(least(1.0, raw/scale),6) AS score FROM (SELECT id, ord, CASE WHEN n>0 THEN 5*n+5 ELSE 1 END AS scale,
2*len(list_filter(w, lambda x: contains(txt,x)))+3*len(list_filter(w, lambda x: contains(keys,x)))+5*(len(list_intersect(g1,g2))/len(list_distinct(list_concat(g1,g2)))::DOUBLE) AS raw FROM (
SELECT q.id, k.ord, k.txt, k.keys, list_filter(string_split(q.query,' '), lambda x: length(x)>=2) AS w, len(list_filter(string_split(q.query,' '), lambda x: length(x)>=2)) AS n, {_grams_sql('q.query')} AS g1, {_grams_sql('k.txt')} AS g2
FROM {values('id,query', ASKED).replace(' AS t(', ' AS q(')}, (SELECT ord, lower(title||' '||article||' '||content||' '||array_to_string(keywords,' ')) AS txt, lower(array_to_string(keywords,' ')) AS keys FROM {values(KB_NAMES, KB)}) k)) WHERE raw>0""")
def q_case_search(spark, sf_dir):
    asked, _, kb = _asked(spark)
    cases = kb.select("ord", "title", F.col("article").alias("issue"), F.col("content").alias("holding"), "keywords")
    return retrieval.case_search(asked, cases).select("query_id", "ord", F.round("score", 6).alias("score"))


FX_PAIRS = [(1, "night", "nacht"), (2, "same text", "Same Text"), (3, "", "x"), (4, "the supplier may change prices", "the supplier may change price"), (5, "abc", "xyz")]


@query(f"SELECT id::BIGINT AS id, round({similarity_sql('a', 'b')},6) AS similarity, round(coalesce(len(list_intersect({_grams_sql('a')},{_grams_sql('b')}))::DOUBLE/nullif(len(list_distinct(list_concat({_grams_sql('a')},{_grams_sql('b')}))),0),0),6) AS jaccard FROM {values('id,a,b', FX_PAIRS)}")
def q_similarity_ngram(spark, sf_dir):
    df = fixture(spark, "id long, a string, b string", FX_PAIRS)
    return df.select("id", F.round(similarity(F.col("a"), F.col("b")), 6).alias("similarity"), F.round(jaccard(grams(F.col("a"), 2), grams(F.col("b"), 2)), 6).alias("jaccard"))


# feedback, dialog, freshness, metrics

_FEEDBACK = "SELECT l.doc_id AS ord, CASE WHEN l.toxic=1 THEN 'confirm' WHEN l.quality=0 THEN 'false_positive' END AS user_action, d.lang AS risk_name FROM labels l JOIN documents d ON d.doc_id=l.doc_id"


def _feedback(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("risk_name"))
    action = F.when(F.col("toxic") == 1, "confirm").when(F.col("quality") == 0, "false_positive")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("ord"), action.alias("user_action"), "risk_name")


@query(f"SELECT 'action' AS dimension, coalesce(user_action,'unknown') AS value, count(*) AS n FROM ({_FEEDBACK}) GROUP BY 2 UNION ALL SELECT 'risk', coalesce(risk_name,'unknown'), count(*) FROM ({_FEEDBACK}) GROUP BY 2")
def q_feedback_stats(spark, sf_dir):
    return dialog.feedback_stats(_feedback(spark, sf_dir))


@query(f"SELECT count(*) AS total, round(avg((coalesce(user_action,'')='false_positive')::INT),6) AS fp_rate FROM ({_FEEDBACK})")
def q_feedback_fp_rate(spark, sf_dir):
    df = _feedback(spark, sf_dir).withColumn("user_action", F.coalesce("user_action", F.lit("")))
    return dialog.false_positive_rate(df).select("total", F.round("fp_rate", 6).alias("fp_rate"))


@query(f"SELECT ord, user_action FROM ({_FEEDBACK}) WHERE contains(risk_name,'d') ORDER BY ord DESC LIMIT 5")
def q_feedback_recent(spark, sf_dir):
    return dialog.recent_by_risk(_feedback(spark, sf_dir), "d", 5).select("ord", "user_action")


FX_FRESH = [("provision", "a", "active", "2026-05-01"), ("provision", "b", "repealed", "2020-01-01"), ("provision", "c", "active", "2024-01-01"), ("case", "d", "active", "2026-01-01"), ("case", "e", "amended", None)]
_FRESH = f"""SELECT *, CASE WHEN status='repealed' OR days>365 THEN 'critical' WHEN days>180 THEN 'warning' END AS severity FROM (SELECT *, date_diff('day', last_verified::DATE, DATE '2026-09-01') AS days FROM {values('item_type,name,status,last_verified', FX_FRESH)})"""


def _fresh(spark):
    return dialog.freshness(fixture(spark, "item_type string, name string, status string, last_verified string", FX_FRESH), "2026-09-01")


@query(f"SELECT item_type, name, status, days::BIGINT AS days, severity FROM ({_FRESH})")
def q_freshness(spark, sf_dir):
    return _fresh(spark).select("item_type", "name", "status", "days", "severity")


@query(f"SELECT count(*) AS total, count(*) FILTER (status='active') AS active, count(*) FILTER (status='amended') AS amended, count(*) FILTER (status='repealed') AS repealed, count(*) FILTER (days>365) AS outdated, CASE WHEN count(*) FILTER (severity='critical')>0 THEN 'critical' WHEN count(*) FILTER (days>365)>0.3*count(*) THEN 'needs_review' ELSE 'healthy' END AS overall FROM ({_FRESH})")
def q_freshness_report(spark, sf_dir):
    return dialog.freshness_report(_fresh(spark))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn<=6 AND role IN ('user','assistant')")
def q_history_last_n(spark, sf_dir):
    return dialog.last_n(table(spark, sf_dir, "conversations"), 6, ("user", "assistant")).select("conv_id", "turn", "role")


REPLIES = [("hello", ["hello", "bonjour"]), ("thanks", ["thank", "merci"]), ("the", [" the "]), ("numbers", ["1", "2", "3"])]


@query(f"SELECT conv_id, turn, CASE WHEN length(text)>2000 THEN 'too long' {' '.join('WHEN ' + ' OR '.join(f'contains(lower(text),{lit(w)})' for w in ws) + f' THEN {lit(n)}' for n, ws in REPLIES)} END AS reply FROM conversations")
def q_quick_reply(spark, sf_dir):
    return dialog.quick_reply(table(spark, sf_dir, "conversations"), REPLIES)


@query("SELECT c.conv_id, c.turn FROM conversations c LEFT JOIN (SELECT conv_id, max(turn) AS last FROM conversations WHERE role='assistant' GROUP BY 1) a USING (conv_id) WHERE role='user' AND (last IS NULL OR turn>last)")
def q_followups(spark, sf_dir):
    return dialog.unanswered(table(spark, sf_dir, "conversations")).select("conv_id", "turn")


@query("SELECT conv_id, turn FROM conversations c WHERE role='user' AND EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id=c.conv_id AND a.turn=c.turn+1 AND a.role='assistant')")
def q_toolcall_pairs(spark, sf_dir):
    return dialog.paired_calls(table(spark, sf_dir, "conversations")).select("conv_id", "turn")


@query("""SELECT user_id, session, count(*) AS n_events FROM (SELECT *, sum(far) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 7200000000)::INT, 0) AS far FROM events)) GROUP BY 1, 2""")
def q_sessions_ttl(spark, sf_dir):
    return dialog.sessions(table(spark, sf_dir, "events"), 7200).select("user_id", "session", "n_events")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def q_task_topn(spark, sf_dir):
    return dialog.newest(table(spark, sf_dir, "events"), 25, "ts", "event_id").select("event_id", "user_id")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn<=50")
def q_task_retention(spark, sf_dir):
    return dialog.retained(table(spark, sf_dir, "events"), "event_type", "ts", "event_id", 50).select("event_id", "user_id")


_MODELS = ["qwen-turbo", "Qwen-Max", "gpt-4o", "other"]
_CALLS = f"SELECT list_extract({_MODELS}, (event_id%4+1)::INT) AS model, user_id AS p, event_id%1000 AS c FROM events"


@query(f"""SELECT model, count(*) AS n_calls, sum(p+c)::BIGINT AS total_tokens, round(sum(p/1e6*CASE lower(model) WHEN 'qwen-turbo' THEN 0.8 WHEN 'qwen-max' THEN 20 WHEN 'gpt-4o' THEN 18 ELSE 4 END
+ c/1e6*CASE lower(model) WHEN 'qwen-turbo' THEN 2 WHEN 'qwen-max' THEN 60 WHEN 'gpt-4o' THEN 54 ELSE 12 END),6) AS cost FROM ({_CALLS}) GROUP BY model""")
def q_llm_cost(spark, sf_dir):
    model = F.get(F.array(*map(F.lit, _MODELS)), (F.col("event_id") % 4).cast("int"))
    calls = table(spark, sf_dir, "events").select(model.alias("model"), F.col("user_id").alias("prompt_tokens"), (F.col("event_id") % 1000).alias("completion_tokens"))
    return dialog.call_costs(calls).withColumn("cost", F.round("cost", 6))


@query("SELECT event_type AS stage, round(sum(value),4) AS ms, round(100*sum(value)/sum(sum(value)) OVER (),6) AS pct FROM events GROUP BY event_type")
def q_stage_pct(spark, sf_dir):
    out = dialog.stage_shares(table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("duration_ms")))
    return out.select("stage", F.round("ms", 4).alias("ms"), F.round("pct", 6).alias("pct"))


@query("""SELECT conv_id, turn, (coalesce(l1=role AND a1=a, false) OR coalesce(l1=role AND l2=role, false)) AS repeated FROM (SELECT *, lag(role) OVER w AS l1, lag(role,2) OVER w AS l2, lag(a) OVER w AS a1 FROM (
SELECT *, lower(substr(text,1,2)) AS a FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""")
def q_stagnation(spark, sf_dir):
    steps = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("step"), F.col("role").alias("tool"), F.substring("text", 1, 2).alias("args"), F.col("text").alias("content"))
    return dialog.stagnation(steps).select(F.col("run_id").alias("conv_id"), F.col("step").alias("turn"), "repeated")


FX_ERRORS = [(1, "Request timed out"), (2, "HTTP 401 Unauthorized"), (3, "429 too many"), (4, "Network down"), (5, "bad JSON"), (6, "odd")]


@query(f"SELECT id::BIGINT AS id, code FROM {values('id,code', [(1, 'LLM_TIMEOUT'), (2, 'LLM_API_KEY_INVALID'), (3, 'LLM_RATE_LIMIT'), (4, 'LLM_NETWORK'), (5, 'LLM_PARSE_ERROR'), (6, 'UNKNOWN')])}")
def q_error_class(spark, sf_dir):
    return fixture(spark, "id long, message string", FX_ERRORS).select("id", classify.error_class(F.col("message")).alias("code"))


# entities

FX_ENTITIES = [(1, "合同金额100,000元,定金¥5万,签于2024年1月15日,以下简称“甲方”"), (2, "on 2024-03-20 and 2024/13/01 and 1999.12.31, hereinafter \"Buyer\" 500万元"), (3, "~~old~~ [新增：new] [删除：x]"), (4, "nothing"), (5, "合计人民币伍佰万元整;报酬为 200,000;RMB 3万元;US$ 12.5;￥1，000")]
_CAPITAL = [("伍佰万元整", 5e6)]


_AMOUNTS = " UNION ALL ".join(
    f"SELECT doc_id, trim(raw) AS raw, regexp_extract(raw, {lit(p)}, 1) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, {lit(p)})) AS raw FROM {values('doc_id,text', FX_ENTITIES)})" for p in entities.AMOUNT_FORMS
)


@query(f"""SELECT * FROM (SELECT DISTINCT doc_id::BIGINT AS doc_id, raw, coalesce(c.v, try_cast(regexp_replace(regexp_extract(n, '^[0-9,，.]+'), '[,，]', '', 'g') AS DOUBLE) * CASE WHEN contains(n,'亿') THEN 1e8 WHEN contains(n,'万') THEN 1e4 ELSE 1 END)::DOUBLE AS value
FROM ({_AMOUNTS}) a LEFT JOIN {values('t,v', _CAPITAL).replace(' AS t(', ' AS c(')} ON c.t=a.n) WHERE value>0""")
def q_amounts(spark, sf_dir):
    return entities.amounts(fixture(spark, "doc_id long, text string", FX_ENTITIES))


@query(f"SELECT doc_id::BIGINT AS doc_id, raw, normalized FROM {values('doc_id,raw,normalized', [(1, '2024年1月15日', '2024-01-15'), (2, '2024-03-20', '2024-03-20'), (2, '1999.12.31', '1999-12-31')])}")
def q_dates(spark, sf_dir):
    return entities.dates(fixture(spark, "doc_id long, text string", FX_ENTITIES))


@query(f"SELECT doc_id::BIGINT AS doc_id, term FROM {values('doc_id,term', [(1, '甲方'), (2, 'Buyer')])}")
def q_definitions(spark, sf_dir):
    return entities.definitions(fixture(spark, "doc_id long, text string", FX_ENTITIES))


@query(f"SELECT doc_id::BIGINT AS doc_id, kind, content FROM {values('doc_id,kind,content', [(3, 'delete', 'old'), (3, 'insert', 'new'), (3, 'delete', 'x')])}")
def q_revisions(spark, sf_dir):
    return entities.revisions(fixture(spark, "doc_id long, text string", FX_ENTITIES))


FX_CAPITALS = [(1, "伍佰万元整", 5e6, 5e6), (2, "壹拾贰万元", 1.2e5, 1.2e5), (3, "叁仟贰佰元", 3200.0, 200.0), (4, "玖元", 9.0, 9.0), (5, "拾万元", 1e5, 1e5)]


@query(f"SELECT id::BIGINT AS id, strict::DOUBLE AS strict, compat::DOUBLE AS compat FROM {values('id,text,strict,compat', FX_CAPITALS)}")
def q_capital_numbers(spark, sf_dir):
    df = fixture(spark, "id long, text string, s double, c double", FX_CAPITALS)
    return df.select("id", entities.capital_number(F.col("text")).alias("strict"), entities.capital_number(F.col("text"), strict=False).alias("compat"))


@query()
def q_signatures(spark, sf_dir):
    rows = [(1, "合同\n甲方:某公司\n盖章\n乙方:李四\n\n\n日期")]
    return entities.signature_lines(fixture(spark, "doc_id long, text string", rows), ["甲方", "乙方"], ["盖章", "签字"])


# sources and reports


@query()
def q_html_text(spark, sf_dir):
    return files.pages_text(table(spark, sf_dir, "pages"))


_MD = f"CASE risk_level WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'low' THEN 1 ELSE 2 END"
_HEAD = "||', '||".join(f"'{x} '||count(*) FILTER (risk_level='{x}')" for x in LEVELS)


@query(f"""SELECT doc_id, '# Risks'||chr(10)||{_HEAD}||chr(10)||string_agg('- ['||risk_level||'] '||name||' ('||category||')', chr(10) ORDER BY {_MD} DESC, ord) AS report FROM ({RULES_SQL}) GROUP BY doc_id""")
def q_report(spark, sf_dir):
    return report.markdown(_risks(spark, sf_dir))


@query(f"SELECT doc_id, ord::BIGINT AS ord, '<tr><td>'||risk_level||'</td><td>'||name||'</td><td>'||category||'</td></tr>' AS html FROM ({RULES_SQL})")
def q_report_html(spark, sf_dir):
    return report.html_rows(_risks(spark, sf_dir)).withColumn("ord", F.col("ord").cast("long"))


# contracts

FX_CONTRACT = [
    (1, "房屋租赁合同\n甲方：北京某某科技有限公司\n法定代表人：张三\n乙方（承租方）：李四\n地址：北京市海淀区中关村大街1号。\n争议提交北京仲裁委员会。\n本合同适用中华人民共和国民法。"),
    (2, "plain text"),
    (3, None),
    (4, "甲方：王\n甲方：上海某公司\n出租方：某物业，代表\n由被告所在地人民法院管辖"),
]


@query(f"SELECT doc_id::BIGINT AS doc_id, contract_name, contract_type, dispute, governing_law, addresses FROM {values('doc_id,contract_name,contract_type,dispute,governing_law,addresses', [(1, '房屋租赁合同', '租赁合同', '提交北京仲裁', '中华人民共和国民法', '北京市海淀区中关村大街1号'), (2, None, None, None, None, ''), (3, None, None, None, None, ''), (4, None, None, '由被告所在地人民法院管辖', None, '')])}")
def q_metadata(spark, sf_dir):
    rows = metadata.contract_metadata(fixture(spark, "doc_id long, text string", FX_CONTRACT))
    return rows.select("doc_id", "contract_name", "contract_type", "dispute", "governing_law", F.array_join("addresses", "|").alias("addresses"))


@query(f"SELECT doc_id::BIGINT AS doc_id, role, name, representative FROM {values('doc_id,role,name,representative', [(1, '甲方', '北京某某科技有限公司', '张三'), (1, '乙方', '李四', None), (4, '甲方', '上海某公司', None), (4, '出租方', '某物业', None)])}")
def q_parties(spark, sf_dir):
    rows = metadata.contract_metadata(fixture(spark, "doc_id long, text string", FX_CONTRACT))
    return rows.select("doc_id", F.explode("parties").alias("p")).select("doc_id", "p.*")


FX_DATES = [(1, "签订日期：2024年1月15日"), (2, "二〇二四年三月十五日 起"), (3, "自合同签订之日起30日内付款"), (4, "2024-13-01 及 2024-12-01 交付日期 2024-12-01")]


@query(f"SELECT doc_id::BIGINT AS doc_id, raw, start_pos::BIGINT AS start_pos, normalized, role FROM {values('doc_id,raw,start_pos,normalized,role', [(1, '2024年1月15日', 5, '2024-01-15', '签署日期'), (2, '二〇二四年三月十五日', 0, '2024-03-15', None), (3, '自合同签订之日起30日内', 0, 'relative:30日内', '签署日期'), (4, '2024-12-01', 13, '2024-12-01', '交货日期')])}")
def q_date_roles(spark, sf_dir):
    return entities.date_mentions(fixture(spark, "doc_id long, text string", FX_DATES))


FX_PAIRED = [(1, "总价500万元（大写：伍佰万元整）"), (2, "100元（大写：人民币贰佰元整）"), (3, "nothing"), (4, None)]


@query(f"SELECT doc_id::BIGINT AS doc_id, lower, upper, consistent=1 AS consistent FROM {values('doc_id,lower,upper,consistent', [(1, '500万', '伍佰万', 1), (2, '100', '贰佰', 0)])}")
def q_amount_pairs(spark, sf_dir):
    return entities.amount_pairs(fixture(spark, "doc_id long, text string", FX_PAIRED))


FX_SIGNED = [(1, 1, "甲方", 1, 0, 0), (1, 2, "甲方", 1, 1, 0), (1, 3, "甲方", 0, 1, 1), (1, 4, "乙方", 0, 0, 0), (2, 1, "甲方", 0, 0, 1)]


@query(f"SELECT doc_id::BIGINT AS doc_id, role, ord::BIGINT AS ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, role ORDER BY a+b+c DESC, ord) AS rn FROM {values('doc_id,ord,role,a,b,c', FX_SIGNED)}) WHERE rn=1")
def q_signature_dedup(spark, sf_dir):
    df = fixture(spark, "doc_id long, ord long, role string, a int, b int, c int", FX_SIGNED)
    marks = [F.col(x).cast("boolean").alias(n) for x, n in (("a", "has_signature"), ("b", "has_seal"), ("c", "has_riding_seal"))]
    return entities.richest_signatures(df.select("doc_id", "ord", "role", *marks)).select("doc_id", "role", "ord")


FX_DEFINED = [(1, "某公司,以下简称“买方公司”,买方公司付款,以下简称“一”"), (2, "hereinafter \"Goods\" only")]
FX_DEFINED_CLAUSES = [(1, 1, "甲", "买方公司付款"), (1, 2, "乙", "其他"), (1, 3, "买方公司", "x")]


@query(f"SELECT doc_id::BIGINT AS doc_id, term, n_mentions::BIGINT AS n_mentions, clause_ids FROM {values('doc_id,term,n_mentions,clause_ids', [(1, '买方公司', 2, '1|3')])}")
def q_definition_refs(spark, sf_dir):
    rows = entities.definition_references(fixture(spark, "doc_id long, text string", FX_DEFINED), fixture(spark, "doc_id long, clause_id long, title string, content string", FX_DEFINED_CLAUSES))
    return rows.withColumn("clause_ids", F.array_join("clause_ids", "|"))


FX_TERMS = {"license": ["licensed under", "license"], "contact": ["@mail", "555-"], "mark": ["***"]}


@query(" UNION ALL ".join(f"SELECT doc_id, {lit(t)} AS term FROM documents WHERE " + " OR ".join(f"contains(lower(text),{lit(w)})" for w in ws) for t, ws in FX_TERMS.items()))
def q_terms_in(spark, sf_dir):
    return entities.terms_in(table(spark, sf_dir, "documents"), FX_TERMS)


# tables and pages

FX_HTML = [
    (1, "<table><tr><th>a</th><th colspan=2>b<br>c</th></tr><tr><td rowspan='2'> x </td><td>y<table><tr><td>in</td></tr></table></td></tr></table>"),
    (2, "<p>none</p>"), (3, None), (4, "<TABLE><tr><td rowspan=odd>z</td></tr></TABLE>"), (5, "<table><tr></tr><tr><td>q &amp; r</td></tr></table>"),
]
_CELLS = [(1, 0, 0, "a", 1, 1, True), (1, 0, 1, "b\nc", 1, 2, True), (1, 1, 0, "x", 2, 1, False), (1, 1, 1, "y[嵌套表格]", 1, 1, False), (5, 0, 0, "q & r", 1, 1, False)]


@query(f"SELECT page_id::BIGINT AS page_id, r::BIGINT AS row, c::BIGINT AS col, content, rs::BIGINT AS row_span, cs::BIGINT AS col_span, h AS is_header FROM {values('page_id,r,c,content,rs,cs,h', _CELLS)}")
def q_html_tables(spark, sf_dir):
    return tables.html_cells(fixture(spark, "page_id long, html string", FX_HTML))


@query(f"SELECT id::BIGINT AS id, body, heads::BIGINT AS heads FROM {values('id,body,heads', [(1, chr(10).join(['a | b', 'c']), 2), (2, '', 0)])}")
def q_grid_cells(spark, sf_dir):
    df = fixture(spark, "id long, grid array<array<string>>", [(1, [["a", "b"], [" ", None], ["c", ""]]), (2, [])])
    cells = df.select("id", tables.grid_cells(F.col("grid")).alias("rows"))
    heads = F.aggregate("rows", F.lit(0), lambda n, row: n + F.size(F.filter(row, lambda c: c["is_header"])))
    return cells.select("id", tables.table_text(F.col("rows")).alias("body"), heads.cast("long").alias("heads"))


FX_ALIGNED = [
    (1, 0, 0, 10.0, 10.0, "Name"), (1, 0, 1, 200.0, 12.0, "Value"), (1, 0, 2, 11.0, 50.0, "x"), (1, 0, 3, 201.0, 51.0, "1"), (1, 0, 4, 205.0, 55.0, "2"), (1, 0, 5, 90.0, 90.0, " "),
    (2, 0, 0, 10.0, 10.0, "a"), (2, 0, 1, 10.0, 30.0, "b"), (2, 0, 2, 10.0, 50.0, "c"), (2, 0, 3, 10.0, 70.0, "d"), (3, 0, 0, 1.0, 1.0, "few"),
]
_ALIGNED = [(1, 0, 0, "Name", True), (1, 0, 1, "Value", True), (1, 1, 0, "x", False), (1, 1, 1, "1\n2", False)]


@query(f"SELECT doc_id::BIGINT AS doc_id, r::BIGINT AS row, c::BIGINT AS col, content, h AS is_header FROM {values('doc_id,r,c,content,h', _ALIGNED)}")
def q_borderless(spark, sf_dir):
    df = fixture(spark, "doc_id long, page_index int, ord int, x1 double, y1 double, content string", FX_ALIGNED).withColumns({"page_width": F.lit(600.0), "page_height": F.lit(1000.0)})
    return tables.borderless(df).drop("page_index")


FX_FOUND = [(1, 0, 0, "p"), (1, 0, 1, "p"), (2, 0, 0, "p")]
FX_MORE = [(1, 0, 0, "s"), (1, 0, 2, "s"), (2, 0, 0, "s"), (3, 0, 0, "s")]


@query(f"SELECT doc_id::BIGINT AS doc_id, i::BIGINT AS table_index, source FROM (SELECT * FROM {values('doc_id,p,i,source', FX_FOUND)} UNION ALL SELECT * FROM {values('doc_id,p,i,source', FX_MORE).replace('AS t(', 'AS s(')} WHERE i>=(SELECT count(*) FROM {values('doc_id,p,i,source', FX_FOUND).replace('AS t(', 'AS f(')} WHERE f.doc_id=s.doc_id AND f.p=s.p))")
def q_table_merge(spark, sf_dir):
    schema = "doc_id long, page_index long, table_index long, source string"
    return tables.merged_sources(fixture(spark, schema, FX_FOUND), fixture(spark, schema, FX_MORE)).drop("page_index")


FX_BROKEN = [
    (1, 0, 0, "a", "text", "The buyer shall "), (1, 0, 1, "f", "footer", "1"), (1, 1, 0, "b", "text", " pay the"), (1, 2, 0, "c", "text", "price."), (1, 2, 1, "d", "text", "Then"), (1, 3, 0, "e", "text", "more."),
    (2, 0, 0, "a", "text", "ends."), (2, 1, 0, "b", "text", "Next"), (2, 2, 0, "c", "title", "第二条 价款"), (5, 0, 0, "a", "text", "goods are"), (5, 1, 0, "b", "text", "违约责任由双方承担"), (3, 0, 0, "a", "text", "cut"), (3, 1, 0, "t", "table", "x | y"), (3, 2, 0, "b", "text", "off"), (4, 0, 0, "a", "text", None),
]
_JOINED = [(1, "a", "The buyer shallpay the"), (1, "f", "1"), (1, "c", "price."), (1, "d", "Thenmore."), (2, "a", "ends."), (2, "b", "Next"), (2, "c", "第二条 价款"), (5, "a", "goods are"), (5, "b", "违约责任由双方承担"), (3, "a", "cut"), (3, "t", "x | y"), (3, "b", "off"), (4, "a", None)]


def _broken(spark):
    return fixture(spark, "doc_id long, page_index int, ord int, block_id string, block_type string, content string", FX_BROKEN)


@query(f"SELECT doc_id::BIGINT AS doc_id, block_id, content FROM {values('doc_id,block_id,content', _JOINED)}")
def q_cross_page(spark, sf_dir):
    return layout.joined_pages(_broken(spark)).select("doc_id", "block_id", "content")


@query(f"SELECT doc_id::BIGINT AS doc_id, string_agg(trim(content), chr(10) ORDER BY p, o) AS text FROM {values('doc_id,p,o,block_id,block_type,content', FX_BROKEN)} WHERE block_type IN ('text','title','table') AND trim(content)<>'' GROUP BY doc_id")
def q_block_text(spark, sf_dir):
    return layout.document_text(_broken(spark))


# model responses

FX_RESPONSES = [
    (1, '```json\n[{"name": "late", "risk_level": "high", "confidence": 0.9}, 5, {"name": "odd", "risk_level": "worst", "confidence": 7}]\n```'),
    (2, 'Here: {"risks": [{"name": "venue", "category": "law", "clause_preview": "court of the seller"}]} done'),
    (3, "no JSON"), (4, ""), (5, None), (6, '{"name": "one", "confidence": "0.2", "risk_level": "low"}'), (7, "{broken"),
]
_REPAIRED = [(1, "LLM_RISK_001", "late", "其他风险", "high", 0.9), (1, "LLM_RISK_003", "odd", "其他风险", "medium", 0.7), (2, "LLM_RISK_001", "venue", "law", "medium", 0.7), (6, "LLM_RISK_001", "one", "其他风险", "low", 0.7)]


def _responses(spark):
    return fixture(spark, "doc_id long, response string", FX_RESPONSES)


@query(f"SELECT doc_id::BIGINT AS doc_id, id, name, category, risk_level, confidence::DOUBLE AS confidence FROM {values('doc_id,id,name,category,risk_level,confidence', _REPAIRED)}")
def q_model_findings(spark, sf_dir):
    return responses.model_findings(_responses(spark)).select("doc_id", "id", "name", "category", "risk_level", "confidence")


@query(f"SELECT doc_id::BIGINT AS doc_id, n::BIGINT AS n_chars FROM {values('doc_id,n', [(1, len(FX_RESPONSES[0][1]) - 12), (2, len(FX_RESPONSES[1][1]) - len('Here: ' + ' done')), (3, None), (4, None), (5, None), (6, len(FX_RESPONSES[5][1])), (7, None)])}")
def q_json_extract(spark, sf_dir):
    return _responses(spark).select("doc_id", F.length(responses.extracted_json("response")).cast("long").alias("n_chars"))


@query(f"SELECT doc_id::BIGINT AS doc_id, rule_id, name FROM {values('doc_id,rule_id,name', [(1, 'LLM_ANALYSIS', 'late'), (1, 'LLM_ANALYSIS', 'odd'), (1, 'R1', 'late'), (2, 'LLM_ANALYSIS', 'venue'), (6, 'LLM_ANALYSIS', 'one')])}")
def q_risk_merge(spark, sf_dir):
    ruled = fixture(spark, "doc_id long, ord int, rule_id string, name string, category string, risk_level string, confidence double", [(1, 1, "R1", "late", "c", "low", 0.5), (1, 2, "R1", "late", "c", "low", 0.4)])
    return responses.merged(ruled, responses.model_findings(_responses(spark))).select("doc_id", "rule_id", "name")


FX_ARGUMENTS = [(1, '{"query":"x"}'), (2, "plain"), (3, "[1]"), (4, None)]


@query(f"SELECT id::BIGINT AS id, arguments FROM {values('id,arguments', [(1, chr(123) + chr(34) + 'query' + chr(34) + ':' + chr(34) + 'x' + chr(34) + chr(125)), (2, '{\"raw\":\"plain\"}'), (3, '{\"raw\":\"[1]\"}'), (4, '{\"raw\":\"\"}')])}")
def q_tool_arguments(spark, sf_dir):
    return fixture(spark, "id long, arguments string", FX_ARGUMENTS).select("id", responses.tool_arguments(F.col("arguments")).alias("arguments"))


# differences and traces


def _turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("following")).where("following is not null")


@query()
def q_indel_ratio(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(indel_ratio("text", "following"), 6).alias("ratio"))


@query()
def q_line_diff(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.md5(difference("text", "following")).alias("html_md5"))


FX_REVISED = [
    (1, 1, "late", "high", "pay within ninety days", "pay within thirty days"), (1, 2, "a < b", "critical", "same text here", "same text here"), (1, 3, "short", "high", "short", "long"), (2, 1, "none", "low", "preview of a clause", ""),
]


@query(f"SELECT doc_id::BIGINT AS doc_id, removed::BIGINT AS removed, added::BIGINT AS added, same::BIGINT AS same FROM {values('doc_id,removed,added,same', [(1, 1, 1, 1)])}")
def q_redline(spark, sf_dir):
    df = fixture(spark, "doc_id long, ord int, name string, risk_level string, clause_preview string, suggestion string", FX_REVISED)
    html = redline.document_differences(redline.revisions(df))
    return html.select("doc_id", *[occurrences(F.col("html"), F.lit(w)).alias(n) for w, n in (("diff-removed", "removed"), ("diff-added", "added"), ("无差异", "same"))])


@query(f"""SELECT c.doc_id, c.clause_id, count(t.ord) AS n_risks, arg_max(r.risk_level, {_RANK.replace('risk_level', 'r.risk_level')}) AS top_level FROM ({_CLAUSES}) c
LEFT JOIN ({ORACLE_SQL['q_risk_trace']}) t ON t.doc_id=c.doc_id AND t.linked_clause=c.clause_id LEFT JOIN ({RULES_SQL}) r ON r.doc_id=t.doc_id AND r.ord=t.ord GROUP BY 1, 2""")
def q_clause_trace(spark, sf_dir):
    found = _risks(spark, sf_dir).select("doc_id", F.col("ord").cast("long").alias("ord"), "name", "risk_level")
    linked = q_risk_trace(spark, sf_dir).join(found, ["doc_id", "ord"])
    return redline.clause_trace(_clauses(spark, sf_dir), linked).select("doc_id", "clause_id", "n_risks", "top_level")


_STEPS = [("mark", ["***", "&&&"]), ("number", ["1", "2"])]


@query(f"SELECT conv_id, turn, CASE {' '.join('WHEN ' + ' OR '.join(f'contains(lower(text),{lit(w)})' for w in ws) + f' THEN {lit(n)}' for n, ws in _STEPS)} ELSE 'other' END AS kind FROM conversations")
def q_step_log(spark, sf_dir):
    steps = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("step"), F.col("text").alias("content"))
    return redline.step_log(steps, _STEPS).select(F.col("run_id").alias("conv_id"), F.col("step").alias("turn"), "kind")


@query(f"SELECT t.doc_id::BIGINT AS doc_id, t.ord::BIGINT AS ord, t.parent::BIGINT AS parent, (SELECT count(*) FROM {values('doc_id,ord,level,number,parent', _TREE).replace('AS t(', 'AS c(')} WHERE c.doc_id=t.doc_id AND c.parent=t.ord) AS n_children FROM {values('doc_id,ord,level,number,parent', _TREE)}")
def q_clause_flat(spark, sf_dir):
    tree = structure.clause_tree(fixture(spark, "doc_id long, ord long, title string", FX_TITLES)).withColumn("content", F.col("title"))
    return redline.flattened(tree).select("doc_id", "ord", "parent", "n_children")


# more searches

_LOCAL = f"SELECT q.id, k.ord, q.query, k.txt, len(list_intersect({_grams_sql('q.query')}, {_grams_sql('k.txt')}))/len({_grams_sql('q.query')})::DOUBLE AS c FROM {values('id,query', ASKED).replace(' AS t(', ' AS q(')}, (SELECT ord, lower(concat_ws(' ', law, title, content)) AS txt FROM {values(KB_NAMES, KB)}) k"


@query(f"""SELECT id::BIGINT AS query_id, ord::BIGINT AS ord, round(s,3) AS score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s,3) DESC, ord) AS rank FROM (
SELECT id, ord, CASE WHEN contains(txt, lower(query)) THEN 0.9 WHEN c>=0.5 THEN 0.4+0.4*c WHEN c>0 THEN 0.5*c END::DOUBLE AS s FROM ({_LOCAL.replace('q.query)', 'lower(q.query))')})) WHERE s IS NOT NULL) WHERE rank<=5""")
def q_local_search(spark, sf_dir):
    asked, _, kb = _asked(spark)
    return retrieval.local_search(asked, kb)


FX_CORRECTED = [(1, "the buyer pays late fees each month", "late fee"), (2, "the buyer pays late fees each week", "late fee"), (3, "venue of the court", "venue"), (4, "", "late fee"), (5, None, None)]
FX_CLAUSES_ASKED = [(1, "the buyer pays late fees each month", "venue"), (2, "zzzz", "late"), (3, "qqqq", "")]


@query(f"SELECT query_id::BIGINT AS query_id, ord::BIGINT AS ord, why, rank::BIGINT AS rank FROM {values('query_id,ord,why,rank', [(1, 1, 'text', 1), (1, 2, 'text', 2), (1, 3, 'text', 3), (2, 4, 'risk', 1), (2, 2, 'risk', 2), (2, 1, 'risk', 3)])}")
def q_corrections(spark, sf_dir):
    asked = fixture(spark, "query_id long, clause string, risk_name string", FX_CLAUSES_ASKED)
    return retrieval.corrections(asked, fixture(spark, "ord long, clause_text string, risk_name string", FX_CORRECTED)).drop("score")


FX_CITED = [(1, "《民法典》第五百条"), (2, "(2020)京01号"), (3, "nothing"), (4, "《旧法》第一条")]
FX_LAWS = [("民法典", "第五百条", "民法典第五百条", "active", "2024-01-01"), ("旧法", "第九条", "旧法第九条", "repealed", "2026-08-01"), ("新法", "第二条", "新法第二条", "active", "2026-08-01")]
FX_CASES = [("(2020)京01号", "甲案", "active", "2020-01-01"), ("(2021)沪02号", "乙案", "active", None)]
_AGE = "date_diff('day', last_verified::DATE, DATE '2026-09-01')"


@query(f"""SELECT id::BIGINT AS cited_id, item_type, name, status, days::BIGINT AS days, severity FROM (
SELECT c.id, 'provision' AS item_type, p.name, p.status, {_AGE} AS days, CASE WHEN p.status<>'active' THEN 'critical' WHEN {_AGE}>180 THEN 'warning' END AS severity FROM {values('id,item', FX_CITED).replace('AS t(', 'AS c(')} JOIN {values('law,article,name,status,last_verified', FX_LAWS).replace('AS t(', 'AS p(')} ON contains(c.item,p.law) OR contains(c.item,p.article)
UNION ALL SELECT c.id, 'case', k.name, k.status, {_AGE}, CASE WHEN {_AGE}>180 THEN 'warning' END FROM {values('id,item', FX_CITED).replace('AS t(', 'AS c(')} JOIN {values('case_number,name,status,last_verified', FX_CASES).replace('AS t(', 'AS k(')} ON contains(c.item,k.case_number)) WHERE severity IS NOT NULL""")
def q_freshness_cited(spark, sf_dir):
    laws = fixture(spark, "law string, article string, name string, status string, last_verified string", FX_LAWS)
    cases = fixture(spark, "case_number string, name string, status string, last_verified string", FX_CASES)
    return retrieval.cited_freshness(fixture(spark, "cited_id long, item string", FX_CITED), laws, cases, "2026-09-01")


@query("SELECT user_id, updated, row_number() OVER (ORDER BY updated DESC, user_id) AS rank FROM (SELECT user_id, max(ts) AS updated FROM events GROUP BY 1) WHERE updated >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7200 SECOND ORDER BY updated DESC, user_id LIMIT 50")
def q_live_sessions(spark, sf_dir):
    return dialog.live_sessions(table(spark, sf_dir, "events"), "2024-01-20 00:00:00", 7200, 50)


# Word files


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')))::BIGINT AS n_lines FROM documents")
def q_word_round_trip(spark, sf_dir):
    written = word.word_files(table(spark, sf_dir, "documents"))
    return files.docx_texts(written).select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: x != "")).cast("long").alias("n_lines"))
