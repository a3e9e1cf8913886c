"""Queries of the layout, table, response and freshness operators over rows of the shop's tables.

Pages, tables, blocks, model responses and reference items are put together by
Spark from ``lineitem``, ``orders`` and ``events``; the SQL works the answers
out from the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspan.catalogue_contracts import _CLAUSE_ROWS, _titles
from lexspan.operators import dialog, pages, redline, responses, rules, structure, tables
from lexspan.registry import query, table
from lexspan.tables import dealt, written

_LINES = """(select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity, l_extendedprice) as n,
    l_linenumber as line, l_partkey as part, l_quantity::int as quantity, l_discount as discount, l_returnflag as flag from lineitem)"""


def _lines(spark, sf_dir) -> DataFrame:
    """The lines of orders, numbered from 1; an order has few. What follows by order stays in the tasks that the lines are dealt to."""
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    rows = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("n", F.row_number().over(own).cast("long"))
    return rows.select(F.col("l_orderkey").alias("doc_id"), "n", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"))


def _in_order(rows: DataFrame, value, name: str) -> DataFrame:
    """(doc_id, array of the lines' values in order)."""
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", value.alias("v")))).alias("x"))
    return lists.select("doc_id", F.transform("x", lambda x: x["v"]).alias(name))


@query(f"""
    select doc_id as page_id, n as row, c as col, case c when 0 then line::varchar when 1 then part::varchar else quantity::varchar end as content, 1::bigint as row_span, 1::bigint as col_span, false as is_header
    from {_LINES}, (values (0::bigint), (1), (2)) as t(c)
    union all select distinct doc_id, 0, c, case c when 0 then 'line' else 'part & size' end, 1, case c when 0 then 1 else 2 end, true from {_LINES}, (values (0::bigint), (1)) as t(c)""")
def q_order_tables(spark, sf_dir):
    """Cells of a page with a table of each order's lines."""
    row = F.concat(F.lit("<tr><td>"), "line", F.lit("</td><td> "), "part", F.lit("</td><td rowspan=\"1\">"), "quantity", F.lit("</td></tr>"))
    rows = _in_order(_lines(spark, sf_dir), row, "rows")
    head = '<html><body><p>order</p><table><tr><th>line</th><th colspan="2">part &amp; size</th></tr>'
    return tables.html_cells(rows.select(F.col("doc_id").alias("page_id"), F.concat(F.lit(head), F.array_join("rows", ""), F.lit("</table></body></html>")).alias("html")))


@query(f"""
    select doc_id, 'line | part' || chr(10) || string_agg(line || case when flag = 'N' then '' else ' | ' || part end, chr(10) order by n) as text from {_LINES} group by doc_id""")
def q_order_grid(spark, sf_dir):
    """A grid of each order's lines as text; a cell without a part is left out."""
    row = F.array(F.concat(F.lit(" "), "line"), F.when(F.col("flag") != "N", F.col("part").cast("string")))
    grids = _in_order(_lines(spark, sf_dir), row, "grid").withColumn("grid", F.concat(F.array(F.array(F.lit("line"), F.lit("part"))), F.col("grid")))
    return grids.select("doc_id", tables.table_text(tables.grid_cells(F.col("grid"))).alias("text"))


def _blocks(spark, sf_dir) -> DataFrame:
    """Two blocks of text a page; those of lines that are flagged N end a sentence."""
    page = F.floor((F.col("n") - 1) / 2).cast("int")
    content = F.concat(F.lit("part "), "part", F.when(F.col("flag") == "N", "。").otherwise(","))
    return _lines(spark, sf_dir).select("doc_id", page.alias("page_index"), F.col("n").cast("int").alias("ord"), F.col("n").cast("string").alias("block_id"), F.lit("text").alias("block_type"), content.alias("content"))


@query(f"""
    select doc_id, n::varchar as block_id, content || case when n % 2 = 0 and flag <> 'N' then coalesce(after, '') else '' end as content from (
        select *, lead(content) over w as after, lag(flag) over w as before from (select *, 'part ' || part || case when flag = 'N' then '。' else ',' end as content from {_LINES})
        window w as (partition by doc_id order by n)
    ) where not (n % 2 = 1 and n > 1 and before <> 'N')""")
def q_order_pages(spark, sf_dir):
    """Blocks of pages, where a sentence that a page cuts is joined."""
    return pages.joined_pages(_blocks(spark, sf_dir)).select("doc_id", "block_id", "content")


@query(f"select doc_id, string_agg('part ' || part || case when flag = 'N' then '。' else ',' end, chr(10) order by n) as text, round(avg(discount), 6) as confidence from {_LINES} group by doc_id")
def q_order_text(spark, sf_dir):
    """The blocks of a document as its text, with their mean confidence."""
    text = pages.document_text(_blocks(spark, sf_dir))
    sure = pages.mean_confidence(_lines(spark, sf_dir).select("doc_id", F.col("discount").alias("confidence")))
    return text.join(sure, "doc_id").withColumn("confidence", F.round("confidence", 6))


_LEVEL = "case when quantity > 40 then 'critical' when quantity > 25 then 'high' when quantity > 10 then 'medium' else 'low' end"
_RANK = "case when quantity > 40 then 4 when quantity > 25 then 3 when quantity > 10 then 2 else 1 end"


@query(f"""
    select doc_id, min(n) over (partition by doc_id, flag) as place, flag as rule_id, {_LEVEL} as risk_level from {_LINES}
    qualify row_number() over (partition by doc_id, flag order by {_RANK} desc, n) = 1""")
def q_order_dedup(spark, sf_dir):
    """An order's lines as findings of their flag's rule; the highest level stays, in the first one's place."""
    risks = _lines(spark, sf_dir).select("doc_id", F.col("n").alias("ord"), F.col("flag").alias("rule_id"), F.lit("x").alias("name"), F.expr(_LEVEL).alias("risk_level"))
    return rules.deduplicated(risks).select("doc_id", "place", "rule_id", "risk_level")


@query("""
    select o_orderkey as doc_id, 'LLM_RISK_00' || n as id, case n when 1 then o_orderpriority else '未知风险' end as name, case when n = 1 and o_orderstatus = 'F' then 'high' when n = 1 and o_orderstatus = 'P' then 'low' else 'medium' end as risk_level,
        case n when 1 then (o_orderkey % 10) / 10.0 else 0.7 end as confidence
    from orders, (values (1), (3)) as t(n)""")
def q_order_findings(spark, sf_dir):
    """Findings of a model's response about each order; a level or confidence that is none is repaired."""
    level = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "P", "low").otherwise("worst")
    body = F.concat(F.lit('[{"name": "'), "o_orderpriority", F.lit('", "risk_level": "'), level, F.lit('", "confidence": 0.'), F.col("o_orderkey") % 10, F.lit('}, 5, {"confidence": 7}]'))
    fence = F.col("o_orderkey") % 2 == 0
    response = F.when(fence, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone."))).otherwise(F.concat(F.lit('Here: {"risks": '), body, F.lit("} and {more")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), response.alias("response"))
    return responses.model_findings(orders).select("doc_id", "id", "name", "risk_level", "confidence")


@query("""
    select event_id, case event_id % 3 when 0 then replace(props, ' ', '') when 1 then '{"raw":"call ' || replace(props, '"', '\\"') || '"}' else '{"raw":"[1]"}' end as arguments from events""")
def q_event_arguments(spark, sf_dir):
    """H7: properties of events as arguments of a call."""
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("call "), "props")).otherwise("[1]")
    return table(spark, sf_dir, "events").select("event_id", responses.tool_arguments(text).alias("arguments"))


_ITEMS = """(select case when o_custkey % 3 = 0 then 'case' else 'provision' end as item_type, 'o' || o_orderkey as name, case o_orderstatus when 'F' then 'repealed' when 'P' then 'amended' else 'active' end as status,
    date_diff('day', o_orderdate::date, date '1998-12-31') as days from orders)"""
_CHECKED = f"(select *, case when status = 'repealed' or days > 365 then 'critical' when days > 180 then 'warning' end as severity from {_ITEMS})"


def _checked(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("o_custkey") % 3 == 0, "case").otherwise("provision")
    status = F.when(F.col("o_orderstatus") == "F", "repealed").when(F.col("o_orderstatus") == "P", "amended").otherwise("active")
    items = table(spark, sf_dir, "orders").select(kind.alias("item_type"), F.concat(F.lit("o"), "o_orderkey").alias("name"), status.alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_verified"))
    return dialog.freshness(items, "1998-12-31")


@query(f"select item_type, name, status, days::bigint as days, severity from {_CHECKED}")
def q_order_freshness(spark, sf_dir):
    """A3: orders as reference items, by when they were made."""
    return _checked(spark, sf_dir).select("item_type", "name", "status", "days", "severity")


@query(f"""
    select count(*) as total, count(*) filter (status = 'active') as active, count(*) filter (status = 'amended') as amended, count(*) filter (status = 'repealed') as repealed, count(*) filter (days > 365) as outdated,
        case when count(*) filter (severity = 'critical') > 0 then 'critical' when count(*) filter (days > 365) > 0.3 * count(*) then 'needs_review' else 'healthy' end as overall from {_CHECKED}""")
def q_order_freshness_report(spark, sf_dir):
    """A3: their state."""
    return dialog.freshness_report(_checked(spark, sf_dir))


@query(f"""
    select c.doc_id, c.ord, p.parent, coalesce(k.n, 0) as n_children from {_CLAUSE_ROWS} c
    left join (select doc_id, ord, case when rank <> 1 then max(case when rank = 1 then ord end) over (partition by doc_id order by ord) end as parent from {_CLAUSE_ROWS}) p on p.doc_id = c.doc_id and p.ord = c.ord
    left join (select doc_id, chapter, count(*) as n from (select doc_id, rank, max(case when rank = 1 then ord end) over (partition by doc_id order by ord) as chapter from {_CLAUSE_ROWS}) where rank <> 1 group by all) k
        on k.doc_id = c.doc_id and k.chapter = c.ord and c.rank = 1""")
def q_contract_flat(spark, sf_dir):
    """Clauses of contracts as a flat list with the number of their children."""
    # written, as the list meets the tree twice
    tree = written(structure.clause_tree(_titles(spark, sf_dir)), "tree").withColumn("content", F.col("title"))
    return redline.flattened(tree).select("doc_id", "ord", "parent", "n_children")
