"""Clause numbers and trees, layout order, scans and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: levels of clause numbers, and numerals
LEVEL = {"chapter": 1, "section": 2, "article": 3, "paragraph": 4, "subitem": 5, "item": 6}
CHINESE = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}


def _number(token: Column) -> Column:
    """Digits, or the first Chinese numeral from 一 to 十 in that order that the token contains."""
    out = F.lit(0)
    for c, n in reversed(CHINESE.items()):
        out = F.when(F.contains(token, F.lit(c)), F.lit(n)).otherwise(out)
    return F.when(token.rlike("^[0-9]+$"), token.try_cast("int")).otherwise(out)


def clause_number(title: Column) -> dict[str, Column]:
    """level and number of a title, null for one without number."""
    cn = "[一二三四五六七八九十百千0-9]+"
    sign = r"[.．、]"
    deep = [(n, name) for n, name in ((1, "paragraph"), (2, "subitem"), (3, "item"))]
    forms = [
        (f"^第({cn})章", "chapter"), (f"^第({cn})节", "section"), (f"^第({cn})条", "article"), (r"^Article\s+([0-9]*)", "article"), (r"^Section\s+([0-9]*)", "section"),
        (rf"^[0-9]+(?:\.[0-9]+){{3,}}\.([0-9]+)(?:\s|{sign})", "item"),
        *[(rf"^[0-9]+(?:\.[0-9]+){{{n - 1}}}\.([0-9]+)(?:\s|{sign})", name) for n, name in reversed(deep)], (rf"^([0-9]+){sign}", "article"),
        (f"^([一二三四五六七八九十]+){sign}", "article"), ("^[（(]([一二三四五六七八九十0-9]+)[）)]", "item"),
    ]
    title = F.trim(title)
    level, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    for p, name in reversed(forms):
        token = F.regexp_extract(title, p, 1)
        level, number = F.when(title.rlike(p), name).otherwise(level), F.when(title.rlike(p), _number(token)).otherwise(number)
    return {"level": level, "number": number}


def clause_tree(titles: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """Adjacency list: the parent of a numbered title is the nearest one before it of a higher level, of others the last numbered one.

    For each level the last place of that level is carried along; the parent is
    the greatest of those above. No recursion.
    """
    df = titles.withColumns(clause_number(F.col("title")))
    rank = F.lit(None).cast("int")
    for name, n in LEVEL.items():
        rank = F.when(F.col("level") == name, F.lit(n)).otherwise(rank)
    df = df.withColumn("rank", rank)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    lasts = {n: F.max(F.when(F.col("rank") == n, F.col(order))).over(before) for n in LEVEL.values()}
    parent = F.max(F.when(F.col("rank").isNotNull(), F.col(order))).over(before)
    for n in LEVEL.values():
        above = [lasts[m] for m in LEVEL.values() if m < n]
        if above:
            parent = F.when(F.col("rank") == n, F.greatest(*above) if len(above) > 1 else above[0]).otherwise(parent)
        else:
            parent = F.when(F.col("rank") == n, F.lit(None)).otherwise(parent)
    return df.withColumn("parent", parent.cast("long"))


def reading_order(blocks: DataFrame, page_width: str = "page_width") -> DataFrame:
    """blocks (doc_id, page_index, block_id, block_type, x1, y1, x2, y2) with columns and reading_order.

    A page has two columns where at least 4 text blocks have area, both halves
    hold 30 % of them and the medians of the halves are over 10 % of the width
    apart; the width is the page's, where blocks state it, else the largest x2. Headers first, footers last, content by column, then y, then x.
    """
    page = ["doc_id", "page_index"]
    p = Window.partitionBy(*page)
    text = F.col("block_type").isin("text", "title") & ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) > 0)
    width = F.col(page_width) if page_width in blocks.columns else F.max("x2").over(p)
    df = blocks.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "width": width, "text": text})
    df = df.withColumn("left", F.col("cx") < F.col("width") / 2)
    n, nl = F.count_if("text").over(p), F.count_if(F.col("text") & F.col("left")).over(p)
    # of an even number of centres the upper middle one
    middle = lambda mine: F.get(F.sort_array(v := F.collect_list(F.when(F.col("text") & mine, F.col("cx"))).over(p)), F.floor(F.size(v) / 2).cast("int"))
    ml, mr = middle(F.col("left")), middle(~F.col("left"))
    two = (n >= 4) & (nl >= 0.3 * n) & (n - nl >= 0.3 * n) & (mr - ml > 0.1 * F.col("width"))
    df = df.withColumn("n_columns", F.when(F.coalesce(two, F.lit(False)), 2).otherwise(1))
    kind = F.when(F.col("block_type") == "header", 0).when(F.col("block_type") == "footer", 3).when((F.col("n_columns") == 2) & ~F.col("left"), 2).otherwise(1)
    order = Window.partitionBy(*page).orderBy(kind, "y1", "x1", "block_id")
    return df.withColumn("reading_order", F.row_number().over(order) - 1).drop("cx", "width", "text", "left")


def scan_check(pages: DataFrame) -> DataFrame:
    """pages (doc_id, width, height, char_count, image_area) to is_scanned per document, by three rules in order."""
    area = F.sum(F.col("width") * F.col("height"))
    rows = pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"), (F.sum("char_count") / F.greatest(area / 1e4, F.lit(1.0))).alias("density"), (F.sum("image_area") / F.greatest(area, F.lit(1.0))).alias("image_ratio"),
        F.count_if(F.col("char_count") > 20).alias("text_pages"), F.count_if(F.col("image_area") > 0).alias("image_pages"),
    )
    reason = F.when((F.col("density") < 0.3) & (F.col("image_ratio") > 0.5), "images").when(
        (F.col("pages") > 1) & (F.col("text_pages") < 0.3 * F.col("pages")) & (F.col("image_pages") > 0.5 * F.col("pages")), "pages"
    ).when((F.col("density") < 0.09) & (F.col("text_pages") == 0), "empty")
    return rows.withColumns({"reason": reason, "is_scanned": reason.isNotNull()})


def pipe_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line, n_cells, first_cell): lines with cells between bars."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "raw")).where(F.contains("raw", F.lit(" | ")))
    cells = F.filter(F.split("raw", r" \| "), lambda x: F.trim(x) != "")
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), F.size(cells).cast("long").alias("n_cells"), F.get(cells, F.lit(0)).alias("first_cell"))
