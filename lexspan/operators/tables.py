"""Tables: HTML cells, raw grids, aligned text without borders, merged sources."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.markup import attributes, steps
from lexspan.tables import pieces

NESTED = "[嵌套表格]"  # fixed value: stands for a table inside a cell
CELL = "struct<content:string,row_span:int,col_span:int,is_header:boolean>"


def _span(told: dict[str, str | None], name: str) -> int:
    return max(1, int(told.get(name) or 1))


def cells_of(html: str | None) -> list[list[tuple[str, int, int, bool]]]:
    """Rows of (content, row_span, col_span, is_header); none without a table or where a span is no number.

    A cell is an opening td or th whose next td or th closes; a row holds the
    cells that close between its end and the row mark before that. Marks in an
    inner table are none of the outer one's, which has NESTED in its place;
    what follows its end is text of the outer one. Work is one pass.
    """
    if not html or "<table" not in html.lower():
        return []
    rows, row, depth = [], [], 0
    cell, texts = None, []
    for tag, closes, told, text in steps(html):
        if tag == "table":
            inner_end = depth > 1
            depth = max(0, depth - 1) if closes else depth + 1
            if depth > 1:
                tag, text = "", "" if closes else NESTED
            elif inner_end:
                tag = ""
        elif depth > 1:
            continue
        if tag == "td" or tag == "th":
            if closes:
                if cell:
                    row.append(("".join(texts).strip(), *cell))
                cell = None
            else:
                try:
                    told = attributes(told) if told else {}
                    cell, texts = (_span(told, "rowspan"), _span(told, "colspan"), tag == "th"), [text]
                except ValueError:
                    return []
        elif tag == "tr":
            if closes and row:
                rows.append(row)
            row = []
            if cell and text:
                texts.append(text)
        elif cell and (text or tag == "br"):
            texts.append("\n" + text if tag == "br" and not closes else text)
    return rows


def html_cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, row, col, content, row_span, col_span, is_header) of the tables in pages; spans are stated, not expanded."""
    names = [key, "row", "col", "content", "row_span", "col_span", "is_header"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches):
        for b in pieces(batches):
            rows = [(k, r, c, *cell) for k, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r, row in enumerate(cells_of(page)) for c, cell in enumerate(row)]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=names)

    some = pages.where(F.contains(F.lower(html), F.lit("<table"))).select(F.col(key).cast("long").alias(key), html)
    return some.mapInArrow(run, f"{key} long, row long, col long, content string, row_span long, col_span long, is_header boolean")


def grid_cells(grid: Column) -> Column:
    """array<array<string>> to rows of cells; the first row is the header, a null cell is empty."""
    one = lambda x, head: F.struct(F.trim(F.coalesce(x, F.lit(""))).alias("content"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), head.alias("is_header"))
    return F.transform(grid, lambda row, i: F.transform(F.coalesce(row, F.array().cast("array<string>")), lambda x: one(x, i == 0)))


def table_text(rows: Column) -> Column:
    """Rows of cells as lines; cells that are not blank, between bars."""
    line = lambda row: F.array_join(F.filter(F.transform(row, lambda c: F.trim(c["content"])), lambda x: x != ""), " | ")
    return F.array_join(F.filter(F.transform(rows, line), lambda x: x != ""), "\n")


def merged_sources(first: DataFrame, second: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_index")) -> DataFrame:
    """All tables of the first source, and those of the second whose index on the page is past the first one's count."""
    count = first.groupBy(*keys).agg(F.count("*").alias("__n"))
    more = second.join(count, list(keys), "left").where(F.col("table_index") >= F.coalesce("__n", F.lit(0))).drop("__n")
    return first.unionByName(more.select(*first.columns))


def _anchors(sorted_values: Column, near) -> Column:
    """Of ascending values those that begin a group: not near the group's first."""
    none = F.array().cast("array<double>")
    return F.aggregate(sorted_values, none, lambda acc, x: F.when((F.size(acc) > 0) & near(x, F.element_at(acc, -1)), acc).otherwise(F.array_append(acc, x)))


def borderless(blocks: DataFrame, row_share: float = 0.008, column_share: float = 0.02) -> DataFrame:
    """blocks (doc_id, page_index, ord, x1, y1, content, page_width, page_height) to cells (…, row, col, content, is_header).

    Lines whose tops are within a share of the height of a row's first line are
    one row; left edges over a share of the width from a column's first begin
    the next. A line goes to the nearest column, the first on ties; lines of
    one cell are joined. Pages with under four blocks, three lines, two rows or
    two columns have no table. Work is by page, in arrays.
    """
    page = ["doc_id", "page_index"]
    line = F.trim(F.coalesce("content", F.lit("")))
    df = blocks.withColumn("n_blocks", F.count("*").over(Window.partitionBy(*page))).withColumn("content", line)
    df = df.where((F.col("n_blocks") >= 4) & (F.col("content") != "") & F.col("x1").isNotNull() & F.col("y1").isNotNull())
    lines = df.groupBy(*page).agg(
        F.array_sort(F.collect_list(F.struct("y1", "ord", "x1", "content"))).alias("lines"), F.max("page_width").alias("w"), F.max("page_height").alias("h")
    )
    ys = F.array_sort(F.transform("lines", lambda x: x["y1"].cast("double")))
    xs = F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["x1"].cast("double"))))
    lines = lines.withColumns({"rows": _anchors(ys, lambda x, a: x - a < F.col("h") * row_share), "columns": _anchors(xs, lambda x, a: x - a <= F.col("w") * column_share)})
    lines = lines.where((F.size("lines") >= 3) & (F.size("rows") >= 2) & (F.size("columns") >= 2))
    one = lines.select(*page, "rows", "columns", F.posexplode("lines").alias("place", "l"))
    apart = lambda c: F.abs(c - F.col("l.x1"))
    nearest = F.array_min(F.transform("columns", lambda c, i: F.struct(apart(c).alias("d"), i.alias("i"))))["i"]
    one = one.select(*page, (F.size(F.filter("rows", lambda y: y <= F.col("l.y1"))) - 1).alias("row"), nearest.alias("col"), "place", F.col("l.content").alias("content"))
    cells = one.groupBy(*page, "row", "col").agg(F.array_sort(F.collect_list(F.struct("place", "content"))).alias("x"))
    joined = F.array_join(F.transform("x", lambda x: x["content"]), "\n")
    return cells.select(*page, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), joined.alias("content"), (F.col("row") == 0).alias("is_header"))
