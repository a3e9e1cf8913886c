"""Paragraphs that a page break cuts, and texts of layout blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.operators.segment import HEADER_WORDS

#: fixed values: what ends a sentence, and how clause headers begin
SENTENCE_END = r"[。！？；：.!?;:]\s*$"
HEADERS = [
    r"第[一二三四五六七八九十百千零壹贰叁肆伍陆柒捌玖拾佰仟\d]+[条章节条款]", r"[一二三四五六七八九十百]+[、.]", r"\d+[.．、]", r"\d+(?:\.\d+)+[.、\s]",
    r"Article\s+", r"Section\s+", r"Clause\s+", r"Paragraph\s+", r"Para\.?\s+", r"§\s*\d+",
    r"[（(][一二三四五六七八九十百\d]+[）)]", r"[（(][a-z][）)]", r"[IVXLCDM]+[.、\s]", r"附录", r"Appendix\s+",
]
HEADERS += HEADER_WORDS
TEXT = ("text", "title")


def _right(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def _left(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def joined_pages(blocks: DataFrame, headers: Sequence[str] = HEADERS) -> DataFrame:
    """blocks (doc_id, page_index, ord, block_id, block_type, content) after joining paragraphs that a page break cuts.

    The last text block of a page takes in the first of the next page unless it
    ends a sentence or the other begins a clause. A page whose only text block
    has gone to the page before cannot take in another. Along a chain of such
    pages blocks go and stay in turn, so the distance from its begin tells which
    go. Blocks that went are left out. All is read off one order of a document's
    blocks; nothing is joined.
    """
    order = "partition by doc_id order by page_index, ord, block_id, content"
    before = lambda x, n: F.expr(f"lag({x}, {n}) ignore nulls over ({order})")
    own = Window.partitionBy("doc_id").orderBy("page_index", "ord", "block_id", "content")
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = "^(?:" + "|".join(headers) + ")"
    text = F.col("block_type").isin(*TEXT) & F.col("doc_id").isNotNull() & F.col("page_index").isNotNull()
    df = blocks.withColumn("__text", F.coalesce(text, F.lit(False)))
    # text blocks: the one before, and the page of the one before that
    df = df.withColumns({"__last": before("if(__text, struct(page_index as page, content), null)", 1), "__other": before("if(__text, page_index, null)", 2), "__row": F.lag("page_index").over(own)})
    # pages without text blocks are counted too, as they break the chain
    new = ~F.col("page_index").eqNullSafe(F.col("__row"))
    df = df.withColumns({"__page": F.sum(new.cast("int")).over(so_far), "__before": F.last(F.when(new, F.col("__row")), ignorenulls=True).over(so_far)})

    last = F.col("__last.page")
    first = F.col("__text") & (last.isNull() | (last != F.col("page_index")))
    left, right = _right(F.col("__last.content")), _left(F.col("content"))
    cut = F.coalesce((left != "") & (right != "") & ~left.rlike(SENTENCE_END) & ~right.rlike(header), F.lit(False))
    df = df.withColumns({"__first": first, "__cut": F.when(first & (last == F.col("__before")), cut).otherwise(F.lit(False))})
    # the page before has one text block only, so whether that went decides
    linked = F.col("__cut") & (F.col("__other").isNull() | (F.col("__other") != last))
    begin = F.last(F.when(F.col("__first") & ~linked, F.col("__page") + F.col("__cut").cast("int")), ignorenulls=True).over(so_far)
    df = df.withColumn("__went", F.col("__first") & ((F.col("__page") + begin) % 2 == 1))
    df = df.withColumn("__next", F.expr(f"lead(if(__text, struct(__went as went, content), null), 1) ignore nulls over ({order})"))
    takes = F.col("__text") & F.col("__next.went")
    content = F.when(takes, F.concat(_right(F.col("content")), _left(F.col("__next.content")))).otherwise(F.col("content"))
    return df.where(~F.col("__went")).withColumn("content", content).select(*blocks.columns)


def document_text(blocks: DataFrame, kinds: Sequence[str] = ("text", "title", "table")) -> DataFrame:
    """(doc_id, text): blocks of the kinds that are not blank, in order, a line each."""
    line = F.trim(F.coalesce("content", F.lit("")))
    rows = blocks.where(F.col("block_type").isin(*kinds)).select("doc_id", "page_index", "ord", line.alias("line")).where("line <> ''")
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "ord", "line"))).alias("x"))
    return rows.select("doc_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))


def mean_confidence(blocks: DataFrame) -> DataFrame:
    """(doc_id, confidence): the mean over blocks that state one; 0 without any."""
    return blocks.groupBy("doc_id").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
