"""Clauses of documents: header lines start them, bodies follow.

A document's lines are an array of its own row, and so are its clauses and
their places; documents never move.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.text import running, strip

#: fixed values: header patterns in order of priority, and header words
HEADERS = [
    r"^(第[一二三四五六七八九十百千\d]+[条章节])\s*",
    r"^([一二三四五六七八九十]+[、.．])\s*",
    r"^(第\d+条)\s*",
    r"^(\d+[.．、])\s*([^\n]{2,30})$",
    r"^(Article\s+[IVXLCDM\d]+)\s*",
    r"^(Section\s+\d+(?:\.\d+)?)\s*",
    r"^[（(]([一二三四五六七八九十\d]+)[）)]\s*([^\n]{2,30})$",
]
HEADER_WORDS = [
    "违约责任", "争议解决", "保密条款", "知识产权", "不可抗力", "生效条款", "当事人信息", "合同解除", "合同终止", "付款方式", "交货期限", "质量保证",
    "售后服务", "管辖法院", "适用法律", "定义与解释", "权利义务", "合作内容", "合作期限", "费用与支付", "保密义务", "其他约定", "附则", "总则",
]


def is_header(line: Column, patterns=HEADERS, words=HEADER_WORDS) -> Column:
    """line is stripped."""
    out = line.rlike("(?U)(?d)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)
    if not words:
        return out
    named = "(?d)^(?:" + "|".join(map(re.escape, words)) + r")(?:\z|[： ])"
    return out | ((F.length(line) <= 30) & line.rlike(named))


def clauses(docs: DataFrame, patterns=HEADERS, words=HEADER_WORDS, text: str = "text", positions: bool = True) -> DataFrame:
    """(doc_id, clause_id, title, content, start_pos, end_pos): ids from 1 without gaps.

    What stands before the first header is dropped; a header without a body
    gives nothing; a document without headers is one clause without title;
    blank lines inside a body stay, those at its ends go. Content are the
    body's lines without white space at their ends; start_pos and end_pos
    (exclusive) are the places of its first and last character in the text, in
    code points, so that the text between them is the content but for such
    white space. Without positions these two are left out, which is quicker.
    """
    spaces = lambda x: [F.length(x).alias("n"), (F.length(x) - F.length(F.regexp_replace(x, r"(?U)^\s+", ""))).alias("lead")] if positions else []
    info = lambda x: F.struct(*spaces(x), strip(x).alias("line"))
    rows = docs.select("doc_id", F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), info).alias("lines"))
    heads = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: is_header(F.get("lines", i)["line"], patterns, words))
    rows = rows.select("doc_id", "lines", (running(F.transform("lines", lambda x: x["n"] + 1)) if positions else F.lit(None)).alias("at"), heads.alias("heads"))

    def part(h: Column, k: Column) -> Column:
        body = F.slice("lines", h + 2, F.coalesce(F.get("heads", k + 1), F.size("lines")) - h - 1)
        return F.struct(h.alias("h"), F.get("lines", h)["line"].alias("title"), F.transform(body, lambda x: x["line"]).alias("body"))

    whole = F.array(F.struct(F.lit(-1).alias("h"), F.lit(None).cast("string").alias("title"), F.transform("lines", lambda x: x["line"]).alias("body")))
    rows = rows.select("doc_id", "lines", "at", F.when(F.size("heads") > 0, F.transform("heads", part)).otherwise(whole).alias("parts"))

    def clause(p: Column) -> Column:
        words = [p["title"].alias("title"), strip(F.array_join(p["body"], "\n")).alias("content")]
        if not positions:
            return F.struct(*words)
        full = F.transform(p["body"], lambda x: x != "")
        first = (p["h"] + F.array_position(full, True)).cast("int")
        last = (p["h"] + F.size(p["body"]) + 1 - F.array_position(F.reverse(full), True)).cast("int")
        end = F.get("at", last) + F.get("lines", last)["lead"] + F.length(F.get("lines", last)["line"])
        place = F.struct((F.get("at", first) + F.get("lines", first)["lead"]).alias("start_pos"), end.alias("end_pos"))
        return F.struct(*words, place.alias("place"))

    found = F.filter(F.transform("parts", clause), lambda c: c["content"] != "")
    rows = rows.select("doc_id", F.posexplode(found).alias("pos", "c"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("clause_id"), "c.title", "c.content", *(("c.place.start_pos", "c.place.end_pos") if positions else ()))


def pieces(docs: DataFrame, most: int = 5000, text: str = "text") -> DataFrame:
    """Greedy cuts of up to most characters: at a blank line, else a line end, else a full stop past a third, else hard.

    The cut character stays with its piece and a hard cut takes one more. A
    text that needs no cut is one piece as it is, an empty or null one an empty
    piece; a blank rest behind the last cut is dropped.
    """
    import pyarrow as pa

    def cut(t: str) -> list[str]:
        if len(t) <= most:
            return [t]
        out = []
        while len(t) > most:
            at = next((i for i in (t.rfind(x, 0, most) for x in ("\n\n", "\n", "。")) if i >= most // 3), most)
            out.append(t[: at + 1])
            t = t[at + 1 :]
        return [*out, t] if t.strip() else out

    def run(batches):
        for b in batches:
            rows = [(i, k, p) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, p in enumerate(cut(t or ""))]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "piece", "content"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, piece long, content string")


def first_middle_last(items: DataFrame, key: str, order: str) -> DataFrame:
    """Of more than three rows of a key the first, middle and last."""
    w = Window.partitionBy(key)
    df = items.withColumns({"__i": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count("*").over(w)})
    middle = F.floor(F.col("__n") / 2)
    return df.where((F.col("__n") <= 3) | F.col("__i").isin(0) | (F.col("__i") == middle) | (F.col("__i") == F.col("__n") - 1)).drop("__i", "__n")
