"""Sensitive spans resolved by priority, masked texts and warnings.

Each kind's matches are found once, in time linear in the text. Kinds are then
accepted in order of priority: ends and starts of accepted spans ascend
together, so that a span's first possible neighbour is found by binary search,
and a text with n matches costs n log n. A masked text is put together from the
gaps. Documents never move: there is no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.tables import pieces

#: fixed values: kinds in order of priority, their patterns, and their names in a warning
KINDS = ["身份证号", "手机号", "邮箱", "银行卡号", "统一社会信用代码"]
PATTERNS = {
    "身份证号": r"(?<!\d)\d{17}[\dXx](?!\d)",
    "手机号": r"(?<!\d)1[3-9]\d{9}(?!\d)",
    "邮箱": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "银行卡号": r"(?<!\d)\d{16,19}(?!\d)",
    "统一社会信用代码": r"[0-9A-HJ-NPQRTUWXY]{2}\d{6}[0-9A-HJ-NPQRTUWXY]{10}",
}
WARNINGS = {"身份证号": "身份证号码", "手机号": "手机号码", "邮箱": "电子邮箱", "银行卡号": "银行卡号", "统一社会信用代码": "统一社会信用代码"}

MAIL, CARD = KINDS.index("邮箱"), KINDS.index("银行卡号")
_COMPILED = [re.compile(PATTERNS[k], re.ASCII) for k in KINDS]
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")
_ODD_DIGIT = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]  # twice a digit, digits summed

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(_ODD_DIGIT[x] for x in values[1::2])) % 10 == 0


def _mails(text: str) -> list[tuple[int, int]]:
    """Matches of the mail pattern, sought from each @, so that a long run of letters is read once."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        before = text[low:at]
        start = low + len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        low = found.end() if found else at
        if found:
            out.append((start, low))
        at = text.find("@", max(low, at + 1))
    return out


def matches(text: str, kind: int) -> list[tuple[int, int]]:
    """(start, end) of a kind's matches, in code points, without overlap."""
    if kind == MAIL:
        return _mails(text)
    found = [m.span() for m in _COMPILED[kind].finditer(text)]
    return [(s, e) for s, e in found if luhn(text[s:e])] if kind == CARD else found


def accepted(text: str) -> list[Span]:
    """Spans by priority; one that overlaps an accepted span of an earlier kind is none. Ascending by start."""
    starts: list[int] = []
    ends: list[int] = []
    out: list[Span] = []
    for kind in range(len(KINDS)):
        free = []
        for s, e in matches(text, kind):
            i = bisect_right(ends, s)  # the first accepted span that ends behind s
            if i == len(ends) or starts[i] >= e:
                free.append((kind, s, e))
        if free:
            out = sorted(out + free, key=lambda x: x[1])
            starts, ends = [x[1] for x in out], [x[2] for x in out]
    return out


def mask(kind: int, value: str) -> str:
    if kind == MAIL:
        local, domain = value.split("@", 1)
        return f"{local[: max(1, len(local) // 2)]}***@{domain}"
    keep = {1: 3, CARD: 4}.get(kind, 6)
    return f"{value[:keep]}****{value[-4:]}"


def masked(text: str, spans: list[Span]) -> str:
    parts, at = [], 0
    for kind, s, e in spans:
        parts += text[at:s], mask(kind, text[s:e])
        at = e
    return "".join([*parts, text[at:]])


def pii_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, type, start_pos, end_pos, masked_value) of whole texts; a null text has none, repeated rows have theirs each."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in pieces(batches):
            out = [[], [], [], [], []]
            for key_, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, s, e in accepted(body or ""):
                    for column, x in zip(out, (key_, KINDS[kind], s, e, mask(kind, body[s:e]))):
                        column.append(x)
            types = (batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "type", "start_pos", "end_pos", "masked_value"])

    fields = [("type", T.StringType()), ("start_pos", T.LongType()), ("end_pos", T.LongType()), ("masked_value", T.StringType())]
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *[T.StructField(n, t) for n, t in fields]]))


def masked_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, masked, n_spans, warning) of every row: the text with each span masked, and the kinds found in fixed order or null.

    A null text stays null.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in pieces(batches):
            texts = batch.column(1).to_pylist()
            found = [accepted(t or "") for t in texts]
            told = ["、".join(WARNINGS[KINDS[k]] for k in sorted({x[0] for x in spans})) or None for spans in found]
            columns = [pa.array([t if t is None else masked(t, x) for t, x in zip(texts, found)], pa.string()), pa.array(map(len, found), pa.int64()), pa.array(told, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "masked", "n_spans", "warning"])

    fields = [("masked", T.StringType()), ("n_spans", T.LongType()), ("warning", T.StringType())]
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *[T.StructField(n, t) for n, t in fields]]))


def mails(text: Column) -> Column:
    """The mail addresses of a text as a column, without regard to other kinds."""
    return F.regexp_extract_all(text, F.lit(PATTERNS["邮箱"]), F.lit(0))
