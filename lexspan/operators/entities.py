"""Amounts, dates, definitions and revisions in texts."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache, lru_cache, partial, reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.functions.text import bound, occurrences
from lexspan.tables import pieces

#: fixed values: capital numerals, their units, and how dates are written
DIGITS = {"零": 0, "壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9}
UNITS = {"拾": 10, "佰": 100, "仟": 1000}
DATE_FORMS = [(r"([0-9]{4})\s*年\s*([0-9]{1,2})\s*月\s*([0-9]{1,2})\s*日", 0), (r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", 2), (r"([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})", 3), (r"([0-9]{4})\.([0-9]{1,2})\.([0-9]{1,2})", 4)]


def _tagged(found: Column, name: str, tag, value: str) -> Column:
    """Matches as structs with a constant."""
    return F.transform(found, lambda v: F.struct(F.lit(tag).alias(name), v.alias(value)))


def told_of(docs: DataFrame, keys: tuple[str, ...], text: str, find: Callable[[str], list[tuple]], fields: dict[str, T.DataType]) -> DataFrame:
    """(keys, found): what find tells of each text, as an array of structs of these fields; none of a null text. A text is read once."""
    kinds = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64()}
    types = [kinds[t] for t in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            every = [find(t) if t else [] for t in batch.column(len(keys)).to_pylist()]
            flat = [pa.array([x[i] for found in every for x in found], t) for i, t in enumerate(types)]
            ends = pa.array(accumulate(map(len, every), initial=0), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, [*fields]))], names=[*keys, "found"])

    rows = docs.select(*keys, F.col(text).alias("__text"))
    found = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields.items()]))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(keys)], T.StructField("found", found)]))


def capital_number(text: Column, strict: bool = True) -> Column:
    """Value of a number in capital numerals up to 元.

    strict adds digits as the numerals mean; otherwise a digit replaces the one
    before it inside a section, so that several units before 万 lose theirs.
    """
    digit = F.create_map(*[x for k, v in DIGITS.items() for x in (F.lit(k), F.lit(float(v)))])
    unit = F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(float(v)))])
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("part"), F.lit(0.0).alias("digit"))

    def step(a, c):
        d, u = F.element_at(digit, c), F.element_at(unit, c)
        held = F.when(a["digit"] > 0, a["digit"]).otherwise(F.when(a["part"] == 0, 1.0).otherwise(0.0))
        grown = a["part"] + held * u if strict else held * u
        section = F.when(c == "万", 1e4).when(c == "亿", 1e8)
        total = a["total"] + (a["part"] + a["digit"]) * section
        return (
            F.when(d.isNotNull(), F.struct(a["total"].alias("total"), a["part"].alias("part"), d.alias("digit")))
            .when(u.isNotNull(), F.struct(a["total"].alias("total"), grown.alias("part"), F.lit(0.0).alias("digit")))
            .when(section.isNotNull(), F.struct(total.alias("total"), F.lit(0.0).alias("part"), F.lit(0.0).alias("digit")))
            .otherwise(a)
        )

    chars = F.filter(F.split(F.substring_index(text, "元", 1), ""), lambda x: x != "")
    return F.aggregate(chars, zero, step, lambda a: a["total"] + a["part"] + a["digit"])


#: fixed values: how an amount is written, in order of priority; group 1 is the number
CAPITALS = "[零壹贰叁肆伍陆柒捌玖拾佰仟万亿]+元(?:整|角|分)?"
FIGURES = r"[0-9][0-9,，]*\.?[0-9]*"
AMOUNT_FORMS = [
    rf"(?:人民币|RMB|CNY)\s*({CAPITALS}|{FIGURES}[万亿]?元)",
    rf"[¥￥]\s*({FIGURES}[万亿]?)",
    rf"\$\s*({FIGURES})",
    rf"({FIGURES}[万亿]?)[元圆]",
    rf"(?:金额|价款|价格|总价|总金额|合同金额|报酬|费用|租金|借款)(?:为|：|:|\s)\s*[¥￥]?\s*({FIGURES}[万亿]?)[元圆]?",
    f"({CAPITALS})",
]


# the same for single texts, each form apart by how it begins, as a word is found quickly, and not looked for where it is not.
# Numbers before 元 are looked for from there, so that long ones without it are not tried digit by digit
_AFTER = [p[p.index(end) + 1 :] for p, end in zip(AMOUNT_FORMS, [")", "]", "$", "", ")"]) if end]
_HEADS = [["人民币", "RMB", "CNY"], ["¥", "￥"], [r"\$"], ["金额", "价款", "价格", "总价", "报酬", "费用", "租金", "借款"]]
_HEADED = [(h[-1] if h == r"\$" else h, re.compile(("(?:总|合同)?" if h == "金额" else "") + h + after, re.ASCII)) for heads, after in zip(_HEADS, _AFTER) for h in heads]
_FIGURES_YUAN = re.compile(AMOUNT_FORMS[3])
_FIGURES = re.compile(FIGURES)


@lru_cache(256)
def capital_value(number: str) -> float:
    """capital_number, strict, of one number."""
    total = part = digit = 0.0
    for c in number.split("元", 1)[0]:
        if c in DIGITS:
            digit = float(DIGITS[c])
        elif c in UNITS:
            part, digit = part + (digit if digit > 0 else float(part == 0)) * UNITS[c], 0.0
        elif c in "万亿":
            total, part, digit = total + (part + digit) * (1e4 if c == "万" else 1e8), 0.0, 0.0
    return total + part + digit


def amounts_in(text: str) -> list[tuple[str, float]]:
    """(raw, value) of a text's amounts, as amounts tells them."""
    first = {m[0]: m[1] for head, form in _HEADED if head in text for m in form.finditer(text)}
    behind = lambda part, signs: part[len(part.rstrip(signs)) :]
    for yuan in "元圆":
        parts = text.split(yuan)
        for part, after in zip(parts, parts[1:]):
            if run := behind(part, "0123456789,，.万亿"):
                first.update((m[0], m[1]) for m in _FIGURES_YUAN.finditer(run + yuan))
            if yuan == "元" and (run := behind(part, "零壹贰叁肆伍陆柒捌玖拾佰仟万亿")):
                raw = run + yuan + (after[:1] if after[:1] in ("整", "角", "分") else "")
                first[raw] = raw
    out = []
    for raw, number in first.items():
        figures = _FIGURES.match(number)
        if figures:
            value = float(figures[0].replace(",", "").replace("，", "")) * (1e8 if "亿" in number else 1e4 if "万" in number else 1.0)
        else:
            value = capital_value(number)
        if value > 0:
            out.append((raw, value))
    return out


def amount_lists(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, found) of each row: the amounts of its text as an array of (raw, value)."""
    return told_of(docs, ("doc_id",), text, amounts_in, {"raw": T.StringType(), "value": T.DoubleType()})


def amounts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, raw, value) of amounts in figures or capitals, each raw text of a row once, values above zero.

    Every form is searched over the whole text, so an amount that two forms
    write differently is told under both raw texts.
    """
    return amount_lists(docs, text).select("doc_id", F.inline("found"))


def dates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, raw, normalized): absolute dates by form, first of each raw text, years 1900 to 2100."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*[_tagged(F.regexp_extract_all(body, F.lit(p), F.lit(0)), "form", k, "raw") for p, k in DATE_FORMS])
    rows = docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*").groupBy("doc_id", "raw").agg(F.min("form").alias("form"))
    parts = F.regexp_extract_all("raw", F.lit("([0-9]+)"), F.lit(1))
    y, m, d = (F.get(parts, F.lit(i)).cast("int") for i in range(3))
    good = y.between(1900, 2100) & m.between(1, 12) & d.between(1, 31)
    return rows.where(good).select("doc_id", "raw", F.format_string("%04d-%02d-%02d", y, m, d).alias("normalized"))


def _terms(text: Column) -> Column:
    p = r"(?:以下简称|下称|hereinafter)\s*[“\"'「]([^”\"'」]{1,20})[”\"'」]"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(1)))


def definitions(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, term): terms that a text says it will use, each once."""
    return docs.select("doc_id", F.explode(_terms(F.col(text))).alias("term"))


def revisions(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, kind, content) of marked deletions and insertions."""
    # fixed values: how deletions and insertions are marked
    forms = [("delete", r"~~(.+?)~~"), ("delete", r"\[删除：(.+?)\]"), ("insert", r"\[新增：(.+?)\]"), ("insert", r"\[修改：(.+?)\]"), ("insert", r"\+\+(.+?)\+\+")]
    every = F.concat(*[_tagged(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)), "kind", k, "content") for k, p in forms])
    return docs.select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.*")


def signature_lines(docs: DataFrame, roles: list[str], words: list[str], text: str = "text") -> DataFrame:
    """(doc_id, role, line, signed): the first line that names a role; signed if two lines around it have a signing word."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("line", "raw"))
    near = F.concat_ws("\n", F.collect_list("raw").over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(-2, 2)))
    signed = F.lit(False)
    for w in words:
        signed = signed | F.contains(F.col("near"), F.lit(w))
    rows = lines.withColumn("near", near).select("doc_id", "line", signed.alias("signed"), F.explode(F.filter(F.array(*map(F.lit, roles)), lambda r: F.contains("raw", r))).alias("role"))
    return rows.groupBy("doc_id", "role").agg(F.min_by("signed", "line").alias("signed"), F.min("line").cast("long").alias("line"))


#: fixed values: roles of dates with their words, dates in numerals and relative ones
DATE_ROLES = [
    ("签署日期", ["签署日期", "签字日期", "签订日期", "签约日期", "签订之日"]),
    ("生效日期", ["生效日期", "生效之日", "生效日", "自.*起生效"]),
    ("到期日期", ["到期日期", "到期日", "届满日", "终止日期", "届满之日"]),
    ("交货日期", ["交货日期", "交付日期", "交货日", "交付日", "交货期限"]),
    ("付款日期", ["付款日期", "付款日", "支付日期", "支付日", "付款期限"]),
    ("验收日期", ["验收日期", "验收日", "验收期限"]),
    ("开工日期", ["开工日期", "开工日", "开工之日"]),
    ("竣工日期", ["竣工日期", "竣工日", "竣工之日"]),
]
CHINESE_DATE = "([〇零一二三四五六七八九]{4})年([一二三四五六七八九十]{1,3})月([一二三四五六七八九十]{1,4})日"
RELATIVE_DATE = r"(自.{2,10}(?:之日起|起))\s*([0-9]+)\s*(日内|日|个月|天|年)"
_DATE_START = re.compile(r"[0-9](?=[0-9]{3}(?:[年/.-]|\s+年))", re.ASCII)  # of every form in digits
_DATE_FORMS = {sign: re.compile(p, re.ASCII) for (p, _), sign in zip(DATE_FORMS, "年-/.")}  # by what stands behind the year
_CHINESE_DATE = re.compile(CHINESE_DATE)
_RELATIVE_DATE = re.compile(RELATIVE_DATE, re.ASCII)
_YEAR_DIGITS, _MONTH_DIGITS = str.maketrans("〇零一二三四五六七八九", "00123456789"), "零一二三四五六七八九"
# keywords by their first two characters; one that begins with another of its role adds nothing
_ROLE_WORDS: dict[str, list[tuple[str, int, int]]] = {}
for _rank, (_, _words) in enumerate(DATE_ROLES):
    for _w in _words:
        if "*" not in _w and not any(_w != v and _w.startswith(v) for v in _words):
            _ROLE_WORDS.setdefault(_w[:2], []).append((_w, len(_w), _rank))
_ROLE_START = re.compile("|".join(f"{c}(?=[{''.join(w[1] for w in _ROLE_WORDS if w[0] == c)}])" for c in sorted({w[0] for w in _ROLE_WORDS})))
# within a line, and with its last word, without which it need not be looked for
_ROLE_PATTERNS = [(re.compile(w.replace(".", r"[^\n\r\x85\u2028\u2029]")), w.rpartition("*")[2], rank) for rank, (_, words) in enumerate(DATE_ROLES) for w in words if "*" in w]


def small_number(c: Column, strict: bool = True) -> Column:
    """A number below 100 in Chinese numerals. Not strict: digits are strung together, so that 十五 is 105."""
    digits = lambda x: F.translate(x, "〇零一二三四五六七八九", "00123456789")
    if not strict:
        known = F.when(c == "十", 10).when(c == "十一", 11).when(c == "十二", 12)
        strung = F.aggregate(
            F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0), lambda a, x: a * 10 + F.when(x == "十", 10).otherwise(F.coalesce(digits(x).try_cast("int"), F.lit(0)))
        )
        return F.coalesce(known, strung)
    before, after = F.substring_index(c, "十", 1), F.substring_index(c, "十", -1)
    value = lambda x, none: F.when(x == "", F.lit(none)).otherwise(digits(x).try_cast("int"))
    return F.when(F.contains(c, F.lit("十")), 10 * value(before, 1) + value(after, 0)).otherwise(digits(c).try_cast("int"))


@cache
def small_value(c: str, strict: bool = True) -> int:
    """small_number of one number in the numerals of a month or day."""
    strung = lambda digits, none=0: int("".join(map(str, map(_MONTH_DIGITS.index, digits)))) if digits else none
    if not strict:
        known = {"十": 10, "十一": 11, "十二": 12}.get(c)
        return known or reduce(lambda a, x: a * 10 + (10 if x == "十" else _MONTH_DIGITS.index(x)), c, 0)
    parts = c.split("十")
    return 10 * strung(parts[0], 1) + strung(parts[-1]) if len(parts) > 1 else strung(c)


def _all(word: str, text: str) -> Iterator[int]:
    """Where the word is, also within itself."""
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + 1)


def dates_in(text: str, strict: bool = True, around: int = 100) -> list[tuple[str, int, str, str | None]]:
    """(raw, start_pos, normalized, role) of a text's dates, as date_mentions tells them."""
    found: dict[str, tuple[int, str | None]] = {}
    told = lambda y, m, d: f"{y}-{m:02d}-{d:02d}" if 1900 <= y <= 2100 and 1 <= m <= 12 and 1 <= d <= 31 else None
    end: dict[re.Pattern, int] = {}  # matches of one form do not overlap
    for s in [m.start() for m in _DATE_START.finditer(text)]:
        form = _DATE_FORMS.get(text[s + 4], _DATE_FORMS["年"])
        if (m := form.match(text, s)) and s >= end.get(form, 0):
            end[form] = m.end()
            if m[0] not in found:
                found[m[0]] = (s, told(*map(int, m.groups())))
    last = 0
    for at in _all("年", text):
        if at >= last + 4 and (m := _CHINESE_DATE.match(text, at - 4)):
            last = m.end()
            if m[0] not in found:
                found[m[0]] = (at - 4, told(int(m[1].translate(_YEAR_DIGITS)), small_value(m[2], strict), small_value(m[3], strict)))
    for m in _RELATIVE_DATE.finditer(text):
        if m[0] not in found:
            found[m[0]] = (m.start(), f"relative:{m[2]}{m[3]}")

    # the first role with a keyword, or its pattern, in the text around
    words: list[tuple[int, int, int]] = []
    for m in _ROLE_START.finditer(text):
        at = m.start()
        for w, n, rank in _ROLE_WORDS[text[at : at + 2]]:
            if text.startswith(w, at):
                words.append((at, at + n, rank))
    patterns = [(p, rank) for p, last_word, rank in _ROLE_PATTERNS if last_word in text]
    out = []
    for raw, (at, date) in found.items():
        if date:
            low, high = max(at - around, 0), at + around
            ranks = [rank for _, e, rank in words[bisect_left(words, (low,)) : bisect_left(words, (high,))] if e <= high]
            ranks += [rank for p, rank in patterns if p.search(text[low:high])]
            out.append((raw, at, date, DATE_ROLES[min(ranks)][0] if ranks else None))
    return out


def date_mentions(docs: DataFrame, text: str = "text", strict: bool = True, keys: tuple[str, ...] = ("doc_id",), around: int = 100) -> DataFrame:
    """(keys, raw, start_pos, normalized, role): dates in digits or Chinese numerals and relative ones, the first of each raw text.

    The role comes from the text around the start. With the clause id among the
    keys the same gives dates per clause.
    """
    fields = {"raw": T.StringType(), "start_pos": T.LongType(), "normalized": T.StringType(), "role": T.StringType()}
    return told_of(docs, keys, text, partial(dates_in, strict=strict, around=around), fields).select(*keys, F.inline("found"))


#: fixed values: an amount in figures with the same in capitals behind it, or the other way round
NUMERALS = "零壹贰叁肆伍陆柒捌玖拾佰仟万亿"
PAIR = rf"([0-9][0-9,，]*\.?[0-9]*[万亿]?)[元圆]?\s*[（(]\s*大写[：:]?\s*(?:人民币)?([{NUMERALS}]+)[元圆]"
PAIR_BACK = rf"[（(]\s*(?:大写[：:]?\s*)?(?:人民币)?([{NUMERALS}]+)[元圆](?:整|角|分)?\s*[）)]\s*[¥￥]?\s*([0-9][0-9,，]*\.?[0-9]*[万亿]?)[元圆]?"


def capitals(number: Column) -> Column:
    """A whole number from 1 up to 10^12 in capital numerals; null for others.

    Two digits at a time are looked up with their units; a zero is told once where a digit is missing between others.
    """
    digit = ["", *NUMERALS[1:10]]
    # texts of 0 to 99, worked out when the query is planned
    two = lambda ten, one: F.split(F.lit(",".join((digit[n // 10] and digit[n // 10] + ten) + (digit[n % 10] and digit[n % 10] + one) for n in range(100))), ",")
    div = lambda a, n: F.call_function("div", a, F.lit(n))
    zero = lambda before, a, b, full: F.when((before > 0) & (b > 0) & ((a % 10 == 0) | (b < full)), "零").otherwise("")

    def section(s: Column) -> Column:
        a, b = div(s, 100), s % 100
        return F.concat(F.get(two("仟", "佰"), a.cast("int")), zero(a, a, b, 10), F.get(two("拾", ""), b.cast("int")))

    def told(v: Column) -> Column:
        marked = lambda s, mark: F.when(s > 0, F.concat(section(s), F.lit(mark))).otherwise("")
        return F.concat(marked(v[0], "亿"), zero(v[0], v[0], v[1], 1000), marked(v[1], "万"), zero(v[0] + v[1], v[1], v[2], 1000), section(v[2]))

    n = number.cast("long")
    return F.when((number >= 1) & (number < 10**12), bound(F.array(div(n, 10**8), div(n, 10**4) % 10**4, n % 10**4), told))


def amount_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, lower, upper, consistent): amounts in digits with the same in capitals before or behind them, each raw text once; consistent is null where one has no value.

    The same amount in both orders is two raw texts, and so two rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    both = f"{PAIR}|{PAIR_BACK}"
    raws = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(both), F.lit(0)))).alias("raw"))
    group = lambda i: F.regexp_extract("raw", both, i)
    behind = group(1) != ""
    rows = raws.select("doc_id", F.when(behind, group(1)).otherwise(group(4)).alias("lower"), F.when(behind, group(2)).otherwise(group(3)).alias("upper"))
    number = F.regexp_replace(F.regexp_extract("lower", r"([0-9][0-9,，]*\.?[0-9]*)", 1), "[,，]", "").try_cast("double")
    low = number * F.when(F.contains("lower", F.lit("亿")), 1e8).when(F.contains("lower", F.lit("万")), 1e4).otherwise(1.0)
    high = capital_number(F.col("upper"))
    return rows.withColumn("consistent", F.when((low > 0) & (high > 0), F.abs(low - high) < 0.01))


#: fixed values: a party's line, and the words of signing and sealing
PARTY_LINE = "([甲乙丙丁买卖]|出租|承租|委托|受托|发包|承包)[方人]"
SIGNED = ["签字", "签名", "签署", "签章"]
SEALED = ["盖章", "公章", "合同专用章", "法人章"]
ZONE = ["签章", "签字盖章", "签字", "盖章", "签名", "甲方", "乙方", "签章日期", "签订日期"]
NOBODY = "未知"


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _role(text: Column) -> Column:
    return bound(F.regexp_extract(text, PARTY_LINE, 1), lambda found: F.when(F.length(found) == 1, F.concat(found, F.lit("方"))).when(found != "", found))


def signatures(docs: DataFrame, blocks: DataFrame | None = None, text: str = "text") -> DataFrame:
    """(doc_id, role, has_signature, has_seal, line, page): of each party the first line that names it, and what stands two lines around it.

    A text that names no party but has a signing word is signed by nobody
    known. blocks (doc_id, page, text, top, page_height) are parts of pages:
    those in the lowest three tenths that speak of signing tell of parties that
    the text does not name, by their own words; line is null for these, as page
    is for the others.
    """
    kind = "array<struct<role:string,has_signature:boolean,has_seal:boolean,line:bigint>>"
    nobody = F.array(F.struct(F.lit(NOBODY).alias("role"), F.lit(True).alias("has_signature"), F.lit(False).alias("has_seal"), F.lit(None).cast("long").alias("line")))

    def told_by(lines: Column, roles: Column) -> Column:
        # the first line of each role; no other is looked at
        places = F.transform(F.filter(F.array_distinct(roles), lambda r: r.isNotNull()), lambda r: F.struct(r.alias("role"), (F.array_position(roles, r) - 1).cast("int").alias("line")))

        def marks(x: Column) -> Column:
            low = F.greatest(x["line"] - 2, F.lit(0))
            near = F.array_join(F.slice(lines, low + 1, x["line"] + 3 - low), "\n")
            return bound(near, lambda n: F.struct(x["role"].alias("role"), n.rlike("|".join(SIGNED)).alias("has_signature"), n.rlike("|".join(SEALED)).alias("has_seal"), x["line"].cast("long").alias("line")))

        return F.transform(places, marks)

    # lines and roles are bound to names, so that they are worked out once
    first = bound(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda lines: bound(F.transform(lines, _role), lambda roles: told_by(lines, roles)))
    whole = F.coalesce(F.col(text), F.lit("")).rlike("|".join(SIGNED + SEALED))
    found = bound(first, lambda x: F.when(F.size(x) > 0, x).when(whole, nobody).otherwise(F.array().cast(kind)))
    told = docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*", F.lit(None).cast("long").alias("page"))
    if blocks is None:
        return told
    low = blocks.where((F.col("page_height") > 0) & (F.col("top") >= 0.7 * F.col("page_height"))).where(_any(F.lower(text), ZONE)).withColumn("role", _role(F.col(text))).where("role is not null")
    best = low.select("doc_id", "role", "page", "top", _any(F.col(text), ["签字", "签名"]).alias("s"), _any(F.col(text), ["盖章", "公章"]).alias("e"))
    score = F.col("s").cast("int") + F.col("e").cast("int")
    one = best.groupBy("doc_id", "role").agg(F.max_by(F.struct("s", "e", "page"), F.struct(score, -F.col("page"), -F.col("top"))).alias("x"))
    others = one.join(told.select("doc_id", "role"), ["doc_id", "role"], "left_anti")
    return told.unionByName(others.select("doc_id", "role", F.col("x.s").alias("has_signature"), F.col("x.e").alias("has_seal"), F.lit(None).cast("long").alias("line"), F.col("x.page").cast("long").alias("page")))


#: fixed values: names before their short forms, what opens and closes a section of definitions, and a definition there
NAMED = "([\u4e00-\u9fffA-Za-z][\u4e00-\u9fffA-Za-z0-9·（()）]{2,30})\\s*[(（]\\s*(?:以下简称|下称)\\s*['‘\"“「]?\\s*(.+?)\\s*['’\"”」]?\\s*[)）]"
SECTION = ["定义", "术语定义", "名词解释", "词语定义", "词语解释", "本合同中", "本合同中下列词语", "下列术语", "下列用语"]
HEADING = r"^(?:第[一二三四五六七八九十百千]+[条章节]|[0-9]+[.．、])"
MEANS = "['‘\"“]?([\u4e00-\u9fffA-Za-z][\u4e00-\u9fffA-Za-z0-9]{1,15})['’\"”]?\\s*(?:是指|指|系指|是|为)\\s*(.{5,100}?)(?:[。；;]|$)"


def defined_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, term, definition, form): short names with what they stand for (named), else alone (short), and terms that a section of definitions explains (means).

    Each term once, in this order. A section begins with a line that speaks of
    definitions and ends behind a numbered heading that does not.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    struct = lambda term, definition, form: F.struct(F.trim(term).alias("term"), definition.alias("definition"), F.lit(form).alias("form"))
    pairs = F.arrays_zip(*[F.regexp_extract_all(body, F.lit(NAMED), F.lit(i)).alias(n) for i, n in ((1, "full"), (2, "short"))])
    named = F.transform(pairs, lambda x: struct(x["short"], F.trim(x["full"]), "named"))
    # most texts have no short name in brackets, which is quicker to see than the names before it
    named = F.when(body.rlike("[(（]\\s*(?:以下简称|下称)"), named).otherwise(F.array().cast("array<struct<term:string,definition:string,form:string>>"))
    short = F.transform(_terms(body), lambda t: struct(t, F.trim(t), "short"))
    speaks = "|".join(SECTION)

    def explained(line: Column) -> Column:
        found = F.arrays_zip(*[F.regexp_extract_all(line, F.lit(MEANS), F.lit(i)).alias(n) for i, n in ((1, "term"), (2, "means"))])
        return F.transform(found, lambda x: struct(x["term"], F.trim(x["means"]), "means"))

    # what each line does: 2 opens a section, 1 closes one behind it, 0 neither; the first line closes nothing
    marks = F.transform(F.transform(F.split(body, "\n"), F.trim), lambda x, i: F.struct(x.alias("line"), F.when(x.rlike(speaks), 2).when((i > 0) & x.rlike(HEADING), 1).otherwise(0).alias("does")))
    none = F.array().cast("array<string>")
    begin = F.struct(F.lit(False).alias("open"), none.alias("lines"))

    def step(a: Column, x: Column) -> Column:
        inside = a["open"] | (x["does"] == 2)
        return F.struct((inside & (x["does"] != 1)).alias("open"), F.when(inside, F.array_append(a["lines"], x["line"])).otherwise(a["lines"]).alias("lines"))

    means = F.flatten(F.transform(F.aggregate(marks, begin, step, lambda a: a["lines"]), explained))

    def once(every: Column) -> Column:
        terms = F.transform(every, lambda x: x["term"])
        return bound(terms, lambda t: F.filter(every, lambda x, i: (F.array_position(t, x["term"]) == i + 1) & F.length(x["term"]).between(1, 20)))

    return docs.select("doc_id", F.explode(bound(F.concat(named, short, means), once)).alias("x")).select("doc_id", "x.*")


def richest_signatures(found: DataFrame) -> DataFrame:
    """found (doc_id, ord, role, has_signature, has_seal, has_riding_seal): of each role the record with the most marks, the first on ties."""
    marks = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("has_signature", "has_seal", "has_riding_seal")), F.lit(0))
    best = F.max_by(F.struct("ord", "has_signature", "has_seal", "has_riding_seal"), F.struct(marks, -F.col("ord"))).alias("x")
    return found.groupBy("doc_id", "role").agg(best).select("doc_id", "role", "x.*")


def definition_references(docs: DataFrame, clauses: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, term, n_mentions, clause_ids): terms of two or more characters that a text names more than once, and the clauses that name them."""
    terms = docs.select("doc_id", text, F.explode(_terms(F.col(text))).alias("term")).where(F.length("term") >= 2)
    terms = terms.select("doc_id", "term", occurrences(F.col(text), F.col("term")).alias("n_mentions")).where("n_mentions > 1")
    c = clauses.select("doc_id", "clause_id", F.concat_ws("\n", "title", "content").alias("__body"))
    rows = terms.join(c, "doc_id", "left").withColumn("clause_id", F.when(F.contains("__body", F.col("term")), F.col("clause_id")))
    return rows.groupBy("doc_id", "term").agg(F.max("n_mentions").alias("n_mentions"), F.array_sort(F.collect_set("clause_id")).alias("clause_ids"))


def terms_in(docs: DataFrame, terms: dict[str, list[str]], text: str = "text") -> DataFrame:
    """(doc_id, term): terms of which the text has any variant; the terms are configuration, compiled into one projection."""
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    hit = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.col("__b"), w))
    found = F.array_compact(F.array(*[F.when(hit(words), F.lit(t)) for t, words in terms.items()]))
    return docs.select("doc_id", body.alias("__b")).select("doc_id", F.explode(found).alias("term"))
