"""Name, type, parties, disputes, law and addresses of a contract, as expressions.

One projection: nothing is joined or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions.text import bound, first_match, strip

#: fixed values: what a contract is called, its types with their words, and how parties, addresses, disputes and law are written
NAMES = [r"(?Udm)^\s*(.{2,30}(?:合同|协议|契约|合约))\s*$", r"(?Ud)((?:关于|有关).{2,20}(?:合同|协议))"]
TYPES = [
    ("买卖合同", ["买卖合同", "购销合同", "采购合同", "销售合同"]),
    ("租赁合同", ["租赁合同", "租房合同", "房屋租赁", "场地租赁"]),
    ("劳动合同", ["劳动合同", "雇佣合同", "劳务合同"]),
    ("服务合同", ["服务合同", "服务协议", "技术服务", "咨询服务"]),
    ("借款合同", ["借款合同", "贷款合同", "借贷合同"]),
    ("建设合同", ["建设工程合同", "施工合同", "工程承包"]),
    ("知识产权合同", ["知识产权", "专利许可", "商标许可", "著作权许可"]),
    ("保密协议", ["保密协议", "保密合同", "NDA"]),
    ("合作协议", ["合作协议", "合作合同", "战略协议"]),
    ("委托合同", ["委托合同", "委托协议", "代理合同"]),
    ("担保合同", ["担保合同", "保证合同", "抵押合同"]),
]
# the lookaheads are implied: they are quicker than the words that follow
PARTIES = [
    r"(?Ud)(?=.方)([甲乙丙丁戊己庚辛壬癸])方[：:]\s*(.{2,50}?)(?:\s|$|，|,|。)",
    r"(?Ud)(?=.方)([甲乙丙丁戊己庚辛壬癸])方[（(][^）)]*[）)][：:]\s*(.{2,50}?)(?:\s|$|，|,|。)",
    r"(?Ud)(?=..?方)(出租方|承租方|买方|卖方|委托方|受托方|发包方|承包方|甲方|乙方)[：:]\s*(.{2,50}?)(?:\s|$|，|,|。)",
]
REPRESENTATIVE = r"(?Ud)法定代表人[：:]\s*(.{2,20}?)(?:\s|$|，|,|。)"
ADDRESS = r"(?Ud)(?:住所地|地址|住址)[：:]\s*(.{5,80}?)(?:\s*$|。)"
DISPUTES = [
    r"(?Ud)(?:提交|约定).{0,5}(?:仲裁|仲裁委员会)",
    r"(?Ud)(?:向|由).{0,20}(?:人民法院|法院)(?:起诉|提起诉讼|管辖)",
    r"(?Ud)争议解决[：:]?\s*(.{5,30}?(?:仲裁|诉讼|法院|管辖).{0,10})",
]
LAW = r"(?Ud)(?:适用|依据|根据).{0,10}(中华人民共和国.{0,20}法)"


def _first(text: Column, pattern: str, group: int) -> Column:
    return bound(strip(F.regexp_extract(text, pattern, group)), lambda found: F.when(found != "", found))


def parties(text: Column, head: int = 2000, near: int = 200) -> Column:
    """array<struct<role, name, representative>>: the first of each role by pattern, then place; names of one character are left out.

    A lookahead group carries a match and the text after it, so that no place is needed.
    """
    head_text = F.substring(text, 1, head)

    def of(p: str) -> Column:
        q = rf"(?=({p}[\s\S]{{0,{near}}}))" + p
        # matches with the text behind them, which begin with what matched
        return F.transform(F.regexp_extract_all(head_text, F.lit(q), F.lit(1)), lambda x: F.struct(
            bound(F.regexp_extract(x, p, 1), lambda r: F.when(F.length(r) == 1, F.concat(r, F.lit("方"))).otherwise(r)).alias("role"),
            strip(F.regexp_replace(F.regexp_extract(x, p, 2), "(?Ud)[，,。；;].*$", "")).alias("name"),
            _first(F.substring(x, 1, near), REPRESENTATIVE, 1).alias("representative"),
        ))

    def once(every: Column) -> Column:
        return bound(F.transform(every, lambda x: x["role"]), lambda roles: F.filter(every, lambda x, i: (F.array_position(roles, x["role"]) == i + 1) & (F.length(x["name"]) >= 2)))

    # bound to a name, so that the patterns are matched once
    return F.flatten(F.transform(F.array(F.concat(*[of(p) for p in PARTIES])), once))


def addresses(text: Column, most: int = 5) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(1)), strip)
    return F.slice(F.filter(found, lambda x: F.length(x) > 5), 1, most)


def contract_metadata(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, contract_name, contract_type, parties, dispute, governing_law, addresses); null or empty where not found."""
    body = F.coalesce(F.col(text), F.lit(""))
    start = F.substring(body, 1, 500)
    return docs.select(
        "doc_id",
        F.coalesce(*[_first(start, p, 1) for p in NAMES]).alias("contract_name"),
        first_match(F.substring(body, 1, 1000), TYPES).alias("contract_type"),
        parties(body).alias("parties"),
        F.coalesce(*[_first(body, p, 0) for p in DISPUTES]).alias("dispute"),
        _first(body, LAW, 1).alias("governing_law"),
        addresses(body).alias("addresses"),
    )
