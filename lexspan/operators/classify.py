"""Document types, clause types, scope and error classes by ordered keyword lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions.text import first_match, keyword_hits

#: fixed values of the Chinese pack
TYPE_WORDS = {
    "contract": ["合同", "甲方", "乙方", "本合同", "价款", "报酬", "履行"],
    "agreement": ["协议", "合作", "双方", "约定"],
    "privacy_policy": ["隐私政策", "个人信息", "数据收集", "cookie", "用户信息"],
}
#: fixed values: words of legal texts, and words of code and its documentation
SIGNALS = [
    "合同", "协议", "甲方", "乙方", "丙方", "当事人", "签约", "条款", "违约", "赔偿", "仲裁", "诉讼", "管辖", "解除", "隐私政策", "个人信息", "用户协议", "服务条款", "保密",
    "知识产权", "许可", "授权", "法律", "法规", "法院", "裁定", "判决", "起诉", "应诉", "代理", "委托", "租赁", "借款", "担保", "抵押", "质押", "转让",
]
CODE = [
    "import ", "def ", "class ", "return", "self.", "__init__", "function", "const ", "var ", "let ", "module", "package", "require(", "from ", "export", "async ", "await ",
    "try:", "except:", "raise ", "print(", "logger", "git", "dockerfile", "makefile", "readme", ".py", ".js", "src/", "tests/", "config", "setup.py", "requirements", "github",
    "npm", "pip install", "todo", "fixme", "hack", "refactor", "commit", "merge", "branch", "deploy",
]
#: fixed values: words of criminal law, and phrases that hold them without meaning it
SCOPE_WORDS = ["刑事犯罪", "刑罚", "有期徒刑", "拘役", "管制", "无期徒刑", "死刑"]
SCOPE_SAFE = ["保密义务", "刑事责任条款", "法律法规", "适用法律", "管辖", "合规", "刑事附带民事"]
#: fixed values: clause types with their words, in order
CLAUSE_TYPES = [
    ("违约责任", ["违约责任", "违约", "违约金", "赔偿", "损害赔偿"]),
    ("争议解决", ["争议解决", "争议", "仲裁", "诉讼", "管辖", "法院"]),
    ("保密条款", ["保密", "商业秘密", "机密", "confidential"]),
    ("知识产权", ["知识产权", "版权", "专利", "商标", "著作权"]),
    ("解除条款", ["解除", "终止", "合同终止", "合同解除"]),
    ("不可抗力", ["不可抗力", "force majeure"]),
    ("生效条款", ["生效", "本合同自", "签字盖章"]),
    ("当事人信息", ["甲方", "乙方", "当事人", "地址", "法定代表人"]),
]
#: fixed values: codes of errors with words of their messages, in order
ERRORS = [
    ("LLM_TIMEOUT", ["timeout", "timed out"]),
    ("LLM_API_KEY_INVALID", ["api key", "unauthorized", "401"]),
    ("LLM_RATE_LIMIT", ["rate limit", "429"]),
    ("LLM_NETWORK", ["connection", "network"]),
    ("LLM_PARSE_ERROR", ["json", "parse"]),
]

#: a pack over words of the synthetic documents, for the same operator
LATIN_TYPES = {"contract": ["licensed", "version", "token"], "agreement": ["the ", "der ", "les "], "privacy_policy": ["@mail", "555-"]}
LATIN_SIGNALS = ["licensed", "license", "version", "token", "@mail", "555-", " | "]
LATIN_CODE = ["***", "$$$", "###", "%%%", "&&&"]


def code_hits(text: Column, words: list[str]) -> Column:
    """Words that occur; an ASCII one of up to 7 characters only between characters that are no letters."""
    import re

    out = F.lit(0)
    for w in words:
        short = w.isascii() and len(w) <= 7
        out = out + (text.rlike(f"(?<![a-zA-Z]){re.escape(w)}(?![a-zA-Z])") if short else F.contains(text, F.lit(w))).cast("int")
    return out


def document_type(
    text: Column, types: dict[str, list[str]], signals: list[str], code: list[str], least_type: int = 2, least_signals: int = 5, density: float = 0.005, penalty_from: int = 5
) -> Column:
    """The type with most words, the first on ties, if there are enough and dense enough signals; else ``unknown``.

    The counts are worked out once a text, as fields of an item: a filter on the
    type would otherwise be multiplied out over all of them by the optimizer.
    """

    def count(t):
        by_type = [keyword_hits(t, w).alias(f"t{i}") for i, w in enumerate(types.values())]
        words = F.greatest(F.regexp_count(t, F.lit("[一-鿿]+|[a-zA-Z]+")), F.lit(1))
        return F.struct(*by_type, keyword_hits(t, signals).alias("hits"), words.alias("words"), code_hits(t, code).alias("codes"))

    def decide(f):
        scores = {t: f[f"t{i}"] for i, t in enumerate(types)}
        best_score = F.greatest(*scores.values())
        best = F.lit(list(types)[-1])
        for t in reversed(list(types)[:-1]):
            best = F.when(scores[t] == best_score, F.lit(t)).otherwise(best)
        dense = f["hits"] / f["words"] >= density
        least = F.when(f["codes"] >= penalty_from, least_signals + f["codes"]).otherwise(F.lit(least_signals))
        return F.when((best_score >= least_type) & dense, best).when((f["hits"] >= least) & dense, F.when(best_score > 0, best).otherwise(F.lit("contract"))).otherwise(F.lit("unknown"))

    return F.get(F.transform(F.transform(F.array(F.lower(text)), count), decide), F.lit(0))


def out_of_scope(text: Column, words: list[str] = SCOPE_WORDS, safe: list[str] = SCOPE_SAFE) -> Column:
    """The first word that puts a text out of scope, null where none does or two safe words occur."""
    return F.when(keyword_hits(text, safe) < 2, first_match(text, [(w, [w]) for w in words]))


def clause_type(title: Column, content: Column, types=CLAUSE_TYPES) -> Column:
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(content, 1, 500)))
    return first_match(text, [(t, [w.lower() for w in ws]) for t, ws in types])


def error_class(message: Column) -> Column:
    return first_match(F.lower(message), ERRORS, "UNKNOWN")


def gated(docs: DataFrame, doc_type: str = "doc_type") -> tuple[DataFrame, DataFrame]:
    """(documents of a known type, the others)."""
    return docs.where(F.col(doc_type) != "unknown"), docs.where(F.col(doc_type) == "unknown")
