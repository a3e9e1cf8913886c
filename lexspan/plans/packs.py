"""Rule packs, playbooks and reference material as data.

Packs come from YAML files or from code. They are configuration of a fixed,
small size, held on the driver and compiled into column expressions or small
tables.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field
from pathlib import Path

LEVELS = {"critical": 4, "high": 3, "medium": 2, "low": 1}


class PackError(ValueError):
    """A pack that is missing or has no valid content."""


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    category: str
    level: str
    types: tuple[str, ...]
    kind: str  # missing or condition
    presence: tuple[str, ...] = ()
    substance: tuple[str, ...] = ()
    risk: tuple[str, ...] = ()
    safe: tuple[str, ...] = ()
    require_safe_absence: bool = False
    description: str = ""
    legal_basis: str = ""
    suggestion: str = ""

    @property
    def missing(self) -> bool:
        return self.rule_id.startswith("MISSING_") or self.kind in ("missing", "missing_clause")

    def words(self, field_name: str) -> tuple[str, ...]:
        """The keywords of a field, or words of the rule's name where the rule has none at all."""
        own = getattr(self, field_name)
        if own or self.presence or self.risk or self.safe:
            return own
        parts = tuple(p for p in re.split(r"[，、/\s]+", self.name) if len(p) >= 2)
        return parts or (self.name,)


@dataclass(frozen=True)
class Playbook:
    playbook_id: str
    name: str = ""
    role: str = ""
    strictness: str = "medium"
    focus: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    levels: dict[str, str] = field(default_factory=dict)
    description: str = ""
    required: tuple[str, ...] = ()
    prompts: dict[str, str] = field(default_factory=dict)
    builtin: bool = False


def _yaml(path: str | Path):
    import yaml

    try:
        data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError) as e:
        raise PackError(f"{path}: {e}") from e
    if not isinstance(data, dict):
        raise PackError(f"{path}: no mapping")
    return data


def valid_patterns(patterns) -> tuple[str, ...]:
    out = []
    for p in patterns or ():
        try:
            re.compile(p)
        except re.error:
            continue
        out.append(p)
    return tuple(out)


def load_rules(path: str | Path) -> list[Rule]:
    """Rules of a YAML file with a list ``risk_rules`` (or ``rules``); invalid patterns are left out."""
    data = _yaml(path)
    out = []
    for r in data.get("risk_rules") or data.get("rules") or ():
        d = r.get("detection") or {}
        t = lambda k, d=d: tuple(d.get(k) or ())
        out.append(
            Rule(
                r["id"], r.get("name", ""), r.get("category", ""), r.get("risk_level", "medium"), tuple(r.get("applicable_types") or ()), d.get("type", "condition"),
                t("presence_keywords"), valid_patterns(d.get("substance_patterns")), t("risk_keywords"), t("safe_keywords"), bool(d.get("require_safe_absence")),
                r.get("description", ""), r.get("legal_basis", ""), r.get("suggestion", ""),
            )
        )
    return out


STRICTNESS = ("low", "medium", "high", "strict")


def load_playbook(path: str | Path) -> Playbook:
    """A playbook of a YAML file; an unknown strictness is medium, a file without an id an error."""
    d = _yaml(path)
    if "id" not in d:
        raise PackError(f"{path}: no id")
    levels = {}
    for rule, x in (d.get("risk_weight_adjustments") or {}).items():
        levels[rule] = x.get("level", x.get("adjusted_level", "medium")) if isinstance(x, dict) else x
    strict = d.get("strictness", "medium")
    return Playbook(
        d["id"], d.get("name", d["id"]), d.get("role", "neutral"), strict if strict in STRICTNESS else "medium", tuple(d.get("focus_areas") or ()), tuple(d.get("excluded_rules") or ()), levels,
        d.get("description", ""), tuple(d.get("required_clauses") or ()), dict(d.get("custom_prompts") or {}),
    )


def load_playbooks(builtin: list[Playbook], folder: str | Path | None = None) -> dict[str, Playbook]:
    """By id; files of the folder, in order of name, override. A file that is no playbook is left out with a warning."""
    out = {p.playbook_id: p for p in builtin}
    for path in sorted(p for p in Path(folder).iterdir() if p.suffix in (".yaml", ".yml")) if folder and Path(folder).is_dir() else ():
        try:
            p = load_playbook(path)
        except PackError as e:
            warnings.warn(str(e), stacklevel=2)
            continue
        out[p.playbook_id] = p
    return out


def load_clause_patterns(path: str | Path, patterns: list[str], words: list[str]) -> tuple[list[str], list[str]]:
    """(header patterns in order of priority, header words) of a YAML file with lists ``patterns`` and ``title_keywords``.

    Patterns that are invalid or have no text are left out; what the file has
    none of, or a file that cannot be read, leaves the defaults given.
    """
    try:
        data = _yaml(path)
    except PackError as e:
        warnings.warn(str(e), stacklevel=2)
        return patterns, words
    listed = data.get("patterns")
    own = [x for x in (listed if isinstance(listed, list) else []) if isinstance(x, dict) and isinstance(x.get("regex"), str) and valid_patterns([x["regex"]])]
    own.sort(key=lambda x: int(x.get("priority", 99)))
    titles = data.get("title_keywords")
    return [x["regex"] for x in own] or patterns, [x for x in (titles if isinstance(titles, list) else []) if isinstance(x, str)] or words


def load_provisions(path: str | Path) -> list[dict]:
    """Rows (ord, law, article, title, content, keywords, category, status, last_verified, repealed_by) of a YAML file with a list ``legal_provisions``."""
    rows = enumerate(_yaml(path).get("legal_provisions") or (), 1)
    return [
        {
            "ord": i, "law": x["law"], "article": x["article"], "title": x["title"], "content": x["content"], "keywords": list(x.get("keywords") or ()),
            "category": x.get("category", "其他"), "status": x.get("status", "active"), "last_verified": _day(x.get("last_verified")), "repealed_by": x.get("repealed_by") or "",
        }
        for i, x in rows
    ]


def load_cases(path: str | Path) -> list[dict]:
    """Rows (ord, title, case_number, court, case_type, issue, holding, keywords, status, last_verified) of a YAML file with a list ``cases``."""
    texts = ("title", "case_number", "court", "case_type", "issue", "holding")
    rows = enumerate(_yaml(path).get("cases") or (), 1)
    return [
        {"ord": i, **{k: x.get(k, "") for k in texts}, "keywords": list(x.get("keywords") or ()), "status": x.get("status", "active"), "last_verified": _day(x.get("last_verified"))} for i, x in rows
    ]


def _day(x) -> str | None:
    return None if x is None else str(x)


#: fixed values: the playbooks that come with the library
PLAYBOOKS = [
    Playbook("neutral", "中立审查", "neutral", "medium", ("条款完整性", "合规性", "格式条款"), description="标准中立审查，平衡双方利益", builtin=True),
    Playbook(
        "party_a", "甲方立场", "party_a", "high", ("违约责任", "赔偿上限", "解除权", "知识产权归属", "保密条款"),
        levels={"IMBALANCE_001": "critical", "IMBALANCE_002": "critical", "COMPLIANCE_002": "high", "MISSING_CLAUSE_001": "critical"},
        description="保护甲方利益，重点关注乙方违约责任和履约能力", builtin=True,
    ),
    Playbook(
        "party_b", "乙方立场", "party_b", "high", ("责任限制", "付款条件", "甲方义务", "合理免责", "争议解决"),
        levels={"IMBALANCE_001": "critical", "IMBALANCE_002": "critical", "FORMAT_001": "high", "FORMAT_002": "critical", "IMBALANCE_003": "high"},
        description="保护乙方利益，重点关注责任限制和甲方义务", builtin=True,
    ),
    Playbook(
        "privacy_compliance", "隐私合规专项", "neutral", "strict", ("个人信息收集", "数据跨境", "用户权利", "安全措施", "合法性基础"),
        description="专注于个人信息保护和数据合规审查", required=("信息收集范围", "信息使用目的", "信息共享规则", "信息安全措施", "用户权利", "联系方式"), builtin=True,
    ),
    Playbook("labor_contract", "劳动合同专项", "neutral", "high", ("劳动报酬", "工作时间", "社会保险", "解除条件", "竞业限制"), description="专注于劳动合同合规审查", builtin=True),
]

#: A pack over words that occur in the synthetic documents.
LATIN = [
    Rule("MISSING_001", "license line", "completeness", "high", ("contract", "agreement"), "missing", presence=("licensed under", "license"), substance=(r"version [0-9]", r"cc by")),
    Rule("MISSING_002", "contact", "completeness", "medium", ("contract", "agreement", "privacy_policy"), "missing", presence=("@mail", "555-", "token"), substance=(r"[a-z]+\.[0-9]+@mail",)),
    Rule("COND_001", "table rows", "layout", "low", ("contract", "agreement"), "condition", risk=(" | ", "***", "$$$"), safe=("license",), require_safe_absence=True),
    Rule("COND_002", "shouting", "style", "medium", ("contract",), "condition", risk=("!!", "###", "&&&", "%%%"), safe=("the ", "der ", "les ")),
    Rule("COND_003", "credential", "security", "critical", ("contract", "agreement", "privacy_policy"), "condition", risk=("token =", "password"), safe=("example.com",)),
]
BUYER = Playbook("buyer", "Buyer", "buyer", "high", focus=("style",), excluded=("COND_001",), levels={"MISSING_002": "high"})
NEUTRAL = Playbook("neutral", "Neutral")
