import pytest

from lexspan.catalogue_zh import PACK
from lexspan.plans import packs

RULES = """
risk_rules:
  - id: R1
    name: "甲、乙条款"
    applicable_types: [contract]
    detection: {type: missing_clause, substance_patterns: ["a+", "(["]}
"""
PLAYBOOK = """
id: party_a
strictness: {strict}
excluded_rules: [R1]
risk_weight_adjustments: {{A: critical, B: {{level: high, reason: x}}, C: {{adjusted_level: low}}, D: {{reason: y}}}}
"""
LAWS = """
legal_provisions:
  - {law: L, article: A1, title: T, content: C, last_verified: 2026-01-02}
  - {law: M, article: A2, title: U, content: D, category: x, keywords: [k], status: repealed}
"""


def write(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return path


def test_rules_of_either_key(tmp_path):
    for key in ("risk_rules", "rules"):
        (r,) = packs.load_rules(write(tmp_path, "r.yaml", RULES.replace("risk_rules", key)))
        assert (r.rule_id, r.level, r.missing, r.substance) == ("R1", "medium", True, ("a+",))
        assert r.words("presence") == ("乙条款",)
    assert [r.rule_id for r in PACK] == ["MISSING_PAYMENT", "MISSING_COURT", "IMBALANCE_ONE_SIDED", "PRIVACY_SHARING"]


def test_files_that_are_no_pack(tmp_path):
    for path in (tmp_path / "none.yaml", write(tmp_path, "list.yaml", "[1]"), write(tmp_path, "bad.yaml", "a: [")):
        with pytest.raises(packs.PackError):
            packs.load_rules(path)


def test_playbooks(tmp_path):
    write(tmp_path, "a.yaml", PLAYBOOK.format(strict="strict"))
    write(tmp_path, "b.yml", PLAYBOOK.format(strict="odd").replace("party_a", "mine"))
    write(tmp_path, "c.yaml", "name: without an id")
    write(tmp_path, "d.txt", "id: no")
    with pytest.warns(UserWarning, match="no id"):
        got = packs.load_playbooks(packs.PLAYBOOKS, tmp_path)
    assert list(got) == ["neutral", "party_a", "party_b", "privacy_compliance", "labor_contract", "mine"]
    assert got["party_a"].strictness == "strict" and not got["party_a"].builtin and got["party_b"].builtin
    assert got["mine"].strictness == "medium" and got["mine"].levels == {"A": "critical", "B": "high", "C": "low", "D": "medium"}
    assert packs.load_playbooks(packs.PLAYBOOKS, tmp_path / "absent").keys() == {p.playbook_id for p in packs.PLAYBOOKS}


def test_reference_material(tmp_path):
    laws = packs.load_provisions(write(tmp_path, "l.yaml", LAWS))
    assert [(x["ord"], x["category"], x["keywords"], x["status"], x["last_verified"]) for x in laws] == [(1, "其他", [], "active", "2026-01-02"), (2, "x", ["k"], "repealed", None)]
    (case,) = packs.load_cases(write(tmp_path, "c.yaml", "cases: [{title: t, court: c, keywords: [a, b]}]"))
    assert case["title"] == "t" and case["case_type"] == "" and case["keywords"] == ["a", "b"] and case["last_verified"] is None


def test_word_found_as_code_only_alone(spark):
    from pyspark.sql import functions as F

    from lexspan.operators.classify import code_hits

    texts = ["git x", "digit", "src/a", "xsrc/a", "requirements", "myrequirementsx"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(code_hits(F.col("t"), ["git", "src/", "requirements"])).collect()
    assert [r[0] for r in rows] == [1, 0, 0, 0, 1, 1]


def test_clause_patterns_of_a_file(tmp_path):
    text = """
patterns:
  - {regex: "^B", priority: 2, name: b}
  - {regex: "^A", priority: 1}
  - {regex: "(", priority: 0}
  - {name: none}
  - odd
  - {regex: "^C"}
title_keywords: [总则, 3, 附则]
"""
    path = tmp_path / "patterns.yaml"
    path.write_text(text, encoding="utf-8")
    assert packs.load_clause_patterns(path, ["x"], ["y"]) == (["^A", "^B", "^C"], ["总则", "附则"])
    path.write_text("patterns: odd", encoding="utf-8")
    assert packs.load_clause_patterns(path, ["x"], ["y"]) == (["x"], ["y"])
    with pytest.warns(UserWarning):
        assert packs.load_clause_patterns(tmp_path / "none.yaml", ["x"], ["y"]) == (["x"], ["y"])


def test_repealed_by_is_kept(tmp_path):
    path = tmp_path / "laws.yaml"
    path.write_text("legal_provisions:\n  - {law: a, article: b, title: c, content: d, status: repealed, repealed_by: e}\n  - {law: a, article: b, title: c, content: d}\n", encoding="utf-8")
    assert [x["repealed_by"] for x in packs.load_provisions(path)] == ["e", ""]
