"""Findings in model responses: the JSON value in a text, repaired fields, merged lists.

The JSON is found by counting brackets, which is beyond regular expressions;
one Arrow-batched function does that and the repair.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from lexspan.operators import rules
from lexspan.plans.packs import LEVELS

FENCE = re.compile(r"```(?:json)?\s*\n?(.*?)```", re.IGNORECASE | re.DOTALL)
#: fixed values
UNNAMED, OTHER, MODEL_RULE = "未知风险", "其他风险", "LLM_ANALYSIS"
CONFIDENCE = 0.7
TEXTS = ["id", "rule_id", "name", "category", "risk_level", "description", "clause_preview", "legal_basis", "suggestion"]
FINDING = StructType()
for _name in TEXTS:
    FINDING = FINDING.add(_name, StringType())
FINDING = ArrayType(FINDING.add("confidence", DoubleType()))


def _balanced(text: str) -> str | None:
    """From the first bracket to where its kind balances, if that is JSON; brackets inside strings count too."""
    first = re.search(r"[{\[]", text)
    if not first:
        return None
    pair = "{}" if first.group() == "{" else "[]"
    marks = [(m.end(), 1 if m.group() == pair[0] else -1) for m in re.compile(f"[{re.escape(pair)}]").finditer(text, first.start())]
    depth = accumulate(d for _, d in marks)
    end = next((e for (e, _), n in zip(marks, depth) if n == 0), None)
    if end is None:
        return None
    value = text[first.start() : end]
    try:
        json.loads(value)
    except ValueError:
        return None
    return value


def json_in(text: str | None) -> str | None:
    """The first JSON object or array of a text, that of a code fence before others; null if none parses."""
    text = text or ""
    fenced = FENCE.search(text)
    return (fenced and _balanced(fenced.group(1).strip())) or _balanced(text)


#: text fields of a finding: what stands for a missing one, and the longest kept
LIMITS = {"name": (UNNAMED, 100), "category": (OTHER, 50), "description": ("", None), "clause_preview": ("", 200)}
OPTIONAL = ("legal_basis", "suggestion")


def _listed(value) -> list:
    """The items of a parsed response: of an array, of an object's ``risks``, or the object itself."""
    match value:
        case {"risks": [*items]}:
            return items
        case dict():
            return [value]
    return value


def _sure(value) -> float:
    return round(float(value), 2) if isinstance(value, (int, float)) and 0 <= value <= 1 else CONFIDENCE


def findings_in(response: str | None) -> list[dict]:
    """Findings of an array, of an object's ``risks`` or of a single object, with repaired fields.

    An unknown level is medium, a confidence that is no number from 0 to 1 the
    standard one; long fields are cut. Numbers in ids count all items of the list.
    """
    items = [(f"LLM_RISK_{n:03d}", x) for n, x in enumerate(_listed(json.loads(json_in(response) or "[]")), 1) if isinstance(x, dict)]
    return [
        {"id": name, "rule_id": MODEL_RULE, "risk_level": next((v for v in LEVELS if v == x.get("risk_level")), "medium"), "confidence": _sure(x.get("confidence"))}
        | {k: str(x.get(k, other))[:most] for k, (other, most) in LIMITS.items()}
        | {k: str(x[k]) if x.get(k) else None for k in OPTIONAL}
        for name, x in items
    ]


@F.pandas_udf(StringType())
def extracted_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([json_in(x) for x in s], dtype="object")


@F.pandas_udf(FINDING)
def _findings(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([findings_in(x) for x in s], dtype="object")


def model_findings(responses: DataFrame, text: str = "response") -> DataFrame:
    """(doc_id, ord, id, rule_id, name, …) of the responses of documents; a response without JSON has none."""
    rows = responses.select("doc_id", F.posexplode(_findings(F.col(text))).alias("ord", "f"))
    return rows.select("doc_id", F.col("ord").cast("int").alias("ord"), "f.*")


def merged(ruled: DataFrame, model: DataFrame, apart: bool = True) -> DataFrame:
    """Rule findings, then model findings, without duplicates: (doc_id, ord, rule_id, name, category, risk_level, confidence, clause_preview).

    apart tells model findings apart by name and preview; otherwise their one
    rule id makes them duplicates of each other, and the highest level stays.
    """
    columns = ["doc_id", "ord", "rule_id", "name", "category", "risk_level", "confidence", "clause_preview"]
    first = ruled.withColumn("clause_preview", F.lit("")).select(*columns)
    after = model.withColumns({"ord": F.col("ord") + 1_000_000, "rule_id": F.lit("" if apart else MODEL_RULE)}).select(*columns)
    kept = rules.deduplicated(first.unionByName(after)).drop("place")
    return kept.withColumn("rule_id", F.when(F.col("rule_id") == "", MODEL_RULE).otherwise(F.col("rule_id")))


def tool_arguments(c: Column) -> Column:
    """Arguments of a tool call as a JSON object; what is none becomes ``{"raw": text}``."""
    parsed = F.try_parse_json(c)
    good = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return F.when(good, F.to_json(parsed)).otherwise(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("raw"))))
