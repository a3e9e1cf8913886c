"""Rule evaluation: documents against a pack, compiled into one projection.

Each rule becomes a nullable struct; a document's findings are one array that
is filtered and exploded. Nothing is joined or shuffled however many rules the
pack has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.text import keyword_hits, pattern_hits, similarity
from lexspan.plans.packs import LEVELS, NEUTRAL, Playbook, Rule

FINDING = "struct<ord:int,rule_id:string,name:string,category:string,risk_level:string,confidence:double>"


def level_rank(c: Column, unknown: int = 0) -> Column:
    out = F.lit(unknown)
    for name, rank in LEVELS.items():
        out = F.when(c == name, F.lit(rank)).otherwise(out)
    return out


def _missing(rule: Rule, text: Column) -> Column:
    """Confidence that a clause is missing, null if it is there."""
    words = rule.words("presence")
    hits = keyword_hits(text, words)
    there = pattern_hits(text, rule.substance) > 0
    partial = F.greatest(F.lit(0.3), 0.7 - 0.3 * (hits / max(len(words), 1)))
    return F.when(hits == 0, F.lit(0.9)).when(~there, partial)


def _condition(rule: Rule, text: Column) -> Column:
    """Confidence of a risk condition, null where there is none."""
    risk, safe = rule.words("risk"), rule.safe
    r, s = keyword_hits(text, risk), keyword_hits(text, safe)
    blocked = (r == 0) | ((s >= r) & (s > 0))
    if rule.require_safe_absence:
        blocked |= s > 0
    raw = 0.5 + 0.4 * (r / max(len(risk), 1)) - 0.4 * (s / max(len(safe), 1))
    return F.when(~blocked, F.greatest(F.lit(0.3), F.least(F.lit(0.95), raw)))


def findings(docs: DataFrame, rules: list[Rule], doc_type: str = "contract", playbook: Playbook = NEUTRAL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, ord, rule_id, name, category, risk_level, confidence) of every rule that applies."""
    body = F.col("__text")
    options = []
    for i, rule in enumerate(rules):
        if doc_type not in rule.types or rule.rule_id in playbook.excluded:
            continue
        if rule.missing:
            confidence, level = _missing(rule, body), playbook.levels.get(rule.rule_id, rule.level)
        else:
            confidence = _condition(rule, body)
            boost = rule.category in playbook.focus and LEVELS.get(rule.level, 2) < 3
            level = "high" if boost else rule.level
        one = F.struct(
            F.lit(i).alias("ord"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.name).alias("name"), F.lit(rule.category).alias("category"),
            F.lit(level).alias("risk_level"), confidence.cast("double").alias("confidence"),
        )
        options.append(one)
    lowered = docs.select(F.col(key).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__text"))
    found = F.filter(F.array(*options), lambda x: x["confidence"].isNotNull()) if options else F.array().cast(f"array<{FINDING}>")
    return lowered.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")


def described(risks: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings with the description, legal basis and suggestion of their rules, from a literal map of the pack."""
    told = [x for r in rules for x in (F.lit(r.rule_id), F.struct(*[F.lit(getattr(r, c)).alias(c) for c in ("description", "legal_basis", "suggestion")]))]
    return risks.withColumn("__rule", F.create_map(*told)[F.col("rule_id")]).select("*", "__rule.*").drop("__rule")


def level_counts(risks: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Findings per document and level; with docs, documents without findings too."""
    counts = risks.groupBy("doc_id").agg(F.count("*").alias("n_risks"), *[F.count_if(F.col("risk_level") == x).alias(f"n_{x}") for x in LEVELS])
    if docs is None:
        return counts
    return docs.select("doc_id").join(counts, "doc_id", "left").fillna(0)


def summary(risks: DataFrame) -> DataFrame:
    """One line per document: findings in order of the pack."""
    line = F.concat(F.lit("["), F.col("rule_id"), F.lit("]"), F.col("name"), F.lit("("), F.col("risk_level"), F.lit(")"))
    rows = risks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("x"))
    return rows.select("doc_id", F.array_join(F.transform("x", lambda r: r["line"]), "; ").alias("summary"))


def deduplicated(risks: DataFrame, limit: float = 0.8) -> DataFrame:
    """Of findings of a document with one rule the highest level, the first on ties, in the first one's place.

    Findings without a rule are duplicates of an earlier one where names agree,
    both have previews and those are more similar than the limit.
    """
    # one order for both, so that a finding is sorted once
    by_rule = Window.partitionBy("doc_id", "rule_id").orderBy(F.desc(level_rank(F.col("risk_level"))), "ord")
    every = by_rule.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ruled = risks.where("rule_id is not null and rule_id <> ''")
    best = ruled.select("*", F.min("ord").over(every).alias("place"), F.row_number().over(by_rule).alias("rn")).where("rn = 1").drop("rn")
    if "clause_preview" not in risks.columns:
        return best
    loose = risks.where("rule_id is null or rule_id = ''")
    a, b = loose.alias("a"), loose.alias("b")
    same = (
        (F.col("a.doc_id") == F.col("b.doc_id")) & (F.lower("a.name") == F.lower("b.name")) & (F.col("a.ord") > F.col("b.ord"))
        & (F.length("a.clause_preview") > 0) & (F.length("b.clause_preview") > 0)
        & (similarity(F.substring("a.clause_preview", 1, 100), F.substring("b.clause_preview", 1, 100)) > limit)
    )
    return best.unionByName(a.join(b, same, "left_anti").withColumn("place", F.col("ord")))


def traced(risks: DataFrame, clauses: DataFrame) -> DataFrame:
    """risks (doc_id, ord, name, clause_title, clause_preview, keywords) with the clause each is about.

    In this order: titles contain one another; for previews of over 20
    characters, content starts with 40 of them or contains 50; most keywords in
    any case. Risks of documents without clauses have no clause.
    """
    r, c = risks.alias("r"), clauses.select("doc_id", "clause_id", "title", "content").alias("c")
    title, preview = F.coalesce("r.clause_title", F.lit("")), F.coalesce("r.clause_preview", F.lit(""))
    named = (F.length(title) > 0) & (F.length(F.coalesce("c.title", F.lit(""))) > 0) & (F.contains(F.col("c.title"), title) | F.contains(title, F.col("c.title")))
    starts = (F.length(preview) > 20) & F.startswith(F.col("c.content"), F.substring(preview, 1, 40))
    inside = (F.length(preview) > 20) & F.contains(F.col("c.content"), F.substring(preview, 1, 50))
    content = F.lower("c.content")
    words = F.size(F.filter(F.col("r.keywords"), lambda k: F.contains(content, F.lower(k))))
    joined = r.join(c, F.col("r.doc_id") == F.col("c.doc_id"), "left").select(
        "r.*", F.col("c.clause_id").alias("linked_clause"), F.col("c.title").alias("linked_title"),
        F.when(named, 1).when(starts, 2).when(inside, 3).when(words > 0, 4).otherwise(9).alias("strategy"), F.when(~(named | starts | inside), words).otherwise(0).alias("score"),
    )
    order = Window.partitionBy("doc_id", "ord").orderBy("strategy", F.desc("score"), "linked_clause")
    best = joined.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn", "score")
    none = F.col("strategy") == 9
    return best.withColumns({"linked_clause": F.when(~none, F.col("linked_clause")), "linked_title": F.when(~none, F.col("linked_title")), "strategy": F.when(~none, F.col("strategy"))})
