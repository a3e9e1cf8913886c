"""Rule evaluation with the pack as a table, for packs of any size.

All keywords of a pack share one dictionary: each is listed under its rarest
gram, as counted in the ``SAMPLE`` documents with the smallest hashes. A
document's distinct grams are joined with the dictionary, and what meets is
verified in the text; so a document costs its length and the keywords near a
hit, however many rules there are. Nothing is shuffled where the dictionary can
be told to all tasks: a document's grams meet it in the document's own row. A
larger one (``tables.SMALL`` keywords) meets the grams by a shuffle and the
texts after it.

The findings are those of ``rules.findings``.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.plans.packs import LEVELS, NEUTRAL, Playbook, Rule
from lexspan.tables import pieces, small_side, written

GRAM = 3  # characters of a gram; a shorter keyword is its own
SAMPLE = 500
FIELDS = ("presence", "risk", "safe")


def grams(text: Column, sizes: list[int]) -> Column:
    """The distinct grams of a text of these sizes."""
    none = F.array().cast("array<string>")

    def of(n: int) -> Column:
        run = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), ""))
        # bound to a name, so that the text is split once
        return F.flatten(F.transform(F.array(F.split(text, "")), lambda w: F.when(F.size(w) >= n, run(w)).otherwise(none)))

    return F.array_distinct(F.concat(*map(of, sizes)))


def _pack(rules: list[Rule], doc_type: str, playbook: Playbook) -> tuple[list[tuple], list[tuple]]:
    """Rows of the keywords (ord, field, word, patterns) and of the rules that apply."""
    words, rows = [], []
    for i, rule in enumerate(rules):
        if doc_type not in rule.types or rule.rule_id in playbook.excluded:
            continue
        used = ("presence",) if rule.missing else ("risk", "safe")
        lists = {f: rule.words(f) if f != "safe" else rule.safe for f in used}
        for f in used:
            words += [(i, FIELDS.index(f), w, list(rule.substance) if f == "presence" else []) for w in lists[f]]
        if rule.missing:
            level = playbook.levels.get(rule.rule_id, rule.level)
        else:
            level = "high" if rule.category in playbook.focus and LEVELS.get(rule.level, 2) < 3 else rule.level
        sizes = [len(lists.get(f, ())) for f in FIELDS]
        rows.append((i, rule.rule_id, rule.name, rule.category, level, rule.missing, rule.require_safe_absence, *sizes))
    return words, rows


RULE = "ord int, rule_id string, name string, category string, risk_level string, missing boolean, strict boolean, n_presence int, n_risk int, n_safe int"


def dictionary(docs: DataFrame, words: list[tuple], text: str) -> DataFrame:
    """Written (gram, ord, field, n, word, patterns): each keyword under its rarest gram; n numbers the keywords."""
    spark = docs.sparkSession
    rows = [(n, *w, sorted({w[2][i : i + GRAM] for i in range(max(1, len(w[2]) - GRAM + 1))})) for n, w in enumerate(words) if w[2]]
    listed = written(spark.createDataFrame(rows, "n int, ord int, field int, word string, patterns array<string>, grams array<string>"), "keywords")
    every = listed.select(F.explode("grams").alias("gram"), *[c for c in listed.columns if c != "grams"])
    some = docs.select(F.lower(F.coalesce(F.col(text), F.lit(""))).alias("body")).orderBy(F.xxhash64("body")).limit(SAMPLE)
    seen = some.select(F.explode(grams(F.col("body"), [GRAM])).alias("gram")).groupBy("gram").agg(F.count("*").alias("seen"))
    order = Window.partitionBy("n").orderBy(F.coalesce("seen", F.lit(0)), "gram")
    first = every.join(seen, "gram", "left").withColumn("place", F.row_number().over(order)).where("place = 1")
    return written(first.drop("seen", "place"), "dictionary")


COUNTED = "doc_id {}, body string, counts array<struct<ord:int,presence:int,risk:int,safe:int,patterns:array<string>>>"


def _counted(bodies: DataFrame, listed: DataFrame, empty: list[tuple], missing: list[int]) -> DataFrame:
    """(doc_id, ord, presence, risk, safe, there) of the rules that a document has a keyword of, and of those about a missing clause.

    The dictionary is told to all tasks. A document is one row: its grams meet
    the dictionary's in a set, so that its text is not copied for each of them.
    """
    by_gram: dict[str, list[tuple]] = {}
    for r in listed.collect():  # at most SMALL keywords
        by_gram.setdefault(r["gram"], []).append((r["word"], r["ord"], r["field"], r["patterns"]))
    told = bodies.sparkSession.sparkContext.broadcast((by_gram, [(o, f, p) for o, f, _, p in empty]))

    def run(batches):
        listed, always = told.value
        sizes = sorted({len(g) for g in listed})
        names = ["ord", *FIELDS, "patterns"]
        for batch in pieces(batches):
            texts, lists = [], []
            for body in batch.column(1).to_pylist():
                own = {o: [o, 0, 0, 0, []] for o in missing}
                met = [w[1:] for n in sizes for g in listed.keys() & {body[i : i + n] for i in range(len(body) - n + 1)} for w in listed[g] if w[0] in body]
                for o, field, patterns in (*met, *always):
                    row = own.setdefault(o, [o, 0, 0, 0, []])
                    row[1 + field] += 1
                    if patterns:
                        row[4] = patterns
                lists.append([dict(zip(names, row)) for row in own.values()])
                texts.append(body if any(row[4] for row in own.values()) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lists, kind)], names=["doc_id", "body", "counts"])

    kind = pa.list_(pa.struct([("ord", pa.int32()), *[(f, pa.int32()) for f in FIELDS], ("patterns", pa.list_(pa.string()))]))
    found = bodies.mapInArrow(run, COUNTED.format(bodies.schema["doc_id"].dataType.simpleString()))
    # patterns are Spark's, so they are matched by it, before a row becomes many
    sure = F.transform("counts", lambda c: F.struct(*[c[n].alias(n) for n in ("ord", *FIELDS)], F.exists(c["patterns"], lambda p: F.regexp_like("body", p)).alias("there")))
    return found.select("doc_id", F.explode(sure).alias("c")).select("doc_id", "c.*")


def _scored(scored: DataFrame) -> DataFrame:
    """The findings among rows of counts and their rules."""
    p, r, s = F.col("presence"), F.col("risk"), F.col("safe")
    share = lambda c, size: c / F.greatest(F.col(size), F.lit(1))
    blocked = (r == 0) | ((s >= r) & (s > 0)) | (F.col("strict") & (s > 0))
    lacking = F.when(p == 0, F.lit(0.9)).when(~F.col("there"), F.greatest(F.lit(0.3), 0.7 - 0.3 * share(p, "n_presence")))
    found = F.when(F.col("missing"), lacking).otherwise(F.when(~blocked, F.greatest(F.lit(0.3), F.least(F.lit(0.95), 0.5 + 0.4 * share(r, "n_risk") - 0.4 * share(s, "n_safe")))))
    return scored.withColumn("confidence", found.cast("double")).where("confidence is not null")


def findings(docs: DataFrame, rules: list[Rule], doc_type: str = "contract", playbook: Playbook = NEUTRAL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, ord, rule_id, name, category, risk_level, confidence) of every rule that applies, as ``rules.findings``.

    Keys of documents differ. A null text is empty. Keywords that are empty
    are in every text.
    """
    spark = docs.sparkSession
    words, rows = _pack(rules, doc_type, playbook)
    told = small_side(written(spark.createDataFrame(rows, RULE), "rules"))
    bodies = docs.select(F.col(key).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("body"))
    there = lambda: F.exists("patterns", lambda p: F.regexp_like("body", p)).alias("there")
    hit = ["doc_id", "ord", "field"]

    empty = [w for w in words if not w[2]]
    lacking = [dict(zip(("ord", "rule_id", "name", "category", "risk_level"), row)) for row in rows if row[5]]
    columns = ["doc_id", "ord", "rule_id", "name", "category", "risk_level", "confidence"]
    listed = dictionary(docs, words, text)
    near = small_side(listed)
    if near is not listed:
        counts = _counted(bodies, listed, empty, [row["ord"] for row in lacking])
        return _scored(counts.join(told, "ord")).select(*columns)
    sizes = sorted({r[0] for r in listed.select(F.length("gram")).distinct().collect()})  # at most GRAM
    pairs = bodies.select("doc_id", F.explode(grams(F.col("body"), sizes)).alias("gram")).join(listed, "gram").drop("gram")
    hits = pairs.join(bodies, "doc_id").where(F.contains("body", F.col("word"))).select(*hit, there())
    if empty:
        every = F.from_json(F.lit(json.dumps([{"ord": w[0], "field": w[1], "patterns": w[3]} for w in empty])), "array<struct<ord:int,field:int,patterns:array<string>>>")
        always = bodies.select("doc_id", "body", F.explode(every).alias("w")).select("doc_id", "body", "w.*")
        hits = hits.unionByName(always.select(*hit, there()))

    n = lambda f: F.count_if(F.col("field") == FIELDS.index(f)).alias(f)
    counts = hits.groupBy("doc_id", "ord").agg(*[n(f) for f in FIELDS], F.max("there").alias("there"))
    scored = counts.join(told, "ord")
    some = _scored(scored).select(*columns)
    if not lacking:
        return some
    # a rule about a missing clause has a finding wherever it has no hit, so the whole list meets each document in its own row
    listed_rules = F.from_json(F.lit(json.dumps(lacking)), "array<struct<ord:int,rule_id:string,name:string,category:string,risk_level:string>>")
    present = scored.where("missing").groupBy("doc_id").agg(F.collect_set("ord").alias("present"))
    rest = bodies.select("doc_id").join(present, "doc_id", "left").withColumn("rule", F.explode(listed_rules))
    none = rest.where(F.col("present").isNull() | ~F.array_contains("present", F.col("rule.ord"))).select("doc_id", "rule.*", F.lit(0.9).alias("confidence"))
    return some.unionByName(none.select(*columns))
