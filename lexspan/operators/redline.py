"""Revised clauses: proposals, differences, and the trace of findings by clause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions.edit import difference
from lexspan.functions.text import escape_html, first_match, truncated
from lexspan.operators.report import redline_candidates
from lexspan.operators.rules import level_rank


def revisions(risks: DataFrame, most: int = 5, least: int = 10) -> DataFrame:
    """(doc_id, ord, name, original, revised) of the findings to revise; the suggestion is the revised text.

    Previews of fewer than ``least`` characters are not revised.
    """
    rows = redline_candidates(risks, most).where(F.length("clause_preview") >= least)
    return rows.select("doc_id", "ord", "name", F.col("clause_preview").alias("original"), F.col("suggestion").alias("revised"))


def clause_differences(revised: DataFrame) -> DataFrame:
    return revised.select("doc_id", "ord", "name", difference(F.col("original"), F.col("revised")).alias("html"))


def document_differences(revised: DataFrame) -> DataFrame:
    """(doc_id, html): a block with heading for each revision, in order."""
    block = F.concat(F.lit('<div class="revision"><h4>'), escape_html(F.coalesce("name", F.lit(""))), F.lit("</h4>"), F.col("html"), F.lit("</div>"))
    rows = clause_differences(revised).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", block.alias("block")))).alias("x"))
    return rows.select("doc_id", F.array_join(F.transform("x", lambda x: x["block"]), "\n").alias("html"))


def clause_trace(clauses: DataFrame, risks: DataFrame) -> DataFrame:
    """clauses (doc_id, clause_id, title, content) with n_risks, top_level and html; clauses without findings stay.

    risks carry linked_clause; findings of a clause are gathered before the join.
    """
    item = F.concat(F.lit('<li class="'), escape_html(F.col("risk_level")), F.lit('">'), escape_html(F.coalesce("name", F.lit(""))), F.lit("</li>"))
    by = risks.where("linked_clause is not null").groupBy("doc_id", F.col("linked_clause").alias("clause_id")).agg(
        F.count("*").alias("n_risks"), F.max_by("risk_level", F.struct(level_rank(F.col("risk_level")), -F.col("ord"))).alias("top_level"),
        F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))).alias("x"),
    )
    rows = clauses.join(by, ["doc_id", "clause_id"], "left")
    listed = F.coalesce(F.concat(F.lit("<ul>"), F.array_join(F.transform("x", lambda x: x["item"]), ""), F.lit("</ul>")), F.lit(""))
    html = F.concat(F.lit("<section><h4>"), escape_html(F.coalesce("title", F.lit(""))), F.lit("</h4>"), listed, F.lit("</section>"))
    return rows.select("doc_id", "clause_id", F.coalesce("n_risks", F.lit(0)).cast("long").alias("n_risks"), "top_level", html.alias("html"))


def step_log(steps: DataFrame, kinds: list[tuple[str, list[str]]], most: int = 120) -> DataFrame:
    """steps (run_id, step, content) as (run_id, step, kind, html); the first kind with a keyword, texts cut."""
    body = F.coalesce("content", F.lit(""))
    kind = first_match(F.lower(body), kinds, "other")
    html = F.concat(F.lit('<div class="'), kind, F.lit('">'), escape_html(truncated(body, most)), F.lit("</div>"))
    return steps.select("run_id", "step", kind.alias("kind"), html.alias("html"))


def flattened(tree: DataFrame, content: str = "content") -> DataFrame:
    """(doc_id, ord, parent, title, content, n_children) of a clause tree; contents are cut at 200 characters."""
    children = tree.where("parent is not null").groupBy("doc_id", F.col("parent").alias("ord")).agg(F.count("*").alias("n"))
    rows = tree.join(children, ["doc_id", "ord"], "left")
    return rows.select("doc_id", "ord", "parent", "title", truncated(F.col(content), 200).alias("content"), F.coalesce("n", F.lit(0)).cast("long").alias("n_children"))


def citation_text(law: Column, article: Column, title: Column) -> Column:
    return F.concat(F.lit("《"), law, F.lit("》"), article, F.when(F.length(title) > 0, F.concat(F.lit("（"), title, F.lit("）"))).otherwise(F.lit("")))
