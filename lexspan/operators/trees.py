"""Trees of ordered nodes with levels, and aggregates of their subtrees.

A node is inside the nearest one before it of a smaller level. Nodes are
numbered in order (pre); a subtree is a run of that order, whose last number
says where it closes. So a subtree's sums are differences of running sums, and
its depth is the number of runs that are open: nothing is walked and nothing
joined to itself. Rows meet by tree once, and are sorted forwards and back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 16  # levels 0 to LEVELS - 1


def _by_level(level: Column, values: list[Column]) -> Column:
    """The value at a level."""
    return F.get(F.array(*values), level)


def numbered(nodes: DataFrame, level: str, tree: str = "doc_id", order: str = "ord", value: str | None = None, levels: int = LEVELS) -> DataFrame:
    """nodes with pre, last, depth, parent_pre, n_descendants, and subtotal (of ``value``, its own and its subtree's; null counts 0).

    pre counts a tree's nodes in order from 1, last is the pre of the last node
    of the subtree (its own for a leaf), depth 0 that of a root. Levels are
    integers from 0 to ``levels`` - 1, and may skip; a null or larger level is
    taken as the deepest. Nodes of a tree have different places in its order. A
    tree is in one task. nodes has no columns of these names.
    """
    own = F.least(F.coalesce(F.col(level), F.lit(levels - 1)), F.lit(levels - 1))
    base = Window.partitionBy(tree).orderBy(order)
    before = base.rowsBetween(Window.unboundedPreceding, -1)
    df = nodes.withColumn("__level", own.cast("int")).withColumn("pre", F.row_number().over(base).cast("long"))
    amount = F.coalesce(F.col(value), F.lit(0)) if value else F.lit(1)
    df = df.withColumn("__before", F.coalesce(F.sum(amount).over(before), F.lit(0)))
    # the last node of each level before, and whether a smaller level has come since
    lasts = [F.coalesce(F.max(F.when(F.col("__level") == n, F.col("pre"))).over(before), F.lit(0)) for n in range(levels)]
    df = df.withColumn("__lasts", F.array(*lasts))
    at = [F.get("__lasts", F.lit(n)) for n in range(levels)]
    lower = [reduce(lambda a, b: F.greatest(a, b), at[:n], F.lit(0)) for n in range(levels)]
    open_ = [(at[n] > lower[n]).cast("int") for n in range(levels)]
    df = df.withColumn("depth", _by_level(F.col("__level"), [reduce(lambda a, b: a + b, open_[:n], F.lit(0)) for n in range(levels)]))
    parent = _by_level(F.col("__level"), lower)
    df = df.withColumn("parent_pre", F.when(parent > 0, parent)).drop("__lasts")
    # read back from the end: the first node behind of the same or a smaller level closes a subtree
    back = Window.partitionBy(tree).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(F.col("pre").alias("pre"), F.col("__before").alias("before"))
    closes = [F.min(F.when(F.col("__level") <= n, place)).over(back) for n in range(levels)]
    df = df.withColumn("__closes", F.array(*closes))
    total = Window.partitionBy(tree)
    df = df.withColumn("__end", F.struct((F.max("pre").over(total) + 1).alias("pre"), (F.sum(amount).over(total)).alias("before")))
    close = F.coalesce(F.get("__closes", F.col("__level")), F.col("__end"))
    df = df.withColumn("last", close["pre"] - 1).withColumn("subtotal", close["before"] - F.col("__before"))
    df = df.withColumn("n_descendants", F.col("last") - F.col("pre"))
    return df.drop("__level", "__before", "__closes", "__end")


def subtree(rows: DataFrame, tree: Column, pre: Column) -> DataFrame:
    """The node at pre of a tree (doc_id) and all below it, from numbered rows: a range of pre."""
    node = rows.where((F.col("doc_id") == tree) & (F.col("pre") == pre)).select(F.col("pre").alias("low"), F.col("last").alias("high"), F.col("doc_id").alias("of"))
    return rows.join(node, (F.col("doc_id") == F.col("of")) & F.col("pre").between(F.col("low"), F.col("high"))).drop("low", "high", "of")
