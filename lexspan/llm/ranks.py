"""Gapless numbers inside groups, without one task per group.

A group may hold a third of all rows. Rows are dealt by (group, salt), numbered
inside each salt, and shifted by the rows in earlier salts. Only the counts by
(group, salt), at most ``salts`` rows a group, meet by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.llm.scratch import fresh

#: salts of a group: fixed, so that numbers depend on the rows and not on the cluster; a window holds 1/SALTS of a group
SALTS = 256


def numbered(df: DataFrame, groups: list[str], salt: Column, salts: int, order: list, name: str) -> DataFrame:
    """df with a long column ``name``: 0, 1, 2... inside each group.

    salt is an expression of the row (never of its place in a partition), so
    that a task that runs again deals the rows the same way. The order holds
    inside a salt; rows that tie on it get any of their numbers. Groups of
    null are groups like any other.
    """
    s, n, base, of, group, own = fresh([*df.columns, name], "salt", "n", "base", "of", "group", "own")
    # one key for all groups, in which nulls are equal, so that the window's partitioning serves the join as well
    df = df.withColumn(s, F.pmod(salt, F.lit(salts)).cast("int")).withColumn(group, F.struct(*groups))
    counts = df.groupBy(group, s).agg(F.count("*").alias(n))
    before = Window.partitionBy(group).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col(group).alias(own), F.col(s).alias(of), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(group, s).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(inside).cast("long") - 1)
    # every (group, salt) of ranked has its base, so inner loses no row
    joined = ranked.join(bases, (F.col(group) == F.col(own)) & (F.col(s) == F.col(of)), "inner")
    return joined.withColumn(name, F.col(name) + F.col(base)).drop(s, of, base, group, own)
