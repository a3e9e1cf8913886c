"""Connected components by repeated contraction, all in DataFrames.

In each round every node draws a number by hash of its name and the round and
points at the least draw among itself and its neighbours. Pointers are followed
to their ends by doubling, links are renamed and those inside one node vanish.
In any graph at most half of the nodes with links are expected to point at
themselves, so rounds grow with the logarithm of the nodes, for paths in any
order too. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.scratch import written


def _followed(moves: DataFrame, tag: str) -> DataFrame:
    """Written moves (u, m), each m replaced by the end of its chain of pointers."""
    step = 0
    while True:
        ahead = moves.where("u <> m").select(F.col("u").alias("at"), F.col("m").alias("next"))
        if step and moves.join(ahead, F.col("m") == F.col("at"), "left_semi").isEmpty():
            return moves
        moves = written(moves.join(ahead, F.col("m") == F.col("at"), "left").select("u", F.coalesce("next", "m").alias("m")), f"{tag}-{step}")
        step += 1


def components(links: DataFrame, tag: str) -> DataFrame:
    """(node, root) of all nodes of links (u, v); nodes of one component share their root, one of its nodes.

    Links of a node to itself and repeated links change nothing; without links
    there are no rows.
    """
    step = 0
    names = None
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        draw = lambda c: F.struct(F.xxhash64(F.lit(step), F.col(c)).alias("draw"), F.col(c).alias("name"))  # noqa: B023, E731
        least = both.groupBy("u").agg(F.min(draw("v")).alias("v"))
        moves = written(least.select("u", F.least(draw("u"), "v")["name"].alias("m")), f"{tag}-moves{step}")
        moves = _followed(moves, f"{tag}-moves{step}")
        if names is None:
            names = moves.select(F.col("u").alias("node"), F.col("m").alias("root"))
        else:
            names = names.join(moves, names.root == moves.u, "left").select("node", F.coalesce("m", "root").alias("root"))
            names = written(names, f"{tag}-names{step}")
        a = moves.select(F.col("u").alias("a"), F.col("m").alias("ma"))
        b = moves.select(F.col("u").alias("b"), F.col("m").alias("mb"))
        renamed = (
            links.join(a, links.u == a.a).join(b, links.v == b.b)
            .where("ma <> mb").select(F.least("ma", "mb").alias("u"), F.greatest("ma", "mb").alias("v")).distinct()
        )
        links = written(renamed, f"{tag}-links{step}")
        step += 1
        if links.isEmpty():
            return names
