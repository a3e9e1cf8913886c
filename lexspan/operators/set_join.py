"""Joins of sets by containment or Jaccard similarity, with filters that lose no pair.

Grams are put in one order for both sides, the rarest first. If two sets are
similar enough, one of the first grams of the left set, its prefix, is in the
right one; only those are joined. By Jaccard the same holds for a prefix of the right set.
Candidates stay if their sizes fit and if the grams behind the first common one
are enough; these are verified by their sets.

The right side's grams are cut to those that the left side has at all before
anything is shuffled by set. Sets that are then equal and were of one size are
one class, and so are equal left sets: pairs are those of classes, with the
number of rows of each, and memberships stand beside.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.operators.inverted import words
from lexspan.tables import small_side, written

MEASURES = ("containment", "jaccard")


def shingles(text: Column, n: int) -> Column:
    """The distinct runs of n words of a text, joined by spaces; a shorter text is one run, one without words none."""
    all_ = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    # bound to a name, so that the words are not found again for each run
    run = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    return F.array_distinct(F.filter(F.flatten(F.transform(F.array(all_), run)), lambda x: x != ""))


__all__ = ["SetPairs", "shingles", "similar", "words"]


@dataclass(frozen=True)
class SetPairs:
    """pairs (left, right, n_left, n_right, common, score) of classes; left_of and right_of are (id, class) of all rows that can be in a pair."""

    pairs: DataFrame
    left_of: DataFrame
    right_of: DataFrame


def _least(least: float, n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(least) * n - 1e-9))


def similar(left: DataFrame, right: DataFrame, least: float, measure: str = "containment", id_col: str = "id", set_col: str = "grams") -> SetPairs:
    """Classes of sets with at least this containment of left in right, or this Jaccard similarity.

    Both frames have an id and an array of grams; an id has one set, and rows
    that repeat it count once. A class is named by its smallest id. Repeated
    grams count once; null and empty sets are in no pair.
    """
    if measure not in MEASURES or not 0 < least <= 1:
        raise ValueError(f"{measure} of at least {least}")
    both = measure == "jaccard"
    own = lambda df: df.select(F.col(id_col).alias("id"), F.array_distinct(F.array_compact(set_col)).alias("grams")).where(F.size("grams") > 0)

    lefts = written(own(left).select("id", F.sort_array("grams").alias("grams")).distinct(), "left")
    l_classes = written(lefts.groupBy("grams").agg(F.min("id").alias("left"), F.count("*").alias("n_left")), "left-classes")
    l_grams = l_classes.select("left", F.size("grams").alias("l_size"), F.explode("grams").alias("gram"))
    vocabulary = small_side(written(l_grams.select("gram").distinct(), "vocabulary"))

    flat = own(right).select("id", F.size("grams").alias("r_size"), F.explode("grams").alias("gram"))
    cut = flat.join(vocabulary, "gram", "left_semi").groupBy("id", "r_size").agg(F.sort_array(F.collect_set("gram")).alias("grams"))
    rights = written(cut, "right")
    r_classes = written(rights.groupBy("grams", "r_size").agg(F.min("id").alias("right"), F.count("*").alias("n_right")), "right-classes")
    r_grams = r_classes.select(F.struct("right", "r_size").alias("r"), F.size("grams").alias("held"), F.explode("grams").alias("gram"))

    order = written(r_grams.groupBy("gram").agg(F.count("*").alias("n")), "order")
    place = lambda by: F.row_number().over(Window.partitionBy(by).orderBy("n", "gram")) - 1
    # grams that no right set has come first: they are in no other's way
    l_ranked = l_grams.join(order, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    l_first = l_ranked.withColumn("i", place("left")).where(F.col("i") <= F.col("l_size") - _least(least, F.col("l_size"))).where("n > 0")
    l_first = small_side(written(l_first.select("left", "l_size", "gram", "i"), "left-first"))
    if both:
        r_ranked = r_grams.join(order, "gram").withColumn("j", F.col("r.r_size") - F.col("held") + place("r"))
        r_first = r_ranked.where(F.col("j") <= F.col("r.r_size") - _least(least, F.col("r.r_size")))
    else:
        r_first = r_grams.withColumn("j", F.lit(0))
    met = r_first.join(l_first, "gram")
    needed = F.greatest(F.lit(1), F.ceil(F.lit(least / (1 + least)) * (F.col("l_size") + F.col("r.r_size")) - 1e-9)) if both else _least(least, F.col("l_size"))
    met = met.where(F.col("held") >= needed)
    if both:
        met = met.where((F.col("r.r_size") >= least * F.col("l_size") - 1e-9) & (F.col("l_size") >= least * F.col("r.r_size") - 1e-9))
    met = met.withColumn("needed", needed).groupBy("left", "l_size", "r", "needed").agg(F.min(F.struct("i", "j")).alias("at"))
    met = met.where(F.col("l_size") - F.col("at.i") >= F.col("needed"))
    if both:
        met = met.where(F.col("r.r_size") - F.col("at.j") >= F.col("needed"))

    l_sets = l_classes.select("left", "n_left", F.col("grams").alias("l_set"))
    r_sets = r_classes.select(F.struct("right", "r_size").alias("r"), "n_right", F.col("grams").alias("r_set"))
    full = met.join(l_sets, "left").join(r_sets, "r").withColumn("common", F.size(F.array_intersect("l_set", "r_set")).cast("long"))
    score = F.col("common") / (F.col("l_size") + F.col("r.r_size") - F.col("common") if both else F.col("l_size"))
    pairs = full.withColumn("score", score).where(F.col("score") >= least).select("left", F.col("r.right").alias("right"), "n_left", "n_right", "common", "score")
    left_of = lefts.join(l_classes, "grams").select("id", F.col("left").alias("class"))
    right_of = rights.join(r_classes, ["grams", "r_size"]).select("id", F.col("right").alias("class"))
    return SetPairs(pairs, left_of, right_of)
