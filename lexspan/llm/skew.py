"""Joins of rows to a table by a key that a third of all rows may share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm.scratch import fresh

HOT = 1000  # a key with 1/HOT of all rows is hot; there are at most HOT of them


def looked_up(rows: DataFrame, key: str, spread: Column, table: DataFrame, total: int, value: str) -> DataFrame:
    """rows with the value that a table (of, n, value) has for their key, null where it has none.

    n is the number of rows with the key ``of``, total that of all rows. Hot
    keys, at most ``HOT``, are told to every task; their rows go to the join by
    spread, an integer of the row, so that no task gets all rows of a key. A
    null key has a null value. rows may have columns of any name but ``value``.
    """
    at, found, deal, of, own, zero = fresh([*rows.columns, *table.columns], "hot", "found", "deal", "of", "own", "zero")
    hot = table.where(F.col("n") * HOT >= total).select(F.col("of").alias(at), F.col(value).alias(found))
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col(at), "left")
    alone = F.col(at).isNotNull() | F.col(key).isNull()
    rows = rows.withColumn(deal, F.when(alone, 1 + F.pmod(spread, F.lit(1 << 30))).otherwise(F.lit(0).cast("long")))
    rest = table.where(F.col("n") * HOT < total).select(F.col("of").alias(of), F.col(value).alias(own), F.lit(0).cast("long").alias(zero))
    out = rows.join(rest, (F.col(key) == F.col(of)) & (F.col(deal) == F.col(zero)), "left")
    return out.withColumn(value, F.coalesce(found, own)).drop(at, found, deal, of, own, zero)
