"""Metrics of events as sketches: by hour and stage first, merged to days or more without the events.

Quantiles are kept as KLL sketches and distinct users as HyperLogLog sketches,
so an hour's row has a bounded size whatever its events, and hours merge in any order
and grouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KLL = 400  # items of a quantile sketch; its ranks are off by about 0.0066 at most, in 99 of 100 sketches
HLL = 13  # logarithm of a distinct sketch's registers; its relative standard error is about 0.8 / 2^(HLL / 2) = 0.009
RANK_ERROR, DISTINCT_ERROR = 0.014, 0.04  # of an estimate, with room for the sketches' chance


def hourly(events: DataFrame, stage: str = "event_type", value: str = "value", who: str = "user_id", ts: str = "ts") -> DataFrame:
    """(day, hour, stage, n, n_values, total, quantiles, users): one row for each hour and stage; null values and users are in no sketch, rows without a time in no row."""
    rows = events.where(F.col(ts).isNotNull()).select(F.to_date(ts).alias("day"), F.hour(ts).alias("hour"), F.col(stage).alias("stage"), F.col(value).cast("double").alias("value"), F.col(who).alias("who"))
    return rows.groupBy("day", "hour", "stage").agg(
        F.count("*").alias("n"), F.count("value").alias("n_values"), F.sum("value").alias("total"),
        F.kll_sketch_agg_double("value", KLL).alias("quantiles"), F.hll_sketch_agg("who", HLL).alias("users"),
    )


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The same by these of its keys (of day, hour, stage), from the sketches alone."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"),
        F.kll_merge_agg_double("quantiles", KLL).alias("quantiles"), F.hll_union_agg("users").alias("users"),
    )


def told(sketches: DataFrame, ranks: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """The keys of sketches with n, mean, users (about), and the values at these ranks (p50 for 0.5); null where there is no value."""
    keys = [c for c in sketches.columns if c not in ("n", "n_values", "total", "quantiles", "users")]
    some = F.col("n_values") > 0
    at = [F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(r))).alias(f"p{r * 100:g}".replace(".", "_")) for r in ranks]
    return sketches.select(*keys, "n", F.when(some, F.col("total") / F.col("n_values")).alias("mean"), F.hll_sketch_estimate("users").alias("users"), *at)
