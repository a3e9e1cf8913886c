"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks. Target weights are taken as the exact
fractions that they are written as, and brought to integers that add up to a
period of P slots: block i of a source of weight a is released at floor(i P / a)
and due at ceil((i + 1) P / a), and in each slot the released block with the
earliest deadline goes next. After any number t of slots a source has had more
than t a / P - 1 and less than t a / P + 1 blocks. When a source runs out, the
others start a new schedule among themselves. Nothing is dropped or repeated.

The schedule repeats every period, so a period, or the slots up to a source's
end if those are fewer, is worked out per set of sources, and every block finds
its slot by arithmetic. Where both are longer than ``PLAN`` slots, blocks get
more rows, so that the plan keeps its size; the bound of one block stays.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.ranks import SALTS, numbered
from lexspan.llm.scratch import fresh, partitions, written

PLAN = 1 << 20
BLOCK_ROWS = 16
SOURCES = 2000  # whose plan, a row for each two sources at most, is told to all tasks


def integer_weights(targets: dict) -> dict:
    """Integers in exactly the ratio of the targets (numbers, fractions or decimal strings); sources of weight 0 are left out."""
    exact = {s: Fraction(str(w)) for s, w in targets.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError("a target weight is negative")
    exact = {s: w for s, w in exact.items() if w}
    common = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * common) for s, w in exact.items()}
    divisor = math.gcd(*whole.values())
    return {s: w // divisor for s, w in whole.items()}


def earliest_deadline_first(weights: dict) -> Iterator:
    """The source of each slot, without end, for integer weights."""
    names, rates = list(weights), list(weights.values())
    period = sum(rates)
    waiting = [(0, k, 0) for k in range(len(rates))]  # release, source, block
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // rates[k]), k, i))
        _, k, i = heapq.heappop(ready)
        heapq.heappush(waiting, ((i + 1) * period // rates[k], k, i + 1))
        yield names[k]
        t += 1


def phases(blocks: dict, weights: dict) -> list[dict]:
    """A row for each schedule and source: blocks lo to hi - 1, weight, first slot, period, places of its blocks in the period.

    A block is at first + (block - lo) // len(slots) * period + slots[(block - lo) % len(slots)].
    Sources without weight come after all others, as if of equal weights.
    """
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(blocks, 0)
    start, out = 0, []
    while left:
        active = integer_weights({s: weights[s] for s in left if weights.get(s)}) or dict.fromkeys(left, 1)
        period = sum(active.values())
        rounds = min(left[s] // a for s, a in active.items())  # whole periods before a source runs out
        order = list(islice(earliest_deadline_first(active), period)) if rounds else earliest_deadline_first(active)
        rest = {s: left[s] - rounds * a for s, a in active.items()}
        places: dict = {s: [] for s in active}
        length = 0  # slots of the last, partial period
        for s in order:
            if not rest[s]:
                break
            rest[s] -= 1
            if not rounds:
                places[s].append(length)
            length += 1
        if rounds:
            for t, s in enumerate(order):
                places[s].append(t)
        for s, a in active.items():
            had = left[s] - rest[s]
            if had:
                out.append({"source": s, "lo": done[s], "hi": done[s] + had, "weight": a, "first": start, "period": period, "slots": places[s]})
            done[s] += had
            left[s] = rest[s]
        start += rounds * period + length
        left = {s: n for s, n in left.items() if n}
    return out


def _slots(blocks: dict, weights: dict) -> int:
    """At most so many slots are worked out by phases: the lesser of all blocks and all periods."""
    gone = sorted(((n / float(Fraction(str(weights[s]))) if weights.get(s) else math.inf, str(s), s) for s, n in blocks.items()), key=lambda x: x[:2])
    periods, most = 0, sum(blocks.values())
    for k in range(len(gone)):
        active = integer_weights({s: weights[s] for _, _, s in gone[k:] if weights.get(s)})
        periods += sum(active.values()) or len(gone) - k
        if periods > most:
            return most
    return periods


def scheduled(df: DataFrame, source: str, rank: str, block_rows: int = BLOCK_ROWS, targets: dict | None = None, default: object = 1, tag: str = "mixing") -> DataFrame:
    """df with the weight, block, slot and in_block of each row; rank numbers a source's rows from 0.

    targets are weights by source (null: None), exact as written; a source
    that they do not name has the default weight, and one of weight 0 comes
    after all others. df has no columns of these names.
    """
    spark = df.sparkSession
    counts = {r[0]: r[1] for r in df.groupBy(source).agg(F.count("*")).limit(SOURCES + 1).collect()}
    if len(counts) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources: mix groups of sources")
    weights = {s: (targets or {}).get(s, default) for s in counts}
    blocked = lambda rows: {s: -(-n // rows) for s, n in counts.items()}
    total = sum(counts.values())
    if _slots(blocked(block_rows), weights) > PLAN:
        block_rows = max(block_rows, -(-total // PLAN))
    plan = phases(blocked(block_rows), weights)
    kind = "array<struct<source:string,lo:bigint,hi:bigint,weight:bigint,first:bigint,period:bigint,slots:array<int>>>"
    own = fresh([*df.columns, "weight", "block", "slot", "in_block"], "p_source", "lo", "hi", "first", "period", "slots")
    p_source, lo, hi, first, period, slots = own
    told = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(plan)), kind)).alias("p")).select("p.*")
    told = written(told.toDF(p_source, lo, hi, "weight", first, period, slots), f"{tag}-plan")
    df = df.withColumn("block", F.floor(F.col(rank) / block_rows).cast("long"))
    match = F.col(source).eqNullSafe(F.col(p_source)) & (F.col("block") >= F.col(lo)) & (F.col("block") < F.col(hi))
    since = F.col("block") - F.col(lo)
    many = F.size(slots)
    slot = F.col(first) + F.floor(since / many) * F.col(period) + F.get(F.col(slots), (since % many).cast("int"))
    # the ranges of a source cover its blocks once, so inner neither loses nor repeats a row; the plan holds PLAN slots and SOURCES**2 / 2 rows at most
    joined = df.join(F.broadcast(told), match, "inner")
    return joined.withColumn("slot", slot.cast("long")).withColumn("in_block", (F.col(rank) % block_rows).cast("int")).drop(*own)


def _ranked(rows: DataFrame) -> DataFrame:
    return numbered(rows, ["source"], F.xxhash64("doc_id"), SALTS, ["doc_id"], "rank")


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS, targets: dict | None = None, default: object = 1, tag: str = "mixing"
) -> DataFrame:
    """(doc_id, source, weight, block, slot, in_block) of every row.

    slot orders the blocks of all sources, in_block the rows of a block. After
    t slots, while all sources last, a source has had its target share of t,
    off by less than one block. A null source is a source of its own; repeated
    rows get places of their own; an empty table gives no rows; other columns
    are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"))
    return scheduled(_ranked(rows), "source", "rank", block_rows, targets, default, tag).select("doc_id", "source", "weight", "block", "slot", "in_block")


def mixed(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS, targets: dict | None = None, default: object = 1, tag: str = "mixing"
) -> DataFrame:
    """docs in the order of the schedule, over partitions by range of it; every row stays once, with its columns.

    Null sources, repeated rows and empty tables are as in mix.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"))
    placed = scheduled(_ranked(rows), "source", "rank", block_rows, targets, default, tag)
    order = ["slot", "in_block"]
    return placed.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("row.*")
