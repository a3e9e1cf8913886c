"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

Every node (region, rack, shard) makes one exponential draw for a key,
``-ln(u) / weight``, with u hashed from the key and the node's path and weight
the sum of the shards below it. A key descends to the region with the least
draw, there to the rack with the least draw, there to the shard: one draw for
each child of the nodes on its way, none for the rest of the tree. A node's
draw depends on its own path and weight alone. Where a shard gains weight, only
the nodes above it draw lower, so keys come into those subtrees from outside and
no others: at each level the nodes beside the changed one lose keys to it and
never trade with each other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm.ranks import SALTS, numbered
from lexspan.llm.scratch import fresh


@dataclass(frozen=True)
class Leaf:
    """A shard with its place in the tree and its weight (0: gets no rows)."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0


def layout(shards: int, per_rack: int = 4, racks_per_region: int = 3) -> list[Leaf]:
    """Shards 0.. in racks and regions."""
    rack = lambda i: i // per_rack
    return [Leaf(i, f"r{rack(i) // racks_per_region}", f"k{rack(i)}") for i in range(shards)]


def grow(leaves: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """leaves and one more shard in a region of its own, so that keys move into the new shard alone."""
    new = max((x.shard for x in leaves), default=-1) + 1
    taken = {x.region for x in leaves}
    region = next(r for r in (f"g{new}{'+' * k}" for k in range(len(taken) + 1)) if r not in taken)
    return [*leaves, Leaf(new, region, "k0", weight)]


def _draw(key: Column, path: str, weight: float) -> Column:
    h = F.xxhash64(F.lit(path), key)
    # 52 bits, moved by half a step: u is never 0 or 1
    u = (F.shiftrightunsigned(h, 12).cast("double") + 0.5) * F.lit(2.0**-52)
    return -F.log(u) / F.lit(float(weight))


def _least(key: Column, children: dict[str, float]) -> Column:
    """The place (int) of the child path with the least draw, the first on ties."""
    draws = [F.struct(_draw(key, path, w).alias("draw"), F.lit(i).alias("i")) for i, (path, w) in enumerate(children.items())]
    return F.lit(0) if len(draws) == 1 else F.array_min(F.array(*draws))["i"]


def _case(on: Column, results: Sequence[Column]) -> Column:
    """results[on]; only the chosen one is worked out."""
    out = results[-1]
    for i in reversed(range(len(results) - 1)):
        out = F.when(on == i, results[i]).otherwise(out)
    return out


def sharded(df: DataFrame, key: Column, leaves: Sequence[Leaf], name: str) -> DataFrame:
    """df with the shard (int) that each key's descent ends in. Null keys are a key like any other."""
    tree: dict[str, dict[str, dict[str, Leaf]]] = {}
    for x in leaves:
        if x.weight > 0:
            tree.setdefault(x.region, {}).setdefault(f"{x.region}/{x.rack}", {})[f"{x.region}/{x.rack}/{x.shard}"] = x
    if not tree:
        raise ValueError("no leaf has weight")
    below = lambda shards: sum(x.weight for x in shards.values())
    region, rack = fresh([*df.columns, name], "region", "rack")
    # a column for each level: the next level's choice reads it and draws for its children only
    df = df.withColumn(region, _least(key, {r: sum(map(below, racks.values())) for r, racks in tree.items()}))
    df = df.withColumn(rack, _case(F.col(region), [_least(key, {k: below(shards) for k, shards in racks.items()}) for racks in tree.values()]))

    def shard(shards: dict[str, Leaf]) -> Column:
        place = _least(key, {path: x.weight for path, x in shards.items()})
        return F.element_at(F.array(*[F.lit(x.shard) for x in shards.values()]), place + 1)

    chosen = _case(F.col(region), [_case(F.col(rack), [shard(shards) for shards in racks.values()]) for racks in tree.values()])
    return df.withColumn(name, chosen).drop(region, rack)


def shard_rows(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    leaves: Sequence[Leaf] | None = None,
    grown: Sequence[Leaf] | None = None,
) -> DataFrame:
    """One row per input row: key, size, text_crc32, shard, slot, grown_shard.

    shard depends on the key and the leaves alone; grown_shard is the shard
    under ``grown``, by default one more shard in a region of its own. slot
    numbers a shard's rows 0, 1, 2... Rows with the same key go to the same
    shard and get slots of their own. A null text counts as empty (size 8, crc
    0), a null key is a key like any other, an empty table gives no rows, other
    columns are not read, whatever their names.
    """
    leaves = leaves or layout(24)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    rows = sharded(rows, F.col("key"), leaves, "shard")
    rows = sharded(rows, F.col("key"), grown or grow(leaves), "grown_shard")
    salt = F.xxhash64(F.lit("slot"), F.col("key"), F.col("text_crc32"))
    return numbered(rows, ["shard"], salt, SALTS, ["key", "text_crc32"], "slot")
