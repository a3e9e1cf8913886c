import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexspan.llm.sharding import Leaf, grow, layout, shard_rows, sharded


def shards(df, leaves, name="s"):
    return sharded(df, F.col("id"), leaves, name)


def draw(h, path, weight):
    return -math.log(((h(path) & (2**64 - 1)) >> 12) * 2.0**-52 + 2.0**-53) / weight


def brute(h, leaves):
    """One node draw after another, from the root down."""
    at = lambda x, n: "/".join((x.region, x.rack, str(x.shard))[:n])
    path = ""
    for n in (1, 2, 3):
        weights = Counter()
        for x in leaves:
            if n == 1 or at(x, n - 1) == path:
                weights[at(x, n)] += x.weight
        path = min((p for p, w in weights.items() if w), key=lambda p: draw(h, p, weights[p]))
    return int(path.split("/")[2])


def test_descent_against_brute_force(spark):
    leaves = [Leaf(x.shard, x.region, x.rack, x.shard % 4) for x in layout(24)]
    paths = sorted({p for x in leaves for p in (x.region, f"{x.region}/{x.rack}", f"{x.region}/{x.rack}/{x.shard}")})
    keys = spark.range(500).select("id", *[F.xxhash64(F.lit(p), F.col("id")).alias(str(i)) for i, p in enumerate(paths)])
    got = {r.id: r.s for r in shards(spark.range(500), leaves).collect()}
    want = {r.id: brute(lambda p, r=r: r[str(paths.index(p))], leaves) for r in keys.collect()}
    assert got == want
    # a flat draw over all leaves ends elsewhere
    flat = {r.id: min((x for x in leaves if x.weight), key=lambda x: draw(lambda p: r[str(paths.index(p))], f"{x.region}/{x.rack}/{x.shard}", x.weight)).shard for r in keys.collect()}
    assert sum(got[i] != flat[i] for i in got) > 300


def test_rows_and_slots(docs, none):
    out = shard_rows(docs).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.key, r.size, r.text_crc32) for r in out) == want
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len({r.shard for r in out if r.key == 7}) == 1
    assert shard_rows(none).count() == 0


def test_a_new_shard_takes_rows_into_itself_alone(spark):
    leaves = layout(24)
    rows = spark.range(40_000)
    for step in range(3):
        rows = shards(rows, leaves, f"s{step}")
        leaves = grow(leaves)
    got = rows.collect()
    assert all(r.s1 in (r.s0, 24) and r.s2 in (r.s1, 25) for r in got)
    counts = Counter(r.s0 for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) < 1.15 * 40_000 / 24
    assert abs(sum(r.s1 == 24 for r in got) - 40_000 / 25) < 200


def test_a_weight_moves_rows_into_its_subtrees_alone(spark):
    """Shard 5 (region r0, rack k1) weighs more: every move ends in r0; inside r0 in k1; inside k1 in shard 5."""
    before = layout(24)
    heavier = [Leaf(x.shard, x.region, x.rack, 3.0 if x.shard == 5 else 1.0) for x in before]
    of = {x.shard: x for x in before}
    rows = shards(shards(spark.range(40_000), before, "b"), heavier, "h").collect()
    moved = [(of[r.b], of[r.h]) for r in rows if r.b != r.h]
    assert moved and all(h.region == "r0" for _, h in moved)
    assert all(h.rack == "k1" for b, h in moved if b.region == "r0")
    assert all(h.shard == 5 for b, h in moved if b.rack == "k1")
    assert any(b.region != "r0" for b, _ in moved) and any(b.region == "r0" and b.rack != "k1" for b, _ in moved)
    assert abs(sum(r.h == 5 for r in rows) - 3 * 40_000 / 26) < 400


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "x", 0, 1, "r")], "doc_id long, text string, key string, slot int, shard int, region string")
    assert [(r.key, r.slot, r.size) for r in shard_rows(df).collect()] == [(1, 0, 9)]


def test_numbers_do_not_follow_the_cluster(spark, real):
    rows = []
    for n in ("8", "3"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted((r.key, r.shard, r.slot) for r in shard_rows(real).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert rows[0] == rows[1]


def test_no_weight(spark):
    with pytest.raises(ValueError):
        shards(spark.range(1), [Leaf(0, "a", "b", 0)])
