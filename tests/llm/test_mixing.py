import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import islice

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.llm import mixing


@pytest.mark.parametrize(
    "targets, slots",
    [
        ({"a": 1}, 50), ({"a": 1, "b": 1}, 50), ({"a": 7, "b": 2, "c": 1}, 1000), ({"a": 499, "b": 300, "c": 200, "d": 1}, 5000), ({f"s{i}": 3 + i % 7 for i in range(40)}, 3000),
        ({"a": 3337, "b": 3331, "c": 3332.6, "d": 0.3}, 200_000), ({"a": "1/3", "b": 0.1234567, "c": 0.0000001, "d": 5}, 1_000_000),
    ],
)
def test_deviation_from_the_given_targets_is_below_one_block(targets, slots):
    exact = {s: Fraction(str(w)) for s, w in targets.items()}
    total, names = sum(exact.values()), list(exact)
    order = np.array([names.index(s) for s in islice(mixing.earliest_deadline_first(mixing.integer_weights(targets)), slots)])
    t = np.arange(1, slots + 1)
    for k, s in enumerate(names):
        off = np.cumsum(order == k) - t * float(exact[s] / total)
        assert np.abs(off).max() < 1 + 1e-6


def test_exact_ratios():
    assert mixing.integer_weights({"a": 0.1, "b": "0.2", "c": 0, "d": Fraction(1, 3)}) == {"a": 3, "b": 6, "d": 10}
    with pytest.raises(ValueError):
        mixing.integer_weights({"a": -1})


def brute(blocks, weights):
    """Slot by slot; a new schedule whenever a source's turn comes and it has run out."""
    left, out, done = {s: n for s, n in blocks.items() if n}, [], Counter()
    while left:
        active = mixing.integer_weights({s: weights[s] for s in left if weights.get(s)}) or dict.fromkeys(left, 1)
        rounds = min(left[s] // a for s, a in active.items())
        slots = 0
        for s in mixing.earliest_deadline_first(active):
            if not left[s] or (rounds and slots == rounds * sum(active.values()) and not left[s]):
                break
            out.append((s, done[s]))
            done[s] += 1
            left[s] -= 1
            slots += 1
        left = {s: n for s, n in left.items() if n}
    return out


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 2}, {"a": 0.5, "b": 0.3331, "c": 0}, {"a": 1}])
@pytest.mark.parametrize("blocks", [{"a": 50, "b": 3, "c": 17}, {"a": 1, "b": 1}, {"a": 0, "b": 9}, {"a": 200, "b": 100, "c": 100, "d": 5}, {"a": 1, "b": 20_000}])
def test_phases_place_every_block_once(blocks, weights):
    placed = {}
    for p in mixing.phases(blocks, weights):
        for b in range(p["lo"], p["hi"]):
            since, n = b - p["lo"], len(p["slots"])
            slot = p["first"] + since // n * p["period"] + p["slots"][since % n]
            assert slot not in placed
            placed[slot] = (p["source"], b)
    assert sorted(placed) == list(range(sum(blocks.values())))
    assert [placed[t] for t in range(len(placed))] == brute(blocks, weights)
    assert sum(len(p["slots"]) for p in mixing.phases(blocks, weights)) <= mixing._slots(blocks, weights)


def test_long_plans_get_larger_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PLAN", 50)
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 > 0, "a").otherwise("b").alias("source"))
    out = mixing.mix(df, block_rows=4, targets={"a": 7919, "b": 7907}).collect()
    assert len(out) == 4000 and len({(r.slot, r.in_block) for r in out}) == 4000 and 50 <= max(r.slot for r in out) + 1 <= 52


def test_one_row_with_a_large_target(spark):
    df = spark.createDataFrame([(1, "rare"), *((i, "rest") for i in range(2, 102))], "doc_id long, source string")
    out = mixing.mix(df, block_rows=1, targets={"rare": 1000}).collect()
    assert sorted(r.slot for r in out) == list(range(101)) and [r.slot for r in out if r.source == "rare"] == [0]


def test_rows(spark, docs, real):
    df = docs.withColumn("source", F.when(F.col("doc_id") > 5, "x"))
    df = df.withColumns({c: F.lit("clash") for c in ("slot", "block", "lo", "hi", "weight", "first", "period", "slots", "rank", "row")})
    out = mixing.mix(df, block_rows=2).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((r.doc_id, r.source) for r in df.collect())
    assert len({(r.slot, r.in_block) for r in out}) == len(out)
    mixed = mixing.mixed(df, block_rows=2)
    assert mixed.columns == df.columns and Counter(mixed.collect()) == Counter(df.collect())
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


def test_weights_hold_in_every_prefix(real):
    out = mixing.mix(real, block_rows=4, targets={f"src{i}": 1 + i % 3 for i in range(20)}).collect()
    by = defaultdict(set)
    for r in out:
        by[r.slot].add((r.source, r.weight))
    assert sorted(by) == list(range(len(by))) and all(len(x) == 1 for x in by.values())
    weights = {f"src{i}": 1 + i % 3 for i in range(20)}
    ends = {}
    for r in out:
        ends[r.source] = max(ends.get(r.source, 0), r.slot)
    first_end = min(ends.values())
    had, total = Counter(), sum(weights.values())
    for t in range(first_end):
        had[next(iter(by[t]))[0]] += 1
        assert all(abs(had[s] - (t + 1) * w / total) < 1 for s, w in weights.items())


def test_order_is_written(spark, real, tmp_path):
    mixing.mixed(real, block_rows=4).write.parquet(str(tmp_path / "m"))
    read = spark.read.parquet(str(tmp_path / "m"))
    assert Counter(read.collect()) == Counter(real.collect())


def test_main_path_is_native(real):
    assert not re.search("Python|Pandas|Arrow", mixing.mix(real)._jdf.queryExecution().toString())
