import random

import corpus_pipeline
from lexspan.llm import mixing, scratch
from tests.llm.test_packing import whole


def test_sequences_hold_the_source_weights(spark):
    """A source with 2/3 of the rows takes its scheduled share of every stretch while all sources last."""
    rng = random.Random(5)
    text = lambda: "the " * rng.randrange(20, 500, 16)
    rows = [(i, text(), "hot" if i % 3 else f"s{i % 9 // 3}") for i in range(3600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slots = {r.doc_id: 1000 * r.slot + r.in_block for r in mixing.mix(df).collect()}
    mixed = scratch.written(dict(corpus_pipeline.STAGES)["mixing"](spark, df, ""), "test-mixed")
    out = dict(corpus_pipeline.STAGES)["packing"](spark, mixed, "").collect()
    whole(out, [r[:2] for r in rows])
    source = {r[0]: r[2] for r in rows}
    order = sorted(slots, key=slots.get)
    place = {i: k for k, i in enumerate(order)}
    n = max(r.sequence_id for r in out) + 1
    for part in range(4):
        here = [r for r in out if part * n // 4 <= r.sequence_id < (part + 1) * n // 4]
        got = sum(source[r.doc_id] == "hot" for r in here) / len(here)
        due = [source[i] == "hot" for i in order[part * len(order) // 4 : (part + 1) * len(order) // 4]]
        assert abs(got - sum(due) / len(due)) < 0.1, part
    off = sorted(abs(place[r.doc_id] / len(order) - r.sequence_id / n) for r in out)
    assert off[len(off) // 2] < 0.05
