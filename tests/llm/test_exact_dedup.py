import hashlib
from collections import defaultdict

import pytest

from lexspan.llm.exact_dedup import ContentTable, ExactGroups


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def told(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()], key=str)


@pytest.mark.parametrize("table_bytes,flush_bytes", [(64 << 20, 48 << 20), (400, 600)])
def test_against_brute_force(docs, table_bytes, flush_bytes):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = ExactGroups(docs, table_bytes=table_bytes, flush_bytes=flush_bytes)
    decisions = found.decisions()
    assert told(decisions) == brute(rows)
    kept = [(r.doc_id, r.text_sha256) for r in decisions.collect() if r.kept]
    assert len(kept) == len(set(kept)) == len({t or "" for _, t in rows})
    stay = found.kept()
    assert stay.columns == docs.columns
    assert {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in stay.collect()} == set(kept)


def test_levels_of_spill(spark, real):
    found = ExactGroups(real, table_bytes=20_000, flush_bytes=100_000)
    assert told(found.decisions()) == brute([(r.doc_id, r.text) for r in real.collect()])


def test_left_over_content_goes_on_whole(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t" * 50), (F.col("id") % 700)).alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        from lexspan.llm import exact_dedup

        found = ExactGroups(df, table_bytes=30_000)
        assert told(found.decisions()) == brute([(r.doc_id, r.text) for r in df.collect()])
        assert exact_dedup.partitions(spark) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_many_rows_in_a_batch(spark):
    from pyspark.sql import functions as F

    df = spark.range(9000).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 4001)).alias("text"))
    assert told(ExactGroups(df).decisions()) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_empty_table(none):
    found = ExactGroups(none)
    assert found.decisions().count() == 0 and found.kept().count() == 0


def test_table_compares_content_not_hashes(monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda content: 7)
    table = ContentTable(4)
    assert [table.put(x) for x in (b"a", b"b", b"a", b"c", b"d", b"b", b"e")] == [0, 1, 0, 2, 3, 1, 4]
