import itertools
import random
import zlib
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.llm import queries, sequences
from lexspan.llm.sequences import candidates, click_events, closed, mine, occurrences


def supports(times, pattern, gap, span):
    """By trying all choices: times of one client by type."""

    def go(k, first, last):
        if k == len(pattern):
            return True
        return any(0 < t - last <= gap and t - first <= span and go(k + 1, first, t) for t in times.get(pattern[k], ()))

    return any(go(1, t, t) for t in times.get(pattern[0], ()))


def brute(events, gap, span, longest, least_clients, least_percent):
    by = {}
    for client, at, kind in events:
        if None not in (client, at, kind):
            by.setdefault(client, {}).setdefault(kind, set()).add(at)
    kinds = sorted({k for times in by.values() for k in times})
    out = {}
    for n in range(1, longest + 1):
        for p in itertools.product(kinds, repeat=n):
            who = [c for c, times in by.items() if supports(times, p, gap, span)]
            if len(who) >= least_clients and 100 * len(who) >= least_percent * len(by):
                out[p] = (len(who), sum(zlib.crc32(str(c).encode()) for c in who))
    return out


def inside(a, b):
    it = iter(b)
    return all(x in it for x in a)


def wider(patterns):
    return {p: sum(len(q) > len(p) and patterns[q][0] == n and inside(p, q) for q in patterns) for p, (n, _) in patterns.items()}


def got(df):
    return {tuple(r["pattern"]): (r["support"], r["clients_crc"]) for r in df.collect()}


@pytest.mark.parametrize("seed,slice_,bundle", [(1, 50, 7), (2, 30, 100_000), (3, 10**6, 20)])
def test_against_brute_force(spark, seed, slice_, bundle):
    """Ties, repeats, times on either side of gap and span, a client with a third of the events, slices and bundles of several sizes."""
    rng = random.Random(seed)
    events = [(rng.choice([0, rng.randrange(7), rng.randrange(7)]), rng.randrange(-50, 60), rng.choice("abc")) for _ in range(300)]
    events += events[:20] + [(None, 1, "a"), (1, None, "a"), (2, 2, None)]
    want = brute(events, 10, 25, 4, 2, 30)
    df = spark.createDataFrame(events, "client long, at long, type string").withColumn("n", F.lit("clash")).withColumn("slice", F.lit(1))
    found = mine(df, gap=10, span_percent=250, slice_=slice_, bundle=bundle)
    assert len(want) > 10 and got(found) == want
    rows = {tuple(r["pattern"]): (r["n_wider"], r["closed"]) for r in closed(found).collect()}
    assert rows == {p: (n, n == 0) for p, n in wider(want).items()}


def test_no_hot_client(spark, monkeypatch):
    """Clients dealt whole; bundles that cut a client between them."""
    monkeypatch.setattr(sequences, "HOT", 1)
    rng = random.Random(9)
    events = [(rng.randrange(9), rng.randrange(90), rng.choice("abcd")) for _ in range(250)]
    assert got(mine(spark.createDataFrame(events, "client long, at long, type string"), gap=10, slice_=30, bundle=5)) == brute(events, 10, 25, 4, 2, 30)


def test_bounds_are_exact(spark):
    """A gap of 10 holds and 11 does not, nor does 0; a span of 25 holds and 26 does not."""
    both = lambda *rows: spark.createDataFrame([(c, t, k) for c in (1, 2) for t, k in rows], "client long, at long, type string")
    found = lambda *rows: {p for p in got(mine(both(*rows), gap=10)) if len(p) > 1}
    assert found((0, "a"), (10, "b")) == {("a", "b")}
    assert found((0, "a"), (11, "b")) == found((0, "a"), (0, "b")) == set()
    assert ("a", "b", "c", "d") in found((0, "a"), (9, "b"), (16, "c"), (25, "d"))
    assert ("a", "b", "c", "d") not in found((0, "a"), (9, "b"), (16, "c"), (26, "d"))


def test_empty_and_single(spark):
    schema = "client long, at long, type string"
    assert closed(mine(spark.createDataFrame([], schema))).collect() == []
    assert mine(spark.createDataFrame([(1, 1, "a")], schema)).collect() == []


def test_candidates_need_prefix_and_suffix():
    assert candidates({(1, 2), (2, 3), (2, 2)}) == [(1, 2, 2), (1, 2, 3), (2, 2, 2), (2, 2, 3)]


def test_latest_predecessor():
    ends, firsts = occurrences(np.array([5, 20, 30]), np.array([1, 18, 18]), np.array([5, 6, 21, 30, 31, 99]), 10, 12)
    assert ends.tolist() == [6, 21, 30] and firsts.tolist() == [1, 18, 18]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_click_events(spark, zone):
    at = datetime(2024, 3, 31, 2, 30, 0, 123456)  # does not exist in Berlin
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(ids[0], at, 7, "view"), (next(i for i in range(60) if i not in ids), at, 8, "a>b"), (None, at, 9, ""), (ids[1], None, 7, "view"), (ids[1], at, None, "view"), (ids[1], at, 7, None)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = sorted(map(tuple, click_events(spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, client_id long, kind string")).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    us = (at - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    assert found == sorted([(7, us, "view"), (7, us - 1_000_000, "open"), (7, us + 1_000_000, "shut"), (8, us, "a>b"), (9, us, "")])


def test_registered_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"create view clicks as select * from read_parquet('{sf}/clicks.parquet')")
    cur = duck.execute(queries.ORACLE_SQL["op13_sequences"])
    columns = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    assert len(want) > 20 and sorted(map(tuple, queries.QUERIES["op13_sequences"](spark, sf).select(*columns).collect())) == want
