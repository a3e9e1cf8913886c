import datetime as dt
import random

from pyspark.sql import functions as F

from lexspan.operators import metrics
from lexspan.sources.feedback_log import FeedbackLog
from lexspan.streaming import capacity

RECORD = "record_id string, created_at long, user_action string"


def rows(df):
    return sorted(map(tuple, df.select("record_id", "created_at", "user_action").collect()))


def test_batches_merge_once(spark, tmp_path):
    log = FeedbackLog(str(tmp_path / "log"))
    assert log.current(spark) is None and log.base(spark) == log.compact(spark) == -1
    batches = [[("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), (None, 1, "x")], [("a", 0, "late batch wins")], [("c", 5, "z"), ("c", 5, "y")], []]
    for n, b in enumerate(batches):
        log.merge(spark.createDataFrame(b, RECORD), n)
    want = [("a", 0, "late batch wins"), ("b", 1, "x"), ("c", 5, "z")]
    assert rows(log.current(spark)) == want
    for n in (1, 3, 0):  # replays, in any order
        log.merge(spark.createDataFrame(batches[n], RECORD), n)
    assert rows(log.current(spark)) == want
    assert log.compact(spark) == 3 and log.batches(spark) == [] and rows(log.current(spark)) == want
    log.merge(spark.createDataFrame(batches[0], RECORD), 0)  # a replay of what the base covers
    assert rows(log.current(spark)) == want
    log.merge(spark.createDataFrame([("b", 9, "new")], RECORD), 4)
    assert rows(log.current(spark)) == [want[0], ("b", 9, "new"), want[2]]
    assert log.compact(spark, keep=1) == 4 and log.batches(spark) == [4] and rows(log.current(spark)) == [want[0], ("b", 9, "new"), want[2]]
    assert log.compact(spark) == 4


def test_a_half_written_base_is_not_read(spark, tmp_path):
    log = FeedbackLog(str(tmp_path / "log"))
    log.merge(spark.createDataFrame([("a", 1, "x")], RECORD), 0)
    (tmp_path / "log/base/upto=0").mkdir(parents=True)
    assert log.base(spark) == -1 and rows(log.current(spark)) == [("a", 1, "x")]


def test_a_stream_that_starts_again(spark, tmp_path):
    log = FeedbackLog(str(tmp_path / "log"))
    source = str(tmp_path / "in")
    for part in ([("a", 1, "x")], [("b", 1, "x"), ("a", 2, "y")]):
        spark.createDataFrame(part, RECORD).coalesce(1).write.mode("append").json(source)
    read = lambda: spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).json(source)
    log.follow(read(), str(tmp_path / "c")).awaitTermination()
    assert rows(log.current(spark)) == [("a", 2, "y"), ("b", 1, "x")]
    log.compact(spark)
    spark.createDataFrame([("b", 3, "z")], RECORD).write.mode("append").json(source)
    log.follow(read(), str(tmp_path / "c")).awaitTermination()
    assert rows(log.current(spark)) == [("a", 2, "y"), ("b", 3, "z")]


def test_sketches_merge_in_any_grouping(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    data = [(start + dt.timedelta(minutes=rng.randrange(4000)), rng.choice("ab"), rng.choice([None, rng.gauss(50, 9)]), rng.randrange(900)) for _ in range(20_000)] + [(None, "a", 1.0, 1), (start, None, 2.0, None)]
    df = spark.createDataFrame(data, "ts timestamp, event_type string, value double, user_id long")
    hours = metrics.hourly(df)
    days = metrics.merged(hours, ["day", "stage"])
    for sketches, key in ((days, lambda t, s: (t.date(), s)), (metrics.merged(days, ["stage"]), lambda t, s: (s,))):
        exact = {}
        for t, s, v, u in data:
            if t:
                exact.setdefault(key(t, s), []).append((v, u))
        got = metrics.told(sketches, (0.5, 0.95, 0.999)).collect()
        assert len(got) == len(exact)
        for r in got:
            all_ = exact[tuple(r[:-6])]
            values = sorted(v for v, _ in all_ if v is not None)
            assert r["n"] == len(all_)
            if values:
                assert abs(r["mean"] - sum(values) / len(values)) < 1e-9
                for name, rank in (("p50", 0.5), ("p95", 0.95), ("p99_9", 0.999)):
                    assert abs(sum(v <= r[name] for v in values) / len(values) - rank) <= metrics.RANK_ERROR + 1 / len(values)
            users = len({u for _, u in all_ if u is not None})
            assert abs(r["users"] - users) <= max(1, metrics.DISTINCT_ERROR * users)


def test_session_step():
    live = {}
    assert capacity.step(live, 1, 0, 2, 10) == capacity.step(live, 2, 5, 2, 10) == []
    assert capacity.step(live, 3, 6, 2, 10) == [(1, 0, 6, 1, "evicted")]
    assert capacity.step(live, 2, 15, 2, 10) == [] and capacity.step(live, 2, 16, 2, 10) == []  # 10 is not over, and 3 was last seen at 6
    assert capacity.step(live, 2, 17, 2, 10) == [(3, 6, 16, 1, "expired")]
    assert capacity.idle(live, 28, 10) == [(2, 5, 27, 4, "expired")] and live == {}


def sequential(events, most, ttl, shards, spark):
    keys = spark.createDataFrame([(k,) for k in {e[2] for e in events if e[2] is not None}], "k long")
    shard = {r["k"]: r["s"] for r in keys.select("k", capacity.shard_of(F.col("k"), shards).alias("s")).collect()}
    live, out = {}, []
    for _, ts, key, *_ in sorted((e for e in events if e[1] and e[2] is not None), key=lambda e: (e[1], e[0])):
        at = int(ts.timestamp() * 1000)
        out += [(shard[key], *x) for x in capacity.step(live.setdefault(shard[key], {}), key, at, most, ttl)]
    return live, out


def test_a_replay_is_the_sequential_model(spark, tmp_path):
    """Two starts on one checkpoint; the last event is so late that all that went before is over."""
    rng = random.Random(12)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    times = sorted(rng.randrange(40_000) for _ in range(600))
    events = [(i, start + dt.timedelta(seconds=t), rng.randrange(40)) for i, t in enumerate(times)]
    odd = [(601, None, 1), (602, start, None)]
    end = [(700 + i, start + dt.timedelta(seconds=200_000 + i), 1000 + i) for i in range(3)]
    schema = "event_id long, ts timestamp, user_id long"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", capacity.ROCKS)
    try:
        for parts in ([events[:200] + odd, events[200:300]], [events[300:], end, [(800, start + dt.timedelta(seconds=300_000), 2000)]]):
            for part in parts:
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            ended = capacity.ended_sessions(stream, most=3, ttl_ms=3_000_000, shards=4, late="10 minutes")
            query = ended.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
            query.awaitTermination()
            kept = max(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators)
            assert kept <= 4 * 3 + 2 * 4 * 4  # sessions and timers of four full shards
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    live, want = sequential(events, 3, 3_000_000, 4, spark)
    for shard, own in live.items():
        want += [(shard, *x) for x in capacity.idle(own, 10**15, 3_000_000)]
    got = [tuple(r) for r in spark.read.schema(capacity.ENDED).parquet(out).collect() if r["key"] < 1000]
    assert len(want) > 100 and {w[-1] for w in want} == {"evicted", "expired"}
    assert sorted(got) == sorted(want)
