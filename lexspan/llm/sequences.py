"""Sequential patterns by binary search over columns of timestamps.

Clients' timelines are cut into slices that overlap by the longest span of a
pattern, so that each occurrence lies whole in the slice of its first event.
Slices are packed into bundles of bounded size: for each type of event one
sorted array of composite keys, (slice number, time in the slice) in one 64-bit
number, for all clients of the bundle together. An occurrence of a pattern is
known by the key of its last event and the latest possible first event. The
occurrences of ``P > x`` are found for all clients at once: a binary search of
the ends of ``P`` for the latest one before each ``x``. As ends grow, latest
firsts grow as well, so the latest end within the gap is also the one with the
shortest span, and no other needs to be looked at.

Patterns are a trie whose classes share a prefix. Levels are descended one by
one; a pattern is extended only by types such that its suffix is frequent too
(gap and span hold for prefixes and suffixes of an occurrence), and only the ends
of that suffix are searched. Supports of a level are counted over all bundles
before the next begins.

Clients with a large share of the events are dealt by slice over tasks. A
bundle counts the clients that it has to itself; of a client that other bundles
have too, it names the patterns, and these pairs are made distinct by a shuffle.
Only frequent types and patterns come to the driver: at most 100 divided by the
percentage asked for, times the types or patterns that a client has on average.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.llm.scratch import partitions, written

GAP = 900_000_000  # microseconds between neighbours of an occurrence
SPAN_PERCENT = 250  # of the gap: from the first event to the last
LONGEST = 4
LEAST_CLIENTS, LEAST_PERCENT = 2, 30
SLICE = 14_400_000_000  # microseconds
BUNDLE = 100_000  # events
HOT = 1000  # a client with 1/HOT of all events is dealt by slice

Pattern = tuple[int, ...]


def microseconds(ts: str, kind: T.DataType):
    """Column of a timestamp in microseconds, whatever the session's zone where the timestamp has none."""
    if isinstance(kind, T.TimestampNTZType):
        second = f"cast(date_part('SECONDS', {ts}) * 1000000 as bigint)"
        return F.expr(f"(datediff(cast({ts} as date), date'1970-01-01') * 86400L + hour({ts}) * 3600L + minute({ts}) * 60L) * 1000000L + {second}")
    return F.unix_micros(ts)


def click_events(clicks: DataFrame) -> DataFrame:
    """(client, at, type) of clicks that have a client, a time and a kind; marked clicks add `open` and `shut` a second to either side."""
    rows = clicks.select(
        F.col("client_id").cast("long").alias("client"),
        microseconds("ts", clicks.schema["ts"].dataType).alias("at"),
        F.col("kind").alias("type"),
        F.coalesce(F.crc32(F.col("click_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("marked"),
    ).where("client is not null and at is not null and type is not null")
    event = lambda kind, shift: F.struct((F.col("at") + shift).alias("at"), kind.alias("type"))
    own = event(F.col("type"), 0)
    all_ = F.when(F.col("marked"), F.array(own, event(F.lit("open"), -1_000_000), event(F.lit("shut"), 1_000_000))).otherwise(F.array(own))
    return rows.select("client", F.explode(all_).alias("e")).select("client", "e.at", "e.type")


def _crc(client):
    return F.crc32(client.cast("string").cast("binary"))


def _bundled(stride: int, size: int):
    """Packs rows (client, slice, type, at in the slice, hot), sorted, into bundles of whole slices."""

    def packed(rows: list[np.ndarray], before, after) -> pa.RecordBatch:
        client, slice_, kind, at, hot = rows
        new = np.concatenate(([True], (client[1:] != client[:-1]) | (slice_[1:] != slice_[:-1])))
        group = np.cumsum(new) - 1
        keys = group * stride + at
        kinds = np.unique(kind)
        clients = client[new]
        shared = hot[new] | (clients == before) | (clients == after)
        row = {
            "clients": pa.array([clients.astype("<i8").tobytes()], pa.binary()),
            "shared": pa.array([shared.astype(np.uint8).tobytes()], pa.binary()),
            "types": pa.array([kinds.tolist()], pa.list_(pa.int32())),
            "keys": pa.array([[np.unique(keys[kind == t]).astype("<i8").tobytes() for t in kinds]], pa.list_(pa.binary())),
        }
        return pa.RecordBatch.from_pydict(row)

    def run(batches):
        held: list[list[np.ndarray]] = []
        before = None  # the last client of the bundle before
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
            if sum(len(h[0]) for h in held) < size:
                continue
            rows = [np.concatenate(c) for c in zip(*held)]
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            cut = len(same) - int(same[::-1].argmin()) if not same.all() else 0  # the last slice may go on
            if cut:
                yield packed([c[:cut] for c in rows], before, rows[0][cut])
                before = rows[0][cut - 1]
            held = [[c[cut:] for c in rows]]
        rows = [np.concatenate(c) for c in zip(*held)] if held else [[]]
        if len(rows[0]):
            yield packed(rows, before, None)

    return run


def occurrences(ends: np.ndarray, firsts: np.ndarray, nexts: np.ndarray, gap: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends, latest firsts) of a pattern extended to the events ``nexts``; all are ascending keys."""
    i = np.searchsorted(ends, nexts, "left") - 1
    found = i >= 0
    nexts, i = nexts[found], i[found]
    good = (nexts - ends[i] <= gap) & (nexts - firsts[i] <= span)
    return nexts[good], firsts[i[good]]


def candidates(frequent: set[Pattern]) -> list[Pattern]:
    """Extensions of frequent patterns of one length whose prefix and suffix are frequent, in order."""
    by_prefix: dict[Pattern, list[int]] = {}
    for p in sorted(frequent):
        by_prefix.setdefault(p[:-1], []).append(p[-1])
    return [(*p, x) for p in sorted(frequent) for x in by_prefix.get(p[1:], [])]


def _level(levels: list[list[Pattern]], stride: int, gap: int, span: int):
    """Supports of the last of the levels' patterns (from length 2); the others lead there."""

    def run(batches):
        owned: dict[int, list[int]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                clients = np.frombuffer(batch.column(0)[row].as_py(), "<i8")
                shared = np.frombuffer(batch.column(1)[row].as_py(), np.uint8).astype(bool)
                of = np.concatenate(([0], np.cumsum(clients[1:] != clients[:-1])))  # the slices of a client follow one another
                first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                crcs = np.array([zlib.crc32(str(c).encode()) for c in clients[first].tolist()], np.int64)
                known = {}
                for kind, keys in zip(batch.column(2)[row].as_py(), batch.column(3)[row].as_py()):
                    known[kind,] = (k := np.frombuffer(keys, "<i8"), k)
                for depth, patterns in enumerate(levels, 1):
                    last, longer = depth == len(levels), {}
                    for n, p in enumerate(patterns):
                        prefix, suffix = known.get(p[:-1]), known.get(p[1:])
                        if not prefix or not suffix:
                            continue
                        ends, firsts = occurrences(*prefix, suffix[0], gap, span)
                        if not len(ends):
                            continue
                        if not last:
                            longer[p] = ends, firsts
                            continue
                        who = np.unique(of[ends // stride])
                        others = shared[first[who]]
                        mine = who[~others]
                        if len(mine):
                            total = owned.setdefault(n, [0, 0])
                            total[0] += len(mine)
                            total[1] += int(crcs[mine].sum())
                        if others.any():
                            named = clients[first[who[others]]]
                            columns = [pa.array(np.full(len(named), n, np.int32)), pa.array(named), pa.array(np.zeros(len(named), np.int64)), pa.array(np.zeros(len(named), np.int64))]
                            yield pa.RecordBatch.from_arrays(columns, names=["p", "client", "n", "crc"])
                    known.update(longer)
        rows = [(n, None, *total) for n, total in owned.items()]
        p, client, n, crc = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(client, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["p", "client", "n", "crc"])

    return run


def mine(
    events: DataFrame, gap: int = GAP, span_percent: int = SPAN_PERCENT, longest: int = LONGEST, least_clients: int = LEAST_CLIENTS,
    least_percent: int = LEAST_PERCENT, slice_: int = SLICE, bundle: int = BUNDLE, tag: str = "sequences",
) -> DataFrame:
    """(pattern, support, clients_crc) of the frequent patterns of events (client, at in microseconds, type); pattern is an array of types.

    A client supports a pattern if it has events of these types, each more than
    0 and at most ``gap`` microseconds after the one before, first to last at
    most ``span_percent`` of the gap. Frequent: at least ``least_clients`` and
    ``least_percent`` of the clients that have events. Events at one time never
    follow one another; repeated rows change nothing; rows with a null in any
    of the three columns are no events; an empty table has no patterns; other
    columns are not read. A task holds a bundle of events, or one client's events of
    one slice if these are more.
    """
    spark = events.sparkSession
    span = gap * span_percent // 100
    slice_ = max(slice_, span)
    stride = 1 << (slice_ + span + gap).bit_length()
    events = events.select("client", "at", "type").where("client is not null and at is not null and type is not null")
    counts = written(events.groupBy("client", "type").agg(F.count("*").alias("n")), f"{tag}-counts")
    by_client = counts.groupBy("client").agg(F.sum("n").alias("n"))
    clients, total = by_client.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    enough = lambda n: n >= least_clients and 100 * n >= least_percent * clients
    least = max(least_clients, -(-least_percent * clients // 100))
    kinds = counts.groupBy("type").agg(F.count("*").alias("n"), F.sum(_crc(F.col("client"))).alias("crc")).where(F.col("n") >= least)
    single = sorted(map(tuple, kinds.collect()))
    names = [name for name, _, _ in single]
    kept = [((k,), n, crc) for k, (_, n, crc) in enumerate(single) if enough(n)]

    if kept and longest > 1:
        hot = by_client.where(F.col("n") * HOT >= total).select(F.col("client").alias("of"))  # at most HOT rows
        own = F.col("at") - F.pmod("at", F.lit(slice_))
        starts = F.when(F.col("at") - own < span, F.array(own - slice_, own)).otherwise(F.array(own))
        rows = events.select("client", "at", (F.array_position(F.lit(names), F.col("type")) - 1).cast("int").alias("kind")).where("kind >= 0")
        rows = rows.select("client", "kind", "at", F.explode(starts).alias("start")).join(F.broadcast(hot), F.col("client") == F.col("of"), "left")
        rows = rows.select("client", F.expr(f"start div {slice_}L").alias("slice"), "kind", (F.col("at") - F.col("start")).alias("at"), F.col("of").isNotNull().alias("hot"))
        dealt = rows.repartition(partitions(spark), "client", F.when(F.col("hot"), F.col("slice")).otherwise(F.lit(0).cast("long"))).sortWithinPartitions("client", "slice")
        bundles = written(dealt.mapInArrow(_bundled(stride, bundle), "clients binary, shared binary, types array<int>, keys array<binary>"), f"{tag}-bundles")
        levels: list[list[Pattern]] = []
        while len(levels) + 1 < longest and (step := candidates({p for p, _, _ in kept if len(p) == len(levels) + 1})):
            levels.append(step)
            found = bundles.mapInArrow(_level(levels, stride, gap, span), "p int, client long, n long, crc long")
            once = found.groupBy("p", "client").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc"))
            shared = F.col("client").isNotNull()
            once = once.select("p", F.when(shared, 1).otherwise(F.col("n")).alias("n"), F.when(shared, _crc(F.col("client"))).otherwise(F.col("crc")).alias("crc"))
            for r in once.groupBy("p").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc")).where(F.col("n") >= least).collect():
                if enough(r["n"]):
                    kept.append((step[r["p"]], r["n"], r["crc"]))
            levels[-1] = sorted(p for p, _, _ in kept if len(p) == len(levels) + 1)

    result = [([names[k] for k in p], n, crc) for p, n, crc in kept]
    return spark.createDataFrame(result, "pattern array<string>, support long, clients_crc long")


def closed(patterns: DataFrame) -> DataFrame:
    """patterns (pattern, support, ...) with n_wider, the longer ones of equal support that become it by deleting entries anywhere, and closed."""
    size, masks = F.size("pattern"), F.expr("sequence(1, cast(power(2, size(pattern)) as int) - 2)")
    parts = patterns.where(size > 1).select("pattern", "support", F.explode(masks).alias("mask"))
    part = F.expr("filter(pattern, (x, i) -> shiftright(mask, i) % 2 = 1)")
    wider = parts.select("pattern", F.col("support").alias("of_support"), part.alias("part")).distinct().groupBy("part", "of_support").agg(F.count("*").alias("n_wider"))
    joined = patterns.join(wider, (F.col("pattern") == F.col("part")) & (F.col("support") == F.col("of_support")), "left").drop("part", "of_support")
    return joined.withColumn("n_wider", F.coalesce("n_wider", F.lit(0)).cast("long")).withColumn("closed", F.col("n_wider") == 0)
