"""Live sessions with a time to live and a capacity, as a stream.

Sessions are dealt over shards by a hash of their key; a shard holds at most
``most`` of them, and its state is that map. A session that has been idle for
longer than its time to live is over; one that begins in a full shard ends the
one that was idle for longest. A timer ends idle sessions once the watermark
has passed them, so a shard that gets no more events is emptied as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ENDED = "shard int, key long, started long, ended long, n_events long, why string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step(live: dict[int, tuple[int, int, int]], key: int, at: int, most: int, ttl: int) -> list[tuple]:
    """Take an event of a key at a time (ms) into a shard's live sessions (started, last, n); the sessions (key, started, ended, n, why) that it ends."""
    out = idle(live, at, ttl)
    if key not in live and len(live) >= most:
        oldest = min(live, key=lambda k: (live[k][1], k))
        started, _, n = live.pop(oldest)
        out.append((oldest, started, at, n, "evicted"))
    started, _, n = live.get(key, (at, at, 0))
    live[key] = (started, at, n + 1)
    return out


def idle(live: dict[int, tuple[int, int, int]], now: int, ttl: int) -> list[tuple]:
    """End the sessions that have been idle for longer than ttl at a time."""
    over = [k for k, (_, last, _) in live.items() if now - last > ttl]
    return [(k, s, last + ttl, n, "expired") for k in sorted(over) for s, last, n in [live.pop(k)]]


def in_order(frames: Iterable[pd.DataFrame], some: int = 10_000) -> Iterator[tuple[int, int]]:
    """(key, at) of a batch's events by time and seq. A batch is held as three numbers an event; Python's own are made of some at a time."""
    parts = [tuple(f[c].to_numpy(np.int64) for c in ("key", "at", "seq")) for f in frames]
    key, at, seq = (np.concatenate(c) for c in zip(*parts))
    del parts
    order = np.lexsort((seq, at))
    for i in range(0, len(order), some):
        own = order[i : i + some]
        yield from zip(key[own].tolist(), at[own].tolist())


class _Sessions(StatefulProcessor):
    def __init__(self, most: int, ttl: int):
        self.most, self.ttl = most, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getMapState("live", "key long", "started long, last long, n long")

    def _load(self) -> dict:
        return {k[0]: tuple(v) for k, v in self.live.iterator()}

    def _store(self, before: dict, after: dict) -> None:
        for k in before.keys() - after.keys():
            self.live.removeKey((k,))
        for k, v in after.items():
            if before.get(k) != v:
                self.live.updateValue((k,), v)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if after:
            self.handle.registerTimer(min(last for _, last, _ in after.values()) + self.ttl + 1)

    @staticmethod
    def _rows(shard, ended: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(int(shard), *e) for e in ended], columns=["shard", "key", "started", "ended", "n_events", "why"])

    def handleInputRows(self, key, rows, timerValues):
        before = self._load()
        live, ended = dict(before), []
        for k, at in in_order(rows):
            ended += step(live, k, at, self.most, self.ttl)
        self._store(before, live)
        if ended:
            yield self._rows(key[0], ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        before = self._load()
        live = dict(before)
        # one timer a shard: whatever the watermark has passed ends with it
        ended = idle(live, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), self.ttl)
        self._store(before, live)
        if ended:
            yield self._rows(key[0], ended)

    def close(self) -> None:
        pass


def shard_of(key, shards: int):
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def ended_sessions(events: DataFrame, most: int, ttl_ms: int, shards: int = 64, late: str = "1 hour", key: str = "user_id", ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """A stream of ended sessions (shard, key, started, ended in ms, n_events, why: expired or evicted) of a stream of events.

    A shard takes a batch's events in order of time and seq, null last; events that are
    behind the watermark are dropped. Rows without a key or a time are no
    events. The state store must be RocksDB (``ROCKS``).
    """
    known = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    rows = known.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.coalesce(F.col(seq).cast("long"), F.lit(2**63 - 1)).alias("seq"))
    rows = rows.withColumns({"at": F.unix_millis("ts"), "shard": shard_of(F.col("key"), shards)}).withWatermark("ts", late)
    return rows.groupBy("shard").transformWithStateInPandas(_Sessions(most, ttl_ms), outputStructType=ENDED, outputMode="Append", timeMode="EventTime")
