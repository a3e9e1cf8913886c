"""Session expiry and rolling counts as Structured Streaming queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expiring_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user that end after a gap; state goes once the watermark passes."""
    w = F.session_window("ts", gap)
    rows = events.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("n_events"), F.max("value").alias("top"))
    return rows.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("expires"), "n_events", "top")


def stage_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and mean value of each type by tumbling window."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return rows.select(F.col("window.start").alias("started"), "event_type", "n", "mean")


FOLLOWUP = "conv_id long, n_asked long, n_answered long, pending boolean"


def followups(messages: DataFrame, question: str = "user", answer: str = "assistant", idle_ms: int = 3_600_000, late: str = "1 hour") -> DataFrame:
    """(conv_id, n_asked, n_answered, pending) of each conversation whenever a batch brings it turns (conv_id, turn, role, ts).

    A question waits until an answer with a later turn. The state is four
    numbers; it goes once the watermark is an idle time past the last turn.
    """

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        asked, answered, last_q, last_a = state.get if state.exists else (0, 0, -1, -1)
        newest = state.getCurrentWatermarkMs()
        for turns in batches:
            q, a = turns[turns.role == question], turns[turns.role == answer]
            asked, answered = asked + len(q), answered + len(a)
            last_q, last_a = max([last_q, *map(int, q.turn)]), max([last_a, *map(int, a.turn)])
            newest = max([newest, *map(int, turns.ms)])
        state.update((asked, answered, last_q, last_a))
        state.setTimeoutTimestamp(newest + idle_ms)
        yield pd.DataFrame({"conv_id": [key[0]], "n_asked": [asked], "n_answered": [answered], "pending": [last_q > last_a]})

    known = messages.where("conv_id is not null and turn is not null and ts is not null").withWatermark("ts", late)
    known = known.select("conv_id", "turn", "role", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return known.groupBy("conv_id").applyInPandasWithState(run, FOLLOWUP, "asked long, answered long, last_q long, last_a long", "update", "EventTimeTimeout")
