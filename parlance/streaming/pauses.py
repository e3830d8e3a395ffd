"""Online segmentation of a stream of timed words. The batch engine has no streaming counterpart: this is an extension."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.functions import constants as C

CHUNK = "meeting_id string, chunk_idx int, start double, end double, n_words int, text string"
STATE = "chunk_idx int, start double, end double, n_words int, text string"


def pause_stream(words: DataFrame, gap: float = C.PAUSE_S, idle_ms: int | None = None) -> DataFrame:
    """Chunks of a stream of (meeting_id, word, start, end): a chunk is sent when a pause above `gap` follows it, and, with
    `idle_ms`, when its meeting is idle for so long. Words of a meeting must come in order of time between batches; within a batch they are sorted. A meeting's
    state is its open chunk."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = lambda s: pd.DataFrame([(key[0], *s)], columns=[c.split()[0] for c in CHUNK.split(", ")])
        if state.hasTimedOut:
            yield row(state.get)
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("start")
        held = list(state.get) if state.exists else None
        for word, start, end in zip(rows["word"].str.strip(), rows["start"], rows["end"], strict=True):
            if held is not None and start - held[2] > gap:
                yield row(held)
                held = [held[0] + 1, start, end, 1, word]
            elif held is None:
                held = [0, start, end, 1, word]
            else:
                held = [held[0], held[1], end, held[3] + 1, f"{held[4]} {word}"]
        state.update(tuple(held))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    return words.groupBy("meeting_id").applyInPandasWithState(step, CHUNK, STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of (user_id, ts) that a gap ends, with late events allowed for: (user_id, start, end, n)."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type, complete once the watermark has passed: (start, event_type, n, total)."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")
