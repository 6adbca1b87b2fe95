"""Streaming twins: keyed counters with a watermark, ordered state per run, and incremental summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import fold


def keyed_counts(events: DataFrame, keys: list[str], time: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by key and window; rows later than the watermark are dropped, so state stays bounded."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def run_states(events: DataFrame) -> DataFrame:
    """State of each run as its events come (run_id, pos, intent); within a batch they are folded in order."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, status, moves, refused = state.get if state.exists else ("intake", "active", 0, 0)
        rows = pd.concat(list(frames)).sort_values("pos")
        now, status, m, r, _ = fold(rows["intent"], now, status)
        moves, refused = moves + m, refused + r
        state.update((now, status, moves, refused))
        yield pd.DataFrame([(key[0], now, status, moves, refused)], columns=["run_id", "state", "status", "moves", "refused"])

    return events.groupBy("run_id").applyInPandasWithState(step, "run_id long, state string, status string, moves long, refused long", "state string, status string, moves long, refused long", "update", GroupStateTimeout.NoTimeout)


def save_increments(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch goes to ``write``, which must overwrite by batch id to be exactly-once."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")
