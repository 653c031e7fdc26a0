"""Streaming forms: best score per translation, per-window statistics, and picks as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rotogrid.operators.score import T


def best_scores(scores: DataFrame, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """A running best map over a stream of scores (update or complete mode): max over (score, -rotation) per translation."""
    rows = scores.withWatermark(time, watermark) if watermark else scores
    best = rows.groupBy(*T).agg(F.max(F.struct(F.col("s"), (-F.col("r")).alias("q"))).alias("b"))
    return best.select(*T, F.col("b.s").alias("s"), (-F.col("b.q")).cast("int").alias("r"))


def windowed_volume(events: DataFrame, window: str = "1 hour", delay: str = "2 hours", time: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts and value sums per window and key; late rows are dropped after ``delay``."""
    return (
        events.withWatermark(time, delay).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("v"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), key, "v", "total")
    )


def rising_best(scores: DataFrame, key: str) -> DataFrame:
    """Emits a row whenever a key's best score rises; the state is one score per key."""

    def update(k, frames: Iterator, state: GroupState):
        import pandas as pd

        best = state.get[0] if state.exists else float("-inf")
        before = best
        for f in frames:
            if len(f):
                best = max(best, float(f["s"].max()))
        if best > before:
            state.update((best,))
            yield pd.DataFrame([(k[0], best)], columns=[key, "s"])

    kind = scores.schema[key].dataType.simpleString()
    return scores.select(key, "s").groupBy(key).applyInPandasWithState(update, f"{key} {kind}, s double", "best double", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drive a finite stream into a memory table; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.table(name)
