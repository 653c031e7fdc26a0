"""Queries that run as finite streams, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rotogrid.streaming import best as B

QUERIES: dict = {}
SQL: dict = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _events(s, d):
    schema = s.read.parquet(f"{d}/events.parquet").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def _name() -> str:
    return "s" + uuid.uuid4().hex


def _scores(s, d):
    return _events(s, d).select(F.dayofmonth("ts").alias("tx"), F.hour("ts").alias("ty"), F.lit(0).alias("tz"), F.col("value").alias("s"), F.col("user_id").cast("int").alias("r"))


add("stream_best_scores", lambda s, d: B.run_to_end(B.best_scores(_scores(s, d)), _name()), "SELECT tx, ty, 0 AS tz, s, r FROM (SELECT CAST(day(ts) AS INT) AS tx, CAST(hour(ts) AS INT) AS ty, value AS s, CAST(user_id AS INT) AS r, row_number() OVER (PARTITION BY day(ts), hour(ts) ORDER BY value DESC, user_id) AS k FROM events) WHERE k = 1")
add("stream_windows", lambda s, d: B.run_to_end(B.windowed_volume(_events(s, d), "6 hours"), _name()).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "v", F.round("total", 4).alias("total")), "SELECT date_trunc('day', ts) + INTERVAL (6 * (hour(ts) // 6)) HOUR AS start, event_type, count(*) AS v, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
add("stream_rising_best", lambda s, d: B.run_to_end(B.rising_best(_events(s, d).select("event_type", F.col("value").alias("s")), "event_type"), _name(), "update").groupBy("event_type").agg(F.max("s").alias("s")), "SELECT event_type, max(value) AS s FROM events GROUP BY 1")
