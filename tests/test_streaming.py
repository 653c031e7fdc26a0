from __future__ import annotations

import datetime as dt

from rotogrid.operators import aggregate as A
from rotogrid.streaming import best as B

SCORES = "key string, tx int, ty int, tz int, r int, s double"
ROWS = [("a", 0, 0, 0, 1, 2.0), ("a", 0, 0, 0, 0, 2.0), ("b", 1, 0, 0, 3, 1.0), ("b", 1, 0, 0, 2, 5.0), ("a", 2, 0, 0, 0, 1.5)]


def test_running_best_equals_batch(spark, tmp_path):
    for i, r in enumerate(ROWS):
        spark.createDataFrame([r], SCORES).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    stream = spark.readStream.schema(SCORES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = B.run_to_end(B.best_scores(stream), "best_map")
    batch = A.best_over_rotations(spark.createDataFrame(ROWS, SCORES))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    rising = B.run_to_end(B.rising_best(stream, "key"), "rising", "update")
    assert rising.groupBy("key").max("s").count() == 2


def test_windows(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h, 30), "k", float(h)) for h in (0, 0, 1, 5)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/ev")
    got = B.run_to_end(B.windowed_volume(stream), "hours", "complete").collect()
    assert {(r.start.hour, r.v, r.total) for r in got} == {(0, 2, 0.0), (1, 1, 1.0), (5, 1, 5.0)}
