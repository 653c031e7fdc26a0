from __future__ import annotations

import math
import random

import numpy as np
import pytest

from rotogrid.operators.grid import boundary_levels
from rotogrid.operators.order import order_statistics, percentiles


def test_equal_to_sorting(spark):
    rng = random.Random(2)
    values = [rng.choice([0.0, -0.0, 1.5, -1.5, 1e-310, -1e300, math.inf, -math.inf, rng.gauss(0, 1), float(rng.randint(-5, 5))]) for _ in range(400)]
    rows = spark.createDataFrame([(v,) for v in [*values, None, None]], "v double")
    ordered = sorted(v + 0.0 for v in values)
    ranks = [0, 1, 57, 200, 201, 399, 400, -1]
    assert order_statistics(rows, "v", ranks) == [ordered[r] if 0 <= r < 400 else None for r in ranks]
    finite = rows.where("abs(v) < 1e200")
    expected = np.percentile([v for v in values if abs(v) < 1e200], [0, 20, 50, 90, 100])
    assert percentiles(finite, "v", (0, 0.2, 0.5, 0.9, 1)) == pytest.approx(list(expected))
    assert order_statistics(rows.limit(0), "v", [0]) == [None] and percentiles(rows.limit(0), "v", (0.5,)) == [None]


def test_threshold_pair(spark):
    rows = spark.createDataFrame([(0, 0, i, float(i)) for i in range(20)], "x int, y int, z int, v double")
    assert tuple(boundary_levels(rows, 10).first()) == (10.0, 9.0)
    assert tuple(boundary_levels(rows, 19, 0.2).first()) == (1.0, None)
