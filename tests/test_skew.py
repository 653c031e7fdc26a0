from __future__ import annotations

import pytest

from rotogrid.operators.skew import join_small


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast_join(spark, how):
    left = spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 200 + ["a", "b", None, "c"])], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("x", 3), (None, 4)], "k string, v int")
    plain = sorted(map(str, left.join(right, "k", how).collect()))
    for rows in (0, 100):
        assert sorted(map(str, join_small(left, right, ["k"], how, rows=rows, salts=4).collect())) == plain
