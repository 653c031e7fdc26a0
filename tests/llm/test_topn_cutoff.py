from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from rotogrid.llm.cutoff import cutoffs, kept_items
from rotogrid.llm.topn import top_n_per_group

SCHEMA = "tomo_id string, pick_id bigint, x double, y double, z double, score double, `__g` string, count bigint"
RNG = random.Random(7)


def rows(n=600):
    scores = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 0.1, 0.2, 0.2, -3.5, 1e-300, -1e300]
    out = []
    for i in range(n):
        g = RNG.choice(["a", "a", "a", "b", "c", None])
        r = (g, i if i % 50 else None, *[RNG.choice([None, 0.0, -0.0, 1.0, 2.0]) for _ in range(3)], RNG.choice([*scores, RNG.random()]), "clash", 1)
        out += [r] * RNG.choice([1, 1, 2, 3])
    RNG.shuffle(out)
    return out


def counted(data):
    by = defaultdict(set)
    for g, i, x, y, z, s, *_ in data:
        if g is not None and s is not None and math.isfinite(s):
            by[g].add((s + 0.0, i, x, y, z))
    return by


def key(item):
    s, i, *t = item
    return (-s, *[(v is None, 0 if v is None else v + 0.0) for v in t], (i is None, i or 0))


@pytest.mark.parametrize("heavy", [1, 20, 10**9])
def test_top_n_equals_brute_force_on_either_path(spark, heavy):
    data = rows()
    got = top_n_per_group(spark.createDataFrame(data, SCHEMA), "tomo_id", "score", ["x", "y", "z"], "pick_id", 7, heavy)
    expected = {(g, v[1]) for g, items in counted(data).items() for v in sorted(items, key=key)[:7]}
    assert {tuple(r) for r in got.collect()} == expected
    assert got.count() == len(expected)


def test_the_default_threshold_makes_a_hot_group_heavy(spark):
    data = [("hot" if i % 3 == 0 else f"g{i % 200}", i, 0.0, 0.0, 0.0, float(i % 17), "x", 1) for i in range(6000)]
    # one id, delivered very often
    data += [("hot", 3, 0.0, 0.0, 0.0, 3.0, "x", 1)] * 3000
    found = top_n_per_group(spark.createDataFrame(data, SCHEMA), "tomo_id", "score", ["x", "y", "z"], "pick_id", 5)
    plan = found._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan and "Union" in plan
    assert {tuple(r) for r in found.collect()} == {(g, v[1]) for g, items in counted(data).items() for v in sorted(items, key=key)[:5]}


def test_top_n_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert top_n_per_group(empty, "tomo_id", "score", ["x"], "pick_id", 3).count() == 0


def test_top_n_of_zero(spark):
    assert top_n_per_group(spark.createDataFrame(rows(20), SCHEMA), "tomo_id", "score", ["x"], "pick_id", 0).count() == 0


@pytest.mark.parametrize("wide", [0, 8, 10**9])
def test_cutoffs_equal_brute_force_on_either_path(spark, wide):
    data = rows()
    targets = [("a", 137, 1), ("b", 0, 1), ("c", 1000, 1), ("gone", 5, 1), ("c", 1000, 2), (None, 3, 1), ("d", None, 1)]
    items, goal = spark.createDataFrame(data, SCHEMA), spark.createDataFrame(targets, "tomo_id string, keep_permille int, score int")
    found = cutoffs(items, goal, "tomo_id", "score", "pick_id", "keep_permille", wide)
    got = {r.tomo_id: tuple(r)[1:] for r in found.collect()}
    expected, kept = {}, set()
    for g, permille in (("a", 137), ("b", 0), ("c", 1000)):
        picks = {(v[0], v[1]) for v in counted(data)[g]}
        n = len(picks)
        need = -(-permille * n // 1000)
        cut = next(s for s in sorted({s for s, _ in picks}, reverse=True) if sum(t >= s for t, _ in picks) >= need)
        expected[g] = (n, need, cut, sum(t >= cut for t, _ in picks))
        kept |= {(g, i) for t, i in picks if t >= cut}
    assert got == expected
    assert {tuple(r) for r in kept_items(items, found, "tomo_id", "score", "pick_id").collect()} == kept


def test_impossible_targets_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    goal = spark.createDataFrame([("a", 1001)], "tomo_id string, keep_permille int")
    some = spark.createDataFrame(rows(30), SCHEMA)
    for wide in (0, 100):
        assert cutoffs(empty, goal, "tomo_id", "score", "pick_id", "keep_permille", wide).count() == 0
        assert cutoffs(some, goal, "tomo_id", "score", "pick_id", "keep_permille", wide).count() == 0
        assert cutoffs(some, goal.limit(0), "tomo_id", "score", "pick_id", "keep_permille", wide).count() == 0
