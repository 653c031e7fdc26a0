from __future__ import annotations

import itertools
import os
import random
from collections import defaultdict

import numpy as np
import pytest

from rotogrid.llm import bpe, packing

FOLDER = os.environ.get("TOKENIZERS", bpe.TOKENIZERS)


def padding(sizes, counts, bounds):
    at = np.searchsorted(bounds, sizes)
    return int(((np.asarray(bounds)[at] - sizes) * counts).sum())


def test_buckets_have_the_least_padding_for_their_number():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 9)
        sizes = np.array(sorted(rng.sample(range(40), n)))
        counts = np.array([rng.choice([1, 2, 50]) for _ in range(n)])
        most = rng.randint(1, 9)
        bounds = packing.length_buckets(sizes, counts, most)
        assert 1 <= len(bounds) <= most and bounds[-1] == sizes[-1]
        best = min(padding(sizes, counts, [*(sizes[i] for i in inner), sizes[-1]]) for inner in itertools.combinations(range(n - 1), len(bounds) - 1))
        assert padding(sizes, counts, bounds) == best


def test_the_fewest_buckets_within_the_padding():
    rng = np.random.default_rng(2)
    for share in (0.0001, 0.01, 0.3):
        sizes = np.unique(rng.integers(1, 900, 400))
        counts = rng.integers(1, 60, len(sizes))
        bounds = packing.length_buckets(sizes, counts, padding=share)
        assert padding(sizes, counts, bounds) <= share * (sizes * counts).sum()
        assert 1 <= len(bounds) < len(sizes) and bounds[-1] == sizes[-1]
        # no optimum of clearly fewer buckets fits the padding (a price skips numbers off the hull)
        fewer = packing.length_buckets(sizes, counts, most=max(1, int(len(bounds) * 0.9) - 2))
        assert padding(sizes, counts, fewer) > share * (sizes * counts).sum() or len(bounds) <= 3
    assert packing.length_buckets([5], [3]).tolist() == [5]


@pytest.mark.parametrize("mixed", [True, False])
def test_plans_hold_every_item_and_no_more_than_the_capacity(mixed):
    rng = random.Random(8)
    for _ in range(150):
        capacity = rng.randint(1, 60)
        bounds = np.array(sorted(rng.sample(range(0, capacity + 1), rng.randint(1, min(12, capacity + 1)))))
        counts = np.array([rng.choice([0, 1, 3, 40]) for _ in bounds])
        plan = packing.plan_batches(bounds, counts, capacity, mixed)
        held = defaultdict(list)
        for b, n in enumerate(counts):
            if n:
                for c in plan.container(np.full(n, b), np.arange(n)):
                    held[int(c)].append(b)
        assert all(sum(bounds[b] for b in bs) <= capacity for bs in held.values())
        assert sum(map(len, held.values())) == counts.sum()
        if not mixed:
            assert all(len({b for b in bs if bounds[b]}) <= 1 for bs in held.values())
        if counts[bounds > 0].sum():
            assert set(held) - {0} <= set(range(plan.containers)) and len(held) == plan.containers


def test_close_to_the_least_number_of_containers():
    rng = np.random.default_rng(1)
    sizes = np.minimum(2048, rng.lognormal(5.5, 1, 60000).astype(int) + 1)
    values, counts = np.unique(sizes, return_counts=True)
    bounds = packing.length_buckets(values, counts, 300)
    assert len(bounds) <= 300
    held = np.bincount(np.searchsorted(bounds, values), counts, len(bounds)).astype(int)
    assert packing.plan_batches(bounds, held, 2048).containers * 2048 < 1.02 * sizes.sum()


LIMITS = "limit_id int, tokenizer string, capacity int, bounds int"


@pytest.mark.parametrize(("most", "mixed", "shard"), [(1024, True, 10), (3, True, 10**6), (1024, False, 5)])
def test_packed_texts(spark, most, mixed, shard):
    rng = random.Random(6)
    texts = [None, "", " ", *["same words here"] * 60, *("tilt " * rng.randint(0, 90) for _ in range(80)), "x y " * 700]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, limit_id int")
    limits = spark.createDataFrame([(1, "byte_bpe_50k", 64, 0), (2, "piece_bpe_32k", 200, 0), (2, "piece_bpe_32k", 200, 0), (3, None, 5, 0), (4, "byte_bpe_50k", 0, 0), (None, "byte_bpe_50k", 9, 0)], LIMITS)
    rows = packing.pack(docs, limits, FOLDER, most, mixed, shard_items=shard).collect()
    for limit, name, capacity in ((1, "byte_bpe_50k", 64), (2, "piece_bpe_32k", 200)):
        size = dict(enumerate(packing.count_column(__import__("pyarrow").array(texts), [bpe.load_vocabulary(name, FOLDER)])[0].tolist()))
        parts, room = defaultdict(list), defaultdict(int)
        for r in rows:
            if r.limit_id == limit:
                parts[r.doc_id].append((r.part_no, r.begin_token, r.n_tokens))
                room[r.container_id] += r.n_tokens
        assert set(parts) == set(size)
        for d, p in parts.items():
            p.sort()
            whole, rest = divmod(size[d], capacity)
            expected = [capacity] * whole + ([rest] if rest or not whole else [])
            assert p == [(i, i * capacity, n) for i, n in enumerate(expected)]
        assert max(room.values()) <= capacity and set(room) == set(range(len(room)))
        if mixed and most > 3:
            assert len(room) <= 1.1 * sum(size.values()) / capacity + 1
    assert {r.limit_id for r in rows} == {1, 2}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    limits = spark.createDataFrame([(1, "byte_bpe_50k", 64, 0)], LIMITS)
    assert packing.pack(docs, limits.limit(0), FOLDER).count() == 0
    assert packing.pack(docs.limit(0), limits, FOLDER).count() == 0
