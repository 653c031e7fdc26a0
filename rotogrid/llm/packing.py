"""Packing of texts into containers of a fixed token capacity by optimal length buckets."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rotogrid.llm.bpe import TOKENIZERS, count_column, load_vocabulary
from rotogrid.session import cut

#: Padding of items to their bucket's bound, as a share of all tokens; the dynamic program chooses the fewest buckets for it.
PADDING = 0.00003
#: Items ranked together within a bucket.
SHARD_ITEMS = 200_000


def _buckets_at(sizes: np.ndarray, counts: np.ndarray, price: float) -> list[int]:
    """Last index of each bucket that minimises padding plus ``price`` per bucket: the dynamic program
    best[j] = min over i of best[i] + padding of (i, j] + price, by the lower hull of its lines."""
    n = len(sizes)
    items = np.concatenate([[0], np.cumsum(counts)]).tolist()
    total = np.concatenate([[0], np.cumsum(counts * sizes)]).tolist()
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    hull = [0]  # lines y = best[i] + total[i] - items[i] * x, by falling slope
    head = 0
    value = lambda i, x: best[i] + total[i] - items[i] * x
    for j in range(1, n + 1):
        x = int(sizes[j - 1])
        while head + 1 < len(hull) and value(hull[head + 1], x) <= value(hull[head], x):
            head += 1
        i = hull[head]
        best[j], back[j] = value(i, x) + x * items[j] - total[j] + price, i
        c = lambda i: best[i] + total[i]
        while len(hull) - head >= 2 and (c(j) - c(hull[-1])) * (items[hull[-1]] - items[hull[-2]]) <= (c(hull[-1]) - c(hull[-2])) * (items[j] - items[hull[-1]]):
            hull.pop()
        hull.append(j)
    ends = []
    j = n
    while j:
        ends.append(j - 1)
        j = back[j]
    return ends[::-1]


def length_buckets(sizes: Sequence[int], counts: Sequence[int], most: int | None = None, padding: float = PADDING) -> np.ndarray:
    """Upper bounds of buckets over a histogram of distinct sizes (ascending) that minimise the padding of every item to
    its bucket's bound for their number, which is the least whose padding is at most the share ``padding`` of all tokens,
    or at most ``most`` if given. The number is set by bisection on a price per bucket."""
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    ends = np.arange(len(sizes))
    room = padding * float((counts * sizes).sum())
    held = np.concatenate([[0], np.cumsum(counts)])
    total = float((counts * sizes).sum())

    def enough(last: np.ndarray) -> bool:
        if most is not None:
            return len(last) <= most
        return float((sizes[last] * np.diff(held[np.concatenate([[0], last + 1])])).sum()) - total <= room

    # a higher price gives fewer buckets and more padding
    low, high = 1e-3, float((counts * (sizes[-1:] - sizes)).sum()) + 1.0
    found = ends if most is None else ends[-1:]
    for _ in range(50):
        if high / low < 1 + 1e-9:
            break
        price = (low * high) ** 0.5
        last = np.array(_buckets_at(sizes, counts, price), np.int64)
        if enough(last) == (most is None):
            low = price
        else:
            high = price
        if enough(last):
            found = last
        if most is not None and len(last) == most:
            break
    return sizes[found]


@dataclass
class Plan:
    """Containers for the items of every bucket: ranks from ``rank_from`` on lie ``per`` to a container from ``first`` on."""

    bounds: np.ndarray
    bucket: np.ndarray
    rank_from: np.ndarray
    per: np.ndarray
    first: np.ndarray
    containers: int
    items: int

    def container(self, bucket: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.bucket * (1 << 45) + self.rank_from, bucket * (1 << 45) + rank, "right") - 1
        return self.first[at] + (rank - self.rank_from[at]) // self.per[at]


def plan_batches(bounds: np.ndarray, counts: np.ndarray, capacity: int, mixed: bool = True) -> Plan:
    """Token-budget batches over buckets of items that count as long as their bucket's bound.

    With ``mixed`` a batch may hold several buckets: buckets are taken from the longest down, and their items go to the
    batches with the least room that is enough, all batches of one content at once, so the work depends on
    the number of buckets only. Without it, batches form inside each bucket alone.
    """
    groups: list[list] = []  # [containers, ((bucket, per container), ...)]
    rooms: list[tuple[int, int]] = []  # (room left, group) ascending
    for b in range(len(bounds) - 1, -1, -1):
        size, left = int(bounds[b]), int(counts[b])
        if size == 0:
            continue
        at = bisect_left(rooms, (size, -1)) if mixed else len(rooms)
        while left and at < len(rooms):
            room, g = rooms.pop(at)
            per = room // size
            n, held = groups[g]
            full = min(n, left // per)
            rest = left - full * per if full < n else 0
            if full == n:
                groups[g][1] = (*held, (b, per))
                insort(rooms, (room - per * size, g))
            else:
                used = full + (rest > 0)
                if full:
                    groups.append([full, (*held, (b, per))])
                    insort(rooms, (room - per * size, len(groups) - 1))
                if rest:
                    groups.append([1, (*held, (b, rest))])
                    insort(rooms, (room - rest * size, len(groups) - 1))
                if n > used:
                    groups[g][0] = n - used
                    insort(rooms, (room, g))
                else:
                    groups[g][0] = 0
            left -= full * per + rest
            at = bisect_left(rooms, (size, -1))
        if left:
            per = capacity // size
            for n, k in ((left // per, per), (1 if left % per else 0, left % per)):
                if n:
                    groups.append([n, ((b, k),)])
                    insort(rooms, (capacity - k * size, len(groups) - 1))
    first = np.concatenate([[0], np.cumsum([n for n, _ in groups], dtype=np.int64)]).astype(np.int64)
    rows = sorted((b, g, k) for g, (n, held) in enumerate(groups) if n for b, k in held)
    taken: dict[int, int] = {}
    out = []
    for b, g, k in rows:
        out.append((b, taken.get(b, 0), k, first[g]))
        taken[b] = taken.get(b, 0) + k * groups[g][0]
    zero = [(b, 0, 1 << 44, 0) for b in range(len(bounds)) if bounds[b] == 0]
    array = np.array(zero + out, np.int64).reshape(-1, 4)
    empty = int(first[-1] == 0 and len(zero) > 0)
    return Plan(np.asarray(bounds, np.int64), array[:, 0], array[:, 1], array[:, 2], array[:, 3], int(first[-1]) + empty, int(np.sum(counts)))


def token_sizes(docs: DataFrame, tokenizers: Sequence[str], folder: str = TOKENIZERS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n0, n1, ...): the number of tokens of every text by each tokenizer. Null and empty texts have 0."""
    shared = docs.sparkSession.sparkContext.broadcast([load_vocabulary(t, folder) for t in tokenizers])
    names = [f"n{i}" for i in range(len(tokenizers))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_column(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in counts]], names=[id_column, *names])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text_column).cast("string")).mapInArrow(run, ", ".join([f"`{id_column}` {kind}", *[f"{n} bigint" for n in names]]))


def _items(docs: DataFrame, limits: list, folder: str, id_column: str, text_column: str) -> DataFrame:
    """Items of every limit: (limit_id, id, part_no, begin_token, n_tokens); texts above the capacity in parts."""
    tokenizers = sorted({r["tokenizer"] for r in limits})
    sizes = cut(token_sizes(docs, tokenizers, folder, id_column, text_column))
    each = F.array(*[F.struct(F.lit(r["limit_id"]).cast("int").alias("limit_id"), F.lit(r["capacity"]).cast("bigint").alias("capacity"), F.col(f"n{tokenizers.index(r['tokenizer'])}").alias("n")) for r in limits])
    return (
        sizes.select(F.col(id_column), F.explode(each).alias("l"))
        .select(id_column, "l.*")
        .withColumn("part_no", F.explode(F.expr("sequence(0L, greatest(0L, (n - 1) div capacity))")))
        .select("limit_id", id_column, F.col("part_no").cast("int").alias("part_no"), (F.col("part_no") * F.col("capacity")).alias("begin_token"), F.expr("least(capacity, n - part_no * capacity)").alias("n_tokens"))
    )


def _limits(limits: DataFrame) -> list:
    rows = limits.where("limit_id is not null and tokenizer is not null and capacity >= 1").select("limit_id", "tokenizer", "capacity").dropDuplicates(["limit_id"]).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("pack_limits is meant to have a few rows, 1000 at most")
    return sorted(rows, key=lambda r: r["limit_id"])


def make_plans(items: DataFrame, limits: list, most: int | None = None, mixed: bool = True, padding: float = PADDING) -> dict[int, Plan]:
    """A plan for each limit, from the global histogram of item sizes (at most capacity + 1 rows a limit)."""
    by: dict[int, list] = {r["limit_id"]: [] for r in limits}
    for r in items.groupBy("limit_id", "n_tokens").count().collect():
        by[r[0]].append((r[1], r[2]))
    plans = {}
    for r in limits:
        sizes, counts = np.array(sorted(by[r["limit_id"]]), np.int64).reshape(-1, 2).T
        bounds = length_buckets(sizes, counts, most, padding)
        if len(bounds) and sizes[0] == 0 and bounds[0] != 0:
            bounds = np.concatenate([[0], bounds])
        held = np.bincount(np.searchsorted(bounds, sizes), counts, len(bounds)).astype(np.int64)
        plans[r["limit_id"]] = plan_batches(bounds, held, int(r["capacity"]), mixed)
    return plans


def pack(
    docs: DataFrame, limits: DataFrame, folder: str = TOKENIZERS, most: int | None = None, mixed: bool = True,
    id_column: str = "doc_id", text_column: str = "text", shard_items: int = SHARD_ITEMS, padding: float = PADDING,
) -> DataFrame:
    """(limit_id, container_id, id, part_no, begin_token, n_tokens): every text in a container of every limit.

    A text longer than the capacity is cut into parts of exactly the capacity and a last one; no other is split.
    Defined cases: null and empty texts have 0 tokens, take no room and lie in container 0; repeated rows are items of
    their own; limits without tokenizer or a capacity of at least 1 are left out, of a limit given twice one counts;
    empty tables give no rows; further columns are ignored.

    Plan: token counts come from one narrow pass (texts are encoded as in :mod:`bpe`) and are written to the shared folder.
    The driver sees only the histogram of sizes, bounded by the capacity. Dynamic programming chooses, for every limit, the
    bucket bounds of least padding; batches are planned over buckets; items find their bucket by bisection of the bounds in
    an Arrow stage, and get their rank within a bucket in salted shards with offsets from a table of shard counts, so a
    bucket of any size is spread.
    """
    spark = docs.sparkSession
    rows = _limits(limits)
    if not rows:
        kind = docs.schema[id_column].dataType.simpleString()
        return spark.createDataFrame([], f"limit_id int, container_id bigint, `{id_column}` {kind}, part_no int, begin_token bigint, n_tokens bigint")
    items = _items(docs, rows, folder, id_column, text_column)
    plans = make_plans(items, rows, most, mixed, padding)
    shared = spark.sparkContext.broadcast(plans)
    shards = max(1, -(-sum(p.items for p in plans.values()) // max(1, shard_items)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limit, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            bucket = np.zeros(batch.num_rows, np.int32)
            for k in np.unique(limit):
                own = limit == k
                bucket[own] = np.searchsorted(shared.value[int(k)].bounds, size[own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bucket), *batch.columns[1:]], names=["limit_id", "bucket", *batch.schema.names[1:]])

    kind = docs.schema[id_column].dataType.simpleString()
    shard = F.pmod(F.xxhash64(id_column, "part_no"), F.lit(shards)).cast("int").alias("shard")
    placed = items.select("limit_id", "n_tokens", shard, id_column, "part_no", "begin_token").mapInArrow(
        place, f"limit_id int, bucket int, n_tokens bigint, shard int, `{id_column}` {kind}, part_no int, begin_token bigint"
    )
    by_size = items.groupBy("limit_id", "n_tokens", shard).count()
    counts = by_size.select("limit_id", "n_tokens", "shard", "count").mapInArrow(place, "limit_id int, bucket int, n_tokens bigint, shard int, count bigint")
    counts = counts.groupBy("limit_id", "bucket", "shard").agg(F.sum("count").alias("count"))
    before = Window.partitionBy("limit_id", "bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("limit_id", "bucket", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    ranked = (
        placed.withColumn("rank", F.row_number().over(Window.partitionBy("limit_id", "bucket", "shard").orderBy(id_column, "part_no")) - 1)
        .join(offsets, ["limit_id", "bucket", "shard"])
        .select("limit_id", "bucket", (F.col("rank") + F.col("offset")).cast("bigint").alias("rank"), id_column, "part_no", "begin_token", "n_tokens")
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limit, bucket, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            container = np.zeros(batch.num_rows, np.int64)
            for k in np.unique(limit):
                own = limit == k
                container[own] = shared.value[int(k)].container(bucket[own], rank[own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(container), *batch.columns[3:]], names=["limit_id", "container_id", *batch.schema.names[3:]])

    return ranked.mapInArrow(fill, f"limit_id int, container_id bigint, `{id_column}` {kind}, part_no int, begin_token bigint, n_tokens bigint")


def space_left(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per limit: containers, tokens, room in all, and the thousandths of it that are unused."""
    used = packed.groupBy("limit_id", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("limit_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"))
    return used.join(limits.select("limit_id", "capacity"), "limit_id").withColumn("room", F.col("containers") * F.col("capacity")).withColumn("unused_permille", F.round((1 - F.col("tokens") / F.col("room")) * 1000, 3))
