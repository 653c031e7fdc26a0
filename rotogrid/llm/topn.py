"""Top N items of every group, with a hot-cold split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotogrid.session import cut

#: A group is heavy beyond the rows of this share of a task of the shuffle, or beyond HEAVY_ROWS if that is less.
TASK_SHARE = 0.25
HEAVY_ROWS = 200_000
#: At most so many groups can be heavy: the threshold is at least the row count over this, whatever else is asked for.
HEAVY_GROUPS = 10_000


def finite(column: Column) -> Column:
    """True where a double is neither null, NaN nor infinite."""
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) != F.lit(float("inf")))


def heavy_threshold(rows: int, partitions: int) -> int:
    """Rows from which on a group is heavy: ``TASK_SHARE`` of a task's even share, ``HEAVY_ROWS`` at most."""
    return max(1, min(HEAVY_ROWS, int(TASK_SHARE * rows / max(1, partitions))))


def top_n_per_group(
    items: DataFrame,
    group: str,
    score: str,
    ties: Sequence[str],
    item_id: str,
    n: int,
    heavy_rows: int | None = None,
) -> DataFrame:
    """The ``n`` items of highest ``score`` in every group, as rows (group, item_id).

    Order: score descending, then ``ties`` ascending with nulls last, then ``item_id``. An item
    delivered several times (same id and values) counts once: copies are neighbours in the order and
    share a dense rank, so no shuffle on the id is needed. Defined cases: rows with a null group or
    with a null, NaN or infinite score don't take part; -0.0 equals 0.0 in score and ties; a NaN tie
    sorts after every number and before null; a null id sorts last; groups with fewer items give all of them;
    ``n`` < 1 and empty input give no rows; further columns of ``items`` are ignored, whatever their names.

    Plan: exact counts per group are combined map-side and written to the shared folder; they split the rows. A group is
    heavy beyond ``heavy_rows``, by default a quarter of the rows that a task of the shuffle has on average, so the split
    follows the data and the cluster. The heavy groups, of which there can be ``HEAVY_GROUPS`` at most, are a local table
    that is broadcast. Light groups take an ordinary window, which Spark precedes with a per-task group limit, so
    that a task sends at most ``n`` ranks a group. Rows of a heavy group lose their copies first (combined map-side, so an id
    delivered millions of times is one row), are salted by count / threshold, range-partitioned by (group, salt) and limited
    there; the at most ``n`` x salts survivors of a group are ranked once more. No task ever holds a heavy group.
    """
    tie_names = [f"__t{i}" for i in range(len(ties))]
    rows = items.where(F.col(group).isNotNull() & finite(F.col(score).cast("double"))).select(
        F.col(group).alias("__g"),
        (F.col(score).cast("double") + F.lit(0.0)).alias("__s"),
        *[
            (F.col(t) + F.lit(0.0) if dict(items.dtypes)[t] in ("double", "float") else F.col(t)).alias(a)
            for t, a in zip(ties, tie_names)
        ],
        F.col(item_id).alias("__id"),
    )
    order = [F.col("__s").desc(), *[F.col(t).asc_nulls_last() for t in tie_names], F.col("__id").asc_nulls_last()]

    def limited(df: DataFrame, *keys: str) -> DataFrame:
        return df.withColumn("__r", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n)

    counts = cut(items.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("__g")).count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    threshold = max(1, heavy_threshold(total, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if heavy_rows is None else heavy_rows, total // HEAVY_GROUPS)
    found = counts.where(F.col("count") > threshold).collect()  # HEAVY_GROUPS rows at most
    if not found:
        return limited(rows, "__g").select("__g", "__id").distinct().select(F.col("__g").alias(group), F.col("__id").alias(item_id))
    heavy = F.broadcast(
        items.sparkSession.createDataFrame(
            [(r["__g"], -(-r["count"] // threshold)) for r in found], T.StructType([counts.schema["__g"], T.StructField("__salts", T.IntegerType())])
        )
    )
    light = limited(rows.join(heavy, "__g", "left_anti"), "__g")
    salted = (
        rows.join(heavy, "__g").distinct()
        .withColumn("__salt", F.pmod(F.xxhash64("__id", "__s"), F.col("__salts")).cast("int"))
        .drop("__salts")
        .repartitionByRange("__g", "__salt")
    )
    hot = limited(limited(salted, "__g", "__salt").drop("__r"), "__g")
    return (
        light.select("__g", "__id").unionByName(hot.select("__g", "__id")).distinct()
        .select(F.col("__g").alias(group), F.col("__id").alias(item_id))
    )
