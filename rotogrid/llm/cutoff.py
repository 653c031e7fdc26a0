"""Score cutoffs that keep a target fraction of every source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rotogrid.llm.topn import finite
from rotogrid.operators.order import DIGITS, order_key
from rotogrid.operators.skew import join_small
from rotogrid.session import cut

#: Sources with more distinct scores than this are cut by digits of the score instead of in one window.
WIDE_SCORES = 100_000


def _rows(items: DataFrame, source: str, score: str, item_id: str) -> DataFrame:
    return items.where(F.col(source).isNotNull() & finite(F.col(score).cast("double"))).select(
        F.col(source).alias("__g"), (F.col(score).cast("double") + F.lit(0.0)).alias("__s"), F.col(item_id).alias("__id")
    )


def _crossing(freq: DataFrame, key: str) -> DataFrame:
    """Per source the highest ``key`` at which the descending cumulative sum reaches ``__need``,
    with ``__above`` (the sum beyond that key) and ``__upto`` (the sum with it)."""
    down = Window.partitionBy("__g").orderBy(F.col(key).desc())
    sums = freq.withColumn("__upto", F.sum("__n").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return (
        sums.where((F.col("__upto") >= F.col("__need")) & (F.col("__upto") - F.col("__n") < F.greatest("__need", F.lit(1))))
        .withColumn("__above", F.col("__upto") - F.col("__n"))
    )


def cutoffs(
    items: DataFrame,
    targets: DataFrame,
    source: str,
    score: str,
    item_id: str,
    permille: str,
    wide_scores: int = WIDE_SCORES,
) -> DataFrame:
    """One row per source of ``targets`` with items that count: (source, n_items, need, cutoff, kept).

    ``need`` = ceil(permille * n / 1000); the cutoff is the highest score that occurs for which at least ``need``
    items score as high or higher: of all cutoffs that keep enough, the one closest to the target. Defined cases:
    null sources and null, NaN or infinite scores don't count; -0.0 equals 0.0; an item delivered several times
    counts once; sources without a target, targets without items, and null targets give no row; a target of 0
    gives the highest score; above 1000 permille nothing can be enough and there is no row; a source given
    several equal targets counts once (of different ones the largest holds); empty tables give no rows.

    Plan: items are made distinct on (source, score, id), so no source gathers in one task; counts per
    distinct score are combined map-side and written to the shared folder. Sources of at most ``wide_scores`` distinct
    scores take one cumulative window. Wider ones are cut by four 16-bit digits of the score's order-preserving bits, each a
    window over at most 65,536 sums, so the result is exact at any size. Tables of one row per source are broadcast
    up to a counted size, beyond it the frequencies are salted; the rows of a hot source never meet in a task.
    """
    goal = (
        targets.where(F.col(source).isNotNull() & F.col(permille).isNotNull())
        .groupBy(F.col(source).alias("__g")).agg(F.max(F.col(permille).cast("bigint")).alias("__permille"))
    )
    freq = cut(_rows(items, source, score, item_id).distinct().groupBy("__g", "__s").agg(F.count(F.lit(1)).alias("__n")))
    totals = cut(
        freq.groupBy("__g").agg(F.sum("__n").alias("__total"), F.count(F.lit(1)).alias("__scores")).join(goal, "__g")
        .withColumn("__need", F.expr("(__permille * __total + 999) div 1000"))  # an integer ceiling; a double would round
    )
    narrow = totals.where(F.col("__scores") <= wide_scores).drop("__permille", "__scores")
    result = _crossing(join_small(freq, narrow, ["__g"]), "__s").select("__g", "__total", "__need", "__s", F.col("__upto").alias("__kept"))

    wide = totals.where(F.col("__scores") > wide_scores).select("__g", "__total", "__need", F.col("__need").alias("__goal"), F.lit(0).cast("bigint").alias("__beyond"))
    if wide.isEmpty():
        return _named(result, source)
    left = cut(join_small(freq, wide.select("__g"), ["__g"], "left_semi").withColumn("__k", order_key(F.col("__s"))))
    state = wide
    for shift in DIGITS:
        digit = F.shiftright("__k", shift)
        if shift != DIGITS[0]:
            left = join_small(left, state.select("__g", "__digit"), ["__g"]).where(F.shiftright("__k", shift + 16) == F.col("__digit")).drop("__digit")
            state = state.drop("__digit")
        sums = left.groupBy("__g", digit.alias("__digit")).agg(F.sum("__n").alias("__n"), F.max("__s").alias("__s"))
        last = cut(
            _crossing(sums.join(state, "__g"), "__digit")
            .select("__g", "__total", "__goal", "__digit", "__s",
                    (F.col("__need") - F.col("__above")).alias("__need"),
                    (F.col("__beyond") + F.col("__above")).alias("__beyond"), "__n")
        )
        state = last.drop("__s", "__n")
    result = result.unionByName(
        last.select("__g", "__total", F.col("__goal").alias("__need"), "__s", (F.col("__beyond") + F.col("__n")).alias("__kept"))
    )
    return _named(result, source)


def _named(result: DataFrame, source: str) -> DataFrame:
    return result.select(
        F.col("__g").alias(source), F.col("__total").alias("n_items"), F.col("__need").alias("need"),
        F.col("__s").alias("cutoff"), F.col("__kept").alias("kept"),
    )


def kept_items(items: DataFrame, found: DataFrame, source: str, score: str, item_id: str) -> DataFrame:
    """The distinct items (source, item_id) at or above their source's cutoff, ``found`` being of :func:`cutoffs`."""
    limits = cut(found.select(F.col(source).alias("__g"), F.col("cutoff").alias("__cut")))
    return (
        join_small(_rows(items, source, score, item_id), limits, ["__g"]).where(F.col("__s") >= F.col("__cut"))
        .select(F.col("__g").alias(source), F.col("__id").alias(item_id)).distinct()
    )
