"""Queries of the llm problems over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotogrid.llm.bpe import encode_corpus
from rotogrid.llm.cutoff import cutoffs, kept_items
from rotogrid.llm.packing import pack, space_left
from rotogrid.llm.sentences import sentences
from rotogrid.llm.topn import top_n_per_group

TOP = 10


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    best = top_n_per_group(_table(spark, sf, "orientations"), "tomo_id", "score", ["x", "y", "z"], "pick_id", TOP)
    known = _table(spark, sf, "tomo_files").select("tomo_id").where(F.col("tomo_id").isNotNull())
    return best.join(known, "tomo_id", "left_semi")


def _cutoffs(spark: SparkSession, sf: str, **options) -> DataFrame:
    return cutoffs(_table(spark, sf, "orientations"), _table(spark, sf, "keep_targets"), "tomo_id", "score", "pick_id", "keep_permille", **options)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return kept_items(_table(spark, sf, "orientations"), _cutoffs(spark, sf), "tomo_id", "score", "pick_id")


def p3_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    return _cutoffs(spark, sf)


def p3_cutoffs_by_digits(spark: SparkSession, sf: str) -> DataFrame:
    """The way of sources with very many distinct scores, taken by every source of over 8."""
    return _cutoffs(spark, sf, wide_scores=8)


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(_table(spark, sf, "documents"), "byte_bpe_50k")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences(_table(spark, sf, "documents"))


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    return pack(_table(spark, sf, "documents"), _table(spark, sf, "pack_limits"))


def p7_space(spark: SparkSession, sf: str) -> DataFrame:
    return space_left(p7_packed(spark, sf), _table(spark, sf, "pack_limits"))


def p7_space_of_single_buckets(spark: SparkSession, sf: str) -> DataFrame:
    limits = _table(spark, sf, "pack_limits")
    return space_left(pack(_table(spark, sf, "documents"), limits, most=64, mixed=False), limits)  # 64 leave the least of 4 to 8192


_PICKS = """
WITH picks AS (
  SELECT DISTINCT tomo_id, pick_id, score + 0.0 AS score, x + 0.0 AS x, y + 0.0 AS y, z + 0.0 AS z
  FROM orientations
  WHERE tomo_id IS NOT NULL AND score IS NOT NULL AND isfinite(score)
)"""

_LIMITS = _PICKS + """,
counted AS (
  SELECT p.tomo_id, p.score, count(*) AS n FROM picks p JOIN keep_targets t ON p.tomo_id = t.tomo_id GROUP BY 1, 2
), summed AS (
  SELECT tomo_id, score, sum(n) OVER (PARTITION BY tomo_id ORDER BY score DESC) AS upto,
         sum(n) OVER (PARTITION BY tomo_id) AS total FROM counted
), limits AS (
  SELECT s.tomo_id, any_value(s.total) AS total, any_value((t.keep_permille * s.total + 999) // 1000) AS need, max(s.score) AS cutoff,
         min(s.upto) AS kept
  FROM summed s JOIN keep_targets t ON s.tomo_id = t.tomo_id
  WHERE s.upto * 1000 >= t.keep_permille * s.total GROUP BY s.tomo_id
)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p3_cutoffs": p3_cutoffs,
    "p3_cutoffs_by_digits": p3_cutoffs_by_digits,
    "p6_ids": p6_ids,
    "p7_packed": p7_packed,
    "p7_space": p7_space,
    "p7_space_of_single_buckets": p7_space_of_single_buckets,
    "p8_found": p8_found,
}

SQL: dict[str, str] = {
    "p1_found": _PICKS + f"""
SELECT tomo_id, pick_id FROM (
  SELECT tomo_id, pick_id, row_number() OVER (PARTITION BY tomo_id
    ORDER BY score DESC, x ASC NULLS LAST, y ASC NULLS LAST, z ASC NULLS LAST, pick_id) AS r
  FROM picks WHERE tomo_id IN (SELECT tomo_id FROM tomo_files)
) WHERE r <= {TOP}""",
    "p3_found": _LIMITS + """
SELECT p.tomo_id, p.pick_id FROM picks p JOIN limits l ON p.tomo_id = l.tomo_id WHERE p.score >= l.cutoff""",
    "p3_cutoffs": _LIMITS + """
SELECT tomo_id, CAST(total AS BIGINT) AS n_items, CAST(need AS BIGINT) AS need, cutoff, CAST(kept AS BIGINT) AS kept FROM limits""",
}
SQL["p3_cutoffs_by_digits"] = SQL["p3_cutoffs"]
