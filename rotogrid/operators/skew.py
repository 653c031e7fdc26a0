"""Joins whose left side may have hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a right side that are broadcast at most; beyond, the join is salted.
BROADCAST_ROWS = 200_000
SALTS = 32


def join_small(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", rows: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """Join a side with hot keys to one of few rows per key, such as one of aggregates.

    The right side is counted first (it should be cheap to compute, or written): up to ``rows`` rows it is
    broadcast. Beyond, it is repeated ``salts`` times and the left side's rows take a salt by their hash, which a task that is
    run again repeats, so a key that holds a third of all rows is spread over ``salts`` tasks. ``how``: inner, left, left_semi or left_anti.
    """
    keys = list(keys)
    if right.limit(rows + 1).count() <= rows:
        return left.join(F.broadcast(right), keys, how)
    own = [f.name for f in left.schema.fields if not f.dataType.simpleString().startswith(("map", "variant"))]
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return left.withColumn("__salt", F.pmod(F.xxhash64(*own), F.lit(salts)).cast("int")).join(right.withColumn("__salt", salt), [*keys, "__salt"], how).drop("__salt")
