"""Exact order statistics without a global sort."""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotogrid.session import cut

#: Bits of each digit of a key, from the highest; a round sees at most 2**16 counts a rank.
DIGITS = (48, 32, 16, 0)
MASK = 0x7FFFFFFFFFFFFFFF


def order_key(value: Column) -> Column:
    """A bigint that sorts as the double does (IEEE 754 bits, negatives mirrored); -0.0 is 0.0, NaN the largest."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(MASK)))


def value_of(key: int) -> float:
    """The double of an order key."""
    bits = key if key >= 0 else key ^ MASK
    return struct.unpack("<d", struct.pack("<q", bits))[0]


def order_statistics(rows: DataFrame, column: str, ranks: Sequence[int]) -> list[float | None]:
    """The values of 0-based ascending ranks among the non-null values; None for ranks beyond them.

    Four rounds of counts by 16-bit digits of an order-preserving key: a pass and a map-side combined aggregation
    each, of which the driver sees at most 65,536 counts a rank. No task holds or sorts the values.
    """
    return _statistics(_keys(rows, column), ranks)


def _keys(rows: DataFrame, column: str) -> DataFrame:
    """The order keys alone, written, as they are read once a digit."""
    return cut(rows.where(F.col(column).isNotNull()).select(order_key(F.col(column).cast("double")).alias("k")))


def _statistics(keys: DataFrame, ranks: Sequence[int]) -> list[float | None]:
    state: dict[int, tuple[int | None, int]] = {r: (None, r) for r in ranks if r >= 0}
    for shift in DIGITS:
        prefixes = sorted({p for p, _ in state.values() if p is not None})
        part = keys if shift == DIGITS[0] else keys.where(F.shiftright("k", shift + 16).isin(prefixes))
        counts: dict[int | None, list[tuple[int, int]]] = {}
        for r in part.groupBy(F.shiftright("k", shift).alias("d")).count().collect():
            counts.setdefault(None if shift == DIGITS[0] else r["d"] >> 16, []).append((r["d"], r["count"]))
        for rank, (prefix, left) in list(state.items()):
            found = None
            for digit, n in sorted(counts.get(prefix, [])):
                if left < n:
                    found = digit
                    break
                left -= n
            if found is None:
                del state[rank]
            else:
                state[rank] = (found, left)
        if not state:
            break
    return [value_of(state[r][0]) if r in state else None for r in ranks]


def percentiles(rows: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Percentiles (0 to 1) with linear interpolation between neighbours; None without values."""
    keys = _keys(rows, column)
    n = keys.count()
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    wanted = sorted({k for a in at for k in (math.floor(a), math.ceil(a))})
    values = dict(zip(wanted, _statistics(keys, wanted)))
    return [values[math.floor(a)] + (values[math.ceil(a)] - values[math.floor(a)]) * (a - math.floor(a)) for a in at]
