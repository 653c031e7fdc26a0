"""Peak calling over score maps (tx, ty, tz, s and any further columns)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product
from operator import add

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rotogrid.operators.grid import Bounds
from rotogrid.operators.score import T
from rotogrid.session import cut

ORDER = (F.desc, "s"), *((F.asc, t) for t in T)


def _order():
    return [f(c) for f, c in ORDER]


def admissible(scores: DataFrame, bounds: Bounds | None = None, boundary: int = 0, low: float | None = None, high: float | None = None) -> DataFrame:
    """Scores that aren't null or NaN, lie within [low, high] and are at least ``boundary`` away from the volume's faces."""
    rows = scores.where(F.col("s").isNotNull() & ~F.isnan("s"))
    if low is not None:
        rows = rows.where(F.col("s") >= low)
    if high is not None:
        rows = rows.where(F.col("s") <= high)
    if bounds is not None and boundary:
        for t, (a, b) in zip(T, bounds):
            if b > a:
                rows = rows.where(F.col(t).between(a + boundary, b - boundary))
    return rows


def top(scores: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """The n highest scores, in all or per key; ties by position. Spark limits each task's rows before the shuffle."""
    if not keys:
        return scores.orderBy(*_order()).limit(n)
    return scores.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*_order()))).where(F.col("__r") <= n).drop("__r")


def _around(edge: int) -> list[tuple[int, int]]:
    return [-(edge // 2), (edge - 1) // 2]


def maximum_filter(scores: DataFrame, edge: int, bounds: Bounds, keys: Sequence[str] = ()) -> DataFrame:
    """Positions whose score is the maximum of the box of ``edge`` around them; outside and absent positions count as 0.

    The box maximum is separable: three passes of ``edge`` rows a score instead of edge**3, each combined map-side.
    """
    low, high = _around(edge)
    live = [t for t, (a, b) in zip(T, bounds) if b > a]
    spread = scores.select(*keys, *T, "s", F.lit(1).alias("n"))
    for t in live:
        spread = spread.withColumn(t, F.explode(F.sequence(F.col(t) - high, F.col(t) - low))).groupBy(*keys, *T).agg(F.max("s").alias("s"), F.sum("n").alias("n"))
    full = F.col("n") >= edge ** len(live)
    best = spread.select(*keys, *T, F.when(full, F.col("s")).otherwise(F.greatest("s", F.lit(0.0))).alias("__best"))
    return scores.join(best, [*keys, *T]).where(F.col("s") >= F.col("__best")).drop("__best")


def fast_peaks(scores: DataFrame, edge: int, bounds: Bounds) -> DataFrame:
    """The best position of every tile of ``edge`` that no score within +-edge (upper end excluded) exceeds."""
    tile = [F.floor((F.col(t) - a) / edge) for t, (a, _) in zip(T, bounds)]
    first = scores.withColumn("__r", F.row_number().over(Window.partitionBy(*tile).orderBy(*_order()))).where(F.col("__r") == 1).drop("__r")
    near = first.select(*[F.col(t).alias(f"p{t}") for t in T], F.col("s").alias("ps"), *[F.explode(F.sequence(F.floor((F.col(t) - a - edge) / edge), F.floor((F.col(t) - a + edge) / edge))).alias(f"c{t}") if i == 0 else F.lit(None).cast("bigint").alias(f"c{t}") for i, (t, (a, _)) in enumerate(zip(T, bounds))])
    for t, (a, _) in list(zip(T, bounds))[1:]:
        near = near.withColumn(f"c{t}", F.explode(F.sequence(F.floor((F.col(f"p{t}") - a - edge) / edge), F.floor((F.col(f"p{t}") - a + edge) / edge))))
    others = scores.select(*T, "s", *[c.alias(f"c{t}") for c, t in zip(tile, T)])
    close = F.lit(True)
    for t in T:
        close = close & (F.col(t) >= F.col(f"p{t}") - edge) & (F.col(t) < F.col(f"p{t}") + edge)
    beaten = near.join(others, [f"c{t}" for t in T]).where(close & (F.col("s") > F.col("ps"))).select(*[F.col(f"p{t}").alias(t) for t in T]).distinct()
    return first.join(beaten, list(T), "left_anti")


def bucket_filter(peaks: DataFrame, distance: float, keys: Sequence[str] = ()) -> DataFrame:
    """The best peak of every grid cell of edge ``distance``, the grid beginning at the least coordinates."""
    least = peaks.agg(F.struct(*[F.min(t).alias(t) for t in T]).alias("m")).scalar()
    rows = peaks.withColumn("__m", least)
    cell = [F.floor((F.col(t) - F.col("__m").getField(t)) / distance) for t in T]
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, *cell).orderBy(*_order()))).where(F.col("__r") == 1).drop("__r", "__m")


#: Undecided peaks that are decided together by one task; more are decided by tiles.
TOGETHER = 200_000
#: Least edge of the tiles; whole positions then bound a tile's peaks by its cells.
TILE = 64


def decide(at: np.ndarray, score: np.ndarray, state: np.ndarray, whole: np.ndarray, distance: float, box: bool, turn: np.ndarray | None = None, shapes: Mapping[int, frozenset] | None = None) -> np.ndarray:
    """States (1 stays, -1 goes, 0 can't be told here) of peaks, walked from the best score down, of equal ones by position.

    ``whole``: all neighbours of the peak are here. A peak goes if a better one that stays is close, stays if every close
    better one goes, and is left open otherwise. With ``shapes`` a peak is close to a better one if its offset from that is in
    the shape of the better one's rotation ``turn``. Only peaks that stay or are open are looked up, by cells of the distance.
    """
    out = np.zeros(len(score), np.int8)
    size = max(float(distance), 1e-9)
    order = np.lexsort((*at.T[::-1], -score))
    home = np.floor(at / size).astype(np.int64)
    offsets = list(product((-1, 0, 1), repeat=at.shape[1]))
    held: dict[tuple, list[tuple[tuple, bool, frozenset | None]]] = {}
    limit = distance if box else distance**2
    for i, p, cell in zip(order.tolist(), at[order].tolist(), map(tuple, home[order].tolist())):
        found = 1 if whole[i] else 0
        if state[i] == 1:
            found = 1
        else:
            for o in offsets:
                for q, stays, shape in held.get(tuple(map(add, cell, o)), ()):
                    near = tuple(int(x - y) for x, y in zip(p, q)) in shape if shape is not None else max(abs(x - y) for x, y in zip(p, q)) <= limit if box else sum((x - y) ** 2 for x, y in zip(p, q)) < limit
                    if near:
                        found = -1 if stays else min(found, 0)
                        if stays:
                            break
                if found < 0:
                    break
        out[i] = found
        if found >= 0:
            held.setdefault(cell, []).append((p, found == 1, None if shapes is None else shapes[int(turn[i])]))
    return out


def _decider(columns: Sequence[str], edge: float, offset: Sequence[float] | None, distance: float, box: bool, shapes: Mapping[int, frozenset] | None):
    """Decides the peaks of a tile's core, or of all that is left if there is no grid; what stayed before is then not repeated."""

    def run(key, pdf):
        at, state = pdf[list(T)].to_numpy(float), pdf["state"].to_numpy()
        core = np.ones(len(pdf), bool)
        if offset is not None:
            core = (np.floor((at - np.array(offset)) / edge) == np.array(key[-3:], float)).all(1)
        keep = core if offset is not None else state != 1
        return pdf.assign(state=decide(at, pdf["s"].to_numpy(float), state, core, distance, box, pdf["r"].to_numpy() if shapes else None, shapes)).loc[keep, columns]

    return run


def suppress(peaks: DataFrame, distance: float, keys: Sequence[str] = (), box: bool = False, together: int = TOGETHER, tile: int = TILE, shapes: Mapping[int, frozenset] | None = None) -> DataFrame:
    """Greedy suppression in score order: a peak stays if no staying better peak is closer than ``distance``.

    ``box``: the distance is the largest coordinate difference, inclusive, as when a box around each peak is emptied.
    ``shapes``: offsets around a peak of each rotation ``r`` that it empties; the distance must reach all of them.
    Defined cases: of equal scores the lower position is better; a worse score at the same position goes, equal rows stay or
    go together; keys may be null; an empty table gives no rows.

    Plan: rounds to a fixed point. In each, tiles with a halo of the distance walk their peaks from the best down and decide all that
    doesn't depend on open peaks of other tiles; the grid moves from round to round, so chains go on across
    former borders. What is open and what stays is written to the shared folder after each round. As soon as no more than
    ``together`` peaks are open, one task decides them with the stayers around them. The best open peak is always
    decided, so every round makes progress, and none is given up. No pairs are made.
    """
    keys = list(keys)
    best = F.max("s").alias("s") if shapes is None else F.max_by(F.struct("s", "r"), F.struct("s", -F.col("r"))).alias("b")
    rows = peaks.groupBy(*keys, *T).agg(best)
    if shapes is not None:
        rows = rows.select(*keys, *T, "b.s", "b.r")
    rows = cut(rows.withColumn("state", F.lit(0).cast("tinyint")))
    edge = max(float(tile), 8.0 * distance)
    schema = rows.schema
    columns = rows.columns
    turn = 0
    while True:
        undecided = rows.where("state = 0").count()
        if not undecided:
            break
        small = undecided <= together
        if small:
            # stayers matter only next to open peaks
            cell = [F.floor(F.col(t) / max(float(distance), 1e-9)).alias(f"c{t}") for t in T]
            around = rows.where("state = 0").select(*keys, *cell)
            for t in T:
                around = around.withColumn(f"c{t}", F.explode(F.sequence(F.col(f"c{t}") - 1, F.col(f"c{t}") + 1)))
            near = around.distinct()
            stayers = rows.where("state = 1").alias("w")
            touched = stayers.join(near.alias("n"), [F.col(f"w.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys] + [F.floor(F.col(f"w.{t}") / max(float(distance), 1e-9)) == F.col(f"n.c{t}") for t in T], "left_semi")
            whole = rows.where("state = 0").unionByName(touched.select(*columns)).withColumns({f"k{t}": F.lit(0) for t in T})
            offset = None
        else:
            offset = [(turn * f) % edge for f in (edge * 0.5, edge * 0.31, edge * 0.77)] if turn else [0.0] * 3
            whole = rows
            for t, o in zip(T, offset):
                number = lambda c: F.floor((c - o) / edge).cast("int")  # noqa: B023, E731
                whole = whole.withColumn(f"k{t}", F.explode(F.sequence(number(F.col(t) - distance), number(F.col(t) + distance))))

        run = _decider(columns, edge, offset, distance, box, shapes)
        found = whole.groupBy(*keys, *[f"k{t}" for t in T]).applyInPandas(run, schema).where("state >= 0")
        # stayers that the last task saw are among the rows already
        rows = cut(rows.where("state = 1").unionByName(found) if small else found)
        turn += 1
    kept = rows.alias("k")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"k.{c}")) for c in (*keys, *T, "s")]
    return peaks.alias("p").join(kept, same, "left_semi")


def rotated_shapes(mask: np.ndarray, rotations: Sequence[np.ndarray]) -> dict[int, frozenset]:
    """The offsets from the centre (size // 2) that a mask covers in each rotation, interpolated linearly, half or more."""
    from rotogrid.operators.dense import rotate

    middle = np.array(mask.shape) // 2
    return {r: frozenset(tuple(int(c) for c in at - middle) for at in np.argwhere(rotate(np.asarray(mask, float), m, 1) >= 0.5)) for r, m in enumerate(rotations)}


def recursive_masking(scores: DataFrame, distance: int, n: int, low: float | None = None, mask: np.ndarray | None = None, rotations: Sequence[np.ndarray] = ()) -> DataFrame:
    """Peaks found by taking the maximum and emptying its surroundings, again and again, best n: a box of ``distance`` around it,
    or the cells of ``mask`` turned by the peak's own rotation ``r`` of ``rotations``."""
    rows = admissible(scores, low=low)
    if mask is None:
        return top(suppress(rows, distance, box=True), n)
    shapes = rotated_shapes(mask, rotations)
    reach = max((max(map(abs, o)) for shape in shapes.values() for o in shape), default=0)
    return top(suppress(rows, max(reach, 1), box=True, shapes=shapes), n)


def clusters(peaks: DataFrame, least: int = 8) -> DataFrame:
    """Positions that at least ``least`` peaks share, each with its best score; fewer are noise."""
    return peaks.groupBy(*T).agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("s")).where(F.col("n") >= least)


def to_target(peaks: DataFrame, shape: Sequence[int], fast: Sequence[int], shift: Sequence[int]) -> DataFrame:
    """Positions of a padded, shifted score array in target coordinates; those outside the target are dropped."""
    out = peaks.select(*[F.pmod(F.col(t) + s, F.lit(f)).cast("int").alias(t) for t, s, f in zip(T, shift, fast)], *[c for c in peaks.columns if c not in T])
    for t, n in zip(T, shape):
        out = out.where(F.col(t).between(0, n - 1))
    return out


def to_scores(peaks: DataFrame, fast: Sequence[int], shift: Sequence[int]) -> DataFrame:
    """The inverse of :func:`to_target`."""
    return peaks.select(*[F.pmod(F.col(t) - s, F.lit(f)).cast("int").alias(t) for t, s, f in zip(T, shift, fast)], *[c for c in peaks.columns if c not in T])


def oversample(patch: np.ndarray, factor: int = 8) -> tuple[np.ndarray, float]:
    """Sub-voxel maximum near the centre of a score patch: its spectrum evaluated on a finer grid of +-0.75 voxels."""
    spectrum = np.fft.fftn(patch)
    fine = np.arange(-int(0.75 * factor), int(0.75 * factor) + 1) / factor
    out = spectrum
    for axis, n in enumerate(patch.shape):
        k = np.fft.fftfreq(n)
        kernel = np.exp(2j * np.pi * np.outer(n // 2 + fine, k)) / n
        out = np.moveaxis(np.tensordot(kernel, np.moveaxis(out, axis, 0), 1), 0, axis)
    at = np.unravel_index(np.argmax(np.abs(out)), out.shape)
    return np.array([fine[i] for i in at]), float(np.abs(out[at]))


def oversample_peaks(peaks: DataFrame, scores: DataFrame, half: int = 3, factor: int = 8) -> DataFrame:
    """Refined positions (fx, fy, fz) of each peak from the scores around it. A task sees one small patch at a time."""
    near = peaks.select(*[F.col(t).alias(f"p{t}") for t in T], *[F.lit(0).alias(f"d{t}") for t in T])
    for t in T:
        near = near.withColumn(f"d{t}", F.explode(F.lit(list(range(-half, half + 1))))).withColumn(t, F.col(f"p{t}") + F.col(f"d{t}"))
    joined = near.join(scores.select(*T, "s"), list(T))
    names = [f"p{t}" for t in T]

    def refine(key, pdf):
        import pandas as pd

        live = [t for t in T if pdf[f"d{t}"].nunique() > 1]
        patch = np.zeros([2 * half + 1] * max(1, len(live)))
        np.add.at(patch, tuple(pdf[f"d{t}"].to_numpy() + half for t in live) or (np.zeros(len(pdf), int),), pdf["s"].to_numpy())
        offset, value = oversample(patch, factor) if live else (np.zeros(0), float(pdf["s"].iloc[0]))
        shift = dict(zip(live, offset))
        return pd.DataFrame([[*key, *[k + shift.get(t, 0.0) for k, t in zip(key, T)], value]], columns=[*T, "fx", "fy", "fz", "fs"])

    return joined.groupBy(*names).applyInPandas(refine, "tx int, ty int, tz int, fx double, fy double, fz double, fs double")


def merge(*parts: DataFrame, distance: float, n: int) -> DataFrame:
    """Peaks of several tiles or runs together: suppressed in score order, then the best n. Equal positions keep their best score."""
    rows = parts[0].select(*T, "s")
    for p in parts[1:]:
        rows = rows.unionByName(p.select(*T, "s"))
    return top(suppress(rows.groupBy(*T).agg(F.max("s").alias("s")), distance), n)


def local_maxima(scores: DataFrame, distance: int, bounds: Bounds, n: int, low: float | None = None) -> DataFrame:
    """Maxima of boxes of 2 distance + 1, not nearer to a face than the distance, suppressed by it, best n."""
    inner = admissible(maximum_filter(scores, 2 * distance + 1, bounds), bounds, distance, low)
    return top(suppress(inner, distance + 1e-9, box=True), n)
