"""The test tables as volumes, images, signals, stacks, atoms and picks, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotogrid.functions.lattice import lattice_rotations, rotate_offset
from rotogrid.operators.grid import rasterize
from rotogrid.operators.score import Template

V3_BOUNDS = [(1, 50), (0, 10), (0, 8)]
V2_BOUNDS = [(1, 30), (0, 23), (0, 0)]
ROTATIONS = lattice_rotations()
POINTS = ((0, 0, 0, 4, 1), (1, 0, 0, 3, 1), (2, 0, 0, 1, 1), (0, 1, 0, 2, 1), (0, 0, 1, 1, 1), (-1, 0, 0, 1, 1))
TEMPLATE = Template(POINTS, 125)
FLAT = Template(((0, 0, 0, 3, 1), (1, 0, 0, 2, 1), (0, 1, 0, 1, 1), (-1, 0, 0, 2, 1), (0, -1, 0, 1, 1)), 9)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def volume(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return rasterize(table(spark, sf, "lineitem"), c("l_quantity"), F.rint(c("l_discount") * 100), F.rint(c("l_tax") * 100))


def image(spark: SparkSession, sf: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return rasterize(table(spark, sf, "events"), F.dayofmonth("ts"), F.hour("ts"), F.lit(0), keys=keys)


def signal(spark: SparkSession, sf: str) -> DataFrame:
    hours = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 3600)
    return rasterize(table(spark, sf, "events"), hours, F.lit(0), F.lit(0))


def stack(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as 4 x 4 x 4 volumes."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "e"))
    return rows.select("vec_id", "label", F.expr("i div 16").cast("int").alias("x"), F.expr("(i div 4) % 4").cast("int").alias("y"), F.expr("i % 4").cast("int").alias("z"), F.col("e").cast("double").alias("v"))


ELEMENTS = (("C", 6, 170, 12.011), ("N", 7, 155, 14.007), ("O", 8, 152, 15.999))


def elements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ELEMENTS), "element_symbol string, atomic_number int, vdw int, atomic_weight double")


def atoms(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as atoms: chain, residue, place, element."""
    c = F.col
    return table(spark, sf, "lineitem").select(
        c("l_returnflag").alias("chain"), c("l_suppkey").cast("int").alias("residue"), c("l_orderkey").alias("serial"), c("l_linenumber").alias("part"),
        c("l_quantity").cast("double").alias("x"), F.rint(c("l_discount") * 100).alias("y"), F.rint(c("l_tax") * 100).alias("z"),
        F.when(c("l_linestatus") == "O", "O").when(c("l_linenumber") % 2 == 0, "N").otherwise("C").alias("element_symbol"),
    )


def literal(v) -> str:
    """A SQL literal; floats in scientific form, which makes them doubles instead of decimals."""
    return f"'{v}'" if isinstance(v, str) else repr(v) if isinstance(v, int) or "e" in repr(v) else f"{v!r}e0"


def values(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"(VALUES {body}) AS t({names})"


V3 = "v3 AS (SELECT CAST(l_quantity AS INT) AS x, CAST(round_even(l_discount * 100, 0) AS INT) AS y, CAST(round_even(l_tax * 100, 0) AS INT) AS z, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3)"
V2 = "v2 AS (SELECT CAST(day(ts) AS INT) AS x, CAST(hour(ts) AS INT) AS y, CAST(0 AS INT) AS z, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2)"
V2K = "v2k AS (SELECT event_type, CAST(day(ts) AS INT) AS x, CAST(hour(ts) AS INT) AS y, CAST(0 AS INT) AS z, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2, 3)"
V1 = "v1 AS (SELECT CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS INT) AS x, CAST(0 AS INT) AS y, CAST(0 AS INT) AS z, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1)"
E4 = "e4 AS (SELECT vec_id, label, CAST(i // 16 AS INT) AS x, CAST((i // 4) % 4 AS INT) AS y, CAST(i % 4 AS INT) AS z, CAST(embedding[i + 1] AS DOUBLE) AS v FROM (SELECT vec_id, label, embedding, CAST(unnest(range(0, 64)) AS INT) AS i FROM embeddings))"
ATOMS = "atoms AS (SELECT l_returnflag AS chain, CAST(l_suppkey AS INT) AS residue, l_orderkey AS serial, l_linenumber AS part, CAST(l_quantity AS DOUBLE) AS x, round_even(l_discount * 100, 0) AS y, round_even(l_tax * 100, 0) AS z, CASE WHEN l_linestatus = 'O' THEN 'O' WHEN l_linenumber % 2 = 0 THEN 'N' ELSE 'C' END AS element_symbol FROM lineitem)"
ELEMENTS_SQL = f"elements AS (SELECT * FROM {values(ELEMENTS, 'element_symbol, atomic_number, vdw, atomic_weight')})"


def expansion_sql(template: Template, rotations, name: str = "tpl") -> str:
    rows = [(r, *rotate_offset(rot, p[:3]), float(p[3]), float(p[4])) for r, rot in enumerate(rotations) for p in template.points]
    return f"{name} AS (SELECT * FROM {values(rows, 'r, ox, oy, oz, g, m')})"


def bounds_sql(bounds, names=("tx", "ty", "tz")) -> str:
    return " AND ".join(f"{n} BETWEEN {a} AND {b}" for n, (a, b) in zip(names, bounds))


def placed_sql(source: str, bounds, key: str = "", tpl: str = "tpl", wrap: bool = False, name: str = "placed", extra: str = "") -> str:
    """The rows that :func:`placed` makes."""
    k = f"{key}, " if key else ""
    cells = [f"(({c} - o{c} - {a}) % {b - a + 1} + {b - a + 1}) % {b - a + 1} + {a}" if wrap else f"{c} - o{c}" for c, (a, b) in zip("xyz", bounds)]
    shifted = ", ".join(f"{e} AS t{c}" for e, c in zip(cells, "xyz"))
    where = "" if wrap else f"WHERE {bounds_sql(bounds)}"
    return f"{name} AS (SELECT * FROM (SELECT {k}{shifted}, r, g, m, v{extra} FROM {source}, {tpl}) {where})"


def dense_sql(source: str, bounds, name: str = "dense") -> str:
    axes = ", ".join(f"(SELECT CAST(unnest(range({a}, {b + 1})) AS INT) AS {c})" for c, (a, b) in zip("xyz", bounds))
    return f"{name} AS (SELECT g.x, g.y, g.z, coalesce(s.v, 0.0) AS v FROM (SELECT * FROM {axes}) g LEFT JOIN {source} s ON g.x = s.x AND g.y = s.y AND g.z = s.z)"


def register(spark: SparkSession, sf: str) -> list[str]:
    """Temporary views of the encodings for Spark SQL: voxels, pixels, samples, stack, atoms, elements, template, orientations."""
    from rotogrid.operators.score import expansion

    views = {
        "voxels": volume(spark, sf), "pixels": image(spark, sf, ("event_type",)), "samples": signal(spark, sf), "stack": stack(spark, sf), "atoms": atoms(spark, sf), "elements": elements(spark),
        "template": spark.range(1).select(F.explode(expansion(TEMPLATE, ROTATIONS)).alias("e")).select("e.*"), "orientations": table(spark, sf, "orientations"),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return sorted(views)
