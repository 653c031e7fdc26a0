"""Command line: match, postprocess, preprocess, estimate, discover."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

import numpy as np


SCORES = ("CC", "LCC", "CORR", "CAM", "FLC", "FLCSphericalMask", "MCC")
SUFFIXES = {"star": "star", "xml": "xml", "mdoc": "mdoc"}


def _table(spark, path: str | None, read, other: str):
    """Rows of a tilt or CTF file, whose kind follows from its suffix."""
    from rotogrid.sources.files import read_bytes

    return read(read_bytes(spark, path).decode(), SUFFIXES.get(path.rsplit(".", 1)[-1], other)) if path else None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("rotogrid")
    s = p.add_subparsers(dest="command", required=True)
    m = s.add_parser("match", help="score a template against a volume")
    for a in ("target", "template", "out"):
        m.add_argument(a)
    m.add_argument("--mask")
    m.add_argument("--score", default="FLCSphericalMask", choices=SCORES)
    m.add_argument("--sampling", type=float, default=60.0)
    m.add_argument("--diameter", type=float, help="particle diameter; sets the sampling")
    m.add_argument("--lowpass", type=float)
    m.add_argument("--highpass", type=float)
    m.add_argument("--edge", type=int, help="cells of a block's core; by default as many as fit")
    m.add_argument("--tilts", help="tilt file (text, star, xml or mdoc) whose reach and weights filter the template")
    m.add_argument("--weight", default="none", choices=("none", "angle", "relion", "grigorieff"))
    m.add_argument("--ctf", help="CTF file (star, xml, mdoc or estimation output) that filters the template")
    m.add_argument("--target-lowpass", type=float)
    m.add_argument("--target-highpass", type=float)
    m.add_argument("--whiten", action="store_true", help="whiten the target's spectrum")
    m.add_argument("--seeds", help="pick list; only its surroundings are searched")
    m.add_argument("--radius", type=float, default=10.0)
    m.add_argument("--cone", type=float, default=15.0)
    m.add_argument("--order", type=int, default=1)
    q = s.add_parser("postprocess", help="call peaks of a score map")
    for a in ("scores", "out"):
        q.add_argument(a)
    q.add_argument("--peaks", type=int, default=1000)
    q.add_argument("--distance", type=float, default=5.0)
    q.add_argument("--boundary", type=int, default=0)
    q.add_argument("--min-score", type=float)
    q.add_argument("--max-score", type=float)
    q.add_argument("--false-positives", type=float)
    q.add_argument("--caller", default="maximum_filter")
    r = s.add_parser("preprocess", help="filter a volume")
    for a in ("source", "method", "out"):
        r.add_argument(a)
    r.add_argument("--parameters", default="{}", help="JSON")
    e = s.add_parser("estimate", help="bytes of a matching run")
    for a in ("target", "template"):
        e.add_argument(a, help="comma-separated shape")
    e.add_argument("--score", default="FLCSphericalMask")
    e.add_argument("--cores", type=int, default=1)
    d = s.add_parser("discover", help="match tomogram, metadata and mask files")
    for a in ("tomograms", "metadata"):
        d.add_argument(a)
    d.add_argument("--masks")
    return p


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.command == "estimate":
        from rotogrid.operators.dense import memory_bytes

        print(memory_bytes([int(x) for x in a.target.split(",")], [int(x) for x in a.template.split(",")], a.score, a.cores))
        return 0
    if a.command == "preprocess":
        from rotogrid.functions.preprocess import apply_method
        from rotogrid.sources import volumes

        data, origin, rate = volumes.read(Path(a.source).read_bytes(), a.source)
        Path(a.out).write_bytes(volumes.write_mrc(np.asarray(apply_method(np.asarray(data, float), a.method, json.loads(a.parameters)), np.float32), origin, rate, a.out.endswith(".gz")))
        return 0
    from pyspark.sql import SparkSession

    from rotogrid import pipeline
    from rotogrid.shipping import ship_package

    spark = SparkSession.builder.getOrCreate()
    ship_package(spark)
    if a.command == "match":
        sampling = a.sampling
        if a.diameter:
            from rotogrid.functions.lattice import sampling_of_diameter
            from rotogrid.sources import volumes
            from rotogrid.sources.files import read_bytes

            rate = float(volumes.read(read_bytes(spark, a.template), a.template)[2][0])
            sampling = sampling_of_diameter(a.diameter, rate, a.lowpass or 0.0)
        from rotogrid.sources import text

        seeds = pipeline.read_seeds(spark, a.seeds) if a.seeds else None
        pipeline.match(
            spark, a.target, a.template, a.mask, a.out, sampling=sampling, score=a.score, edge=a.edge, lowpass=a.lowpass, order=a.order, highpass=a.highpass, tilts=_table(spark, a.tilts, text.tilts, "text"), weight=a.weight,
            ctf=_table(spark, a.ctf, text.ctf_rows, "ctffind"), target_lowpass=a.target_lowpass, target_highpass=a.target_highpass, whiten=a.whiten, seeds=seeds, radius=a.radius, cone=a.cone,
        )
    elif a.command == "postprocess":
        scores, meta = pipeline.load_scores(spark, a.scores)
        found = pipeline.call(scores, meta, a.peaks, a.distance, a.boundary, a.min_score, a.max_score, a.caller, a.false_positives)
        pipeline.write_picks(pipeline.picks_of(spark, found, meta), a.out)
    else:
        from rotogrid.operators.postprocess import discover

        listing = lambda g: spark.read.format("binaryFile").load(g).select("path")
        for row in discover(listing(a.tomograms), listing(a.metadata), listing(a.masks) if a.masks else None).orderBy("tomo").toLocalIterator():
            print(json.dumps(row.asDict()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
