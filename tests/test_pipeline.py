from __future__ import annotations

import json

import numpy as np
import pytest

from rotogrid import pipeline
from rotogrid.__main__ import main
from rotogrid.functions import preprocess as Pr
from rotogrid.sources import picks as Pk
from rotogrid.sources import volumes as V


def scene(tmp_path):
    rng = np.random.default_rng(0)
    template = np.zeros((7, 7, 7), np.float32)
    template[2:5, 1:6, 3:5] = 1
    template[2, 1, 3] = 3
    target = rng.normal(0, 0.05, (40, 36, 30)).astype(np.float32)
    for x, y, z in ((10, 12, 9), (28, 20, 21)):
        target[x - 3 : x + 4, y - 3 : y + 4, z - 3 : z + 4] += template
    for name, a in (("target", target), ("template", template)):
        (tmp_path / f"{name}.mrc").write_bytes(V.write_mrc(a))
    return str(tmp_path / "target.mrc"), str(tmp_path / "template.mrc")


def test_files_to_picks(spark, tmp_path):
    target, template = scene(tmp_path)
    out = str(tmp_path / "scores")
    assert main(["match", target, template, out, "--sampling", "180", "--edge", "16", "--score", "FLC"]) == 0
    assert main(["postprocess", out, str(tmp_path / "picks.star"), "--peaks", "2", "--distance", "6", "--boundary", "2"]) == 0
    rows = Pk.parse_star((tmp_path / "picks.star").read_text())
    assert {(r["x"], r["y"], r["z"]) for r in rows} == {(10, 12, 9), (28, 20, 21)} and min(r["score"] for r in rows) > 0.8
    scores, meta = pipeline.load_scores(spark, out)
    assert scores.count() == 40 * 36 * 30
    for caller in ("fast", "sort", "recursive"):
        found = pipeline.call(scores, meta, 2, 6.0, 2, low=0.5, caller=caller)
        assert {(r.tx, r.ty, r.tz) for r in found.collect()} == {(10, 12, 9), (28, 20, 21)}
    assert pipeline.call(scores, meta, 50, 6.0, 2, false_positives=0.01).count() >= 2
    with pytest.raises(ValueError):
        pipeline.call(scores, meta, caller="none")
    for kind, parse in (("txt", Pk.parse_text), ("tbl", Pk.parse_dynamo)):
        pipeline.write_picks(pipeline.picks_of(spark, pipeline.call(scores, meta, 2, 6.0, 2), meta), str(tmp_path / f"p.{kind}"))
        assert len(parse((tmp_path / f"p.{kind}").read_text())) == 2


def test_rotated_template_is_found(spark, tmp_path):
    target, template = scene(tmp_path)
    turns = np.array([np.eye(3), [[0, -1, 0], [1, 0, 0], [0, 0, 1]]], float)
    best = pipeline.match(spark, target, template, rotations=turns, edge=24, score="FLC", threshold=0.5)
    row = best.orderBy(best.s.desc()).first()
    assert (row.tx, row.ty, row.tz) in ((10, 12, 9), (28, 20, 21)) and row.r == 0
    assert pipeline.rotation_set(180).shape == (1, 3, 3) and len(pipeline.rotation_set(30, cone=20)) > 10
    (tmp_path / "tbad.mrc").write_bytes(b"no volume")
    folder = pipeline.match_folder(spark, str(tmp_path / "t*.mrc"), template, str(tmp_path / "all"), sampling=180)
    assert set(folder) == {"target", "template", "tbad"} and folder["tbad"].startswith("error")
    alone = pipeline.match(spark, target, template, sampling=180)
    scores, meta = pipeline.load_scores(spark, folder["target"])
    assert meta["shape"] == [40, 36, 30]
    close = {tuple(r)[:3]: r.s for r in scores.collect()}
    assert all(abs(close[tuple(r)[:3]] - r.s) < 1e-4 for r in alone.collect()) and len(close) == 40 * 36 * 30


def test_any_score_with_filters_and_seeds(spark, tmp_path):
    target, template = scene(tmp_path)
    tilts = [{"tilt": i, "angle": float(a), "weight": 1.0} for i, a in enumerate(range(-60, 61, 3))]
    for score in ("CC", "LCC", "CORR", "CAM", "FLC", "FLCSphericalMask", "MCC"):
        best = pipeline.match(spark, target, template, sampling=180, edge=24, score=score, threshold=-1e9)
        row = best.where("tx between 4 and 35 and ty between 4 and 31 and tz between 4 and 25").orderBy(best.s.desc()).first()
        assert (row.tx, row.ty, row.tz) in ((10, 12, 9), (28, 20, 21)), score
    filtered = pipeline.match(spark, target, template, sampling=180, score="FLC", tilts=tilts, lowpass=2.0, target_highpass=30.0, target_lowpass=2.0)
    assert tuple(filtered.orderBy(filtered.s.desc()).first())[:3] in ((10, 12, 9), (28, 20, 21))
    (tmp_path / "seeds.txt").write_text("x\ty\tz\teuler_x\teuler_y\teuler_z\n27\t21\t20\t0\t0\t0\n")
    seeds = pipeline.read_seeds(spark, str(tmp_path / "seeds.txt"))
    near = pipeline.match(spark, target, template, sampling=180, seeds=seeds, radius=3.0, cone=10.0, edge=16).collect()
    assert {(r.tx, r.ty, r.tz) for r in near} == {(x, y, z) for x in range(40) for y in range(36) for z in range(30) if (x - 27) ** 2 + (y - 21) ** 2 + (z - 20) ** 2 <= 9}
    assert tuple(max(near, key=lambda r: r.s))[:3] == (28, 20, 21)
    turned = np.array([[[1, 0, 0], [0, 0, -1], [0, 1, 0]]], float)
    assert pipeline.match(spark, target, template, rotations=turned, seeds=seeds, radius=3.0, cone=10.0, edge=16).count() == 0
    with pytest.raises(ValueError):
        pipeline.match(spark, target, template, sampling=180, score="none", edge=16)


def test_command_line(tmp_path, capsys):
    a = np.random.default_rng(1).random((8, 8, 8)).astype(np.float32)
    (tmp_path / "a.mrc").write_bytes(V.write_mrc(a))
    assert main(["preprocess", str(tmp_path / "a.mrc"), "gaussian", str(tmp_path / "b.mrc"), "--parameters", '{"sigma": 1.0}']) == 0
    b = V.read((tmp_path / "b.mrc").read_bytes(), "b.mrc")[0]
    assert b.std() < a.std() and b.mean() == pytest.approx(a.mean(), abs=0.02)
    assert main(["estimate", "100,100,100", "20,20,20"]) == 0
    assert int(capsys.readouterr().out) > 8 * 100**3


def test_preprocessing_methods():
    a = np.random.default_rng(1).random((8, 8, 8))
    options = {"gaussian": {"sigma": 1}, "difference_of_gaussian": {"low": 1, "high": 2}, "local_gaussian": {"balance": 0.1}, "edge_gaussian": {"method": "sobel", "sigma": 1}, "mipmap": {"level": 1}, "interpolate_box": {"shape": (4, 16, 8)}, "window": {"shape": (4, 12, 8)},
               "mean": {"width": 3}, "kaiser": {"width": 3}, "blob": {"width": 3}, "hamming": {"width": 3}, "bandpass": {"low": 4}, "ctf": {"defocus": 1e4, "rate": 4.0}, "wedge": {"start": 40, "stop": 40}, "resample": {"shape": (4, 4, 4)}}
    shapes = {"mipmap": (4, 4, 4), "interpolate_box": (4, 16, 8), "window": (4, 12, 8), "resample": (4, 4, 4)}
    for method in Pr.METHODS:
        out = Pr.apply_method(a, method, options.get(method, {}))
        assert out.shape == shapes.get(method, a.shape) and np.isfinite(out).all()
    with pytest.raises(NotImplementedError):
        Pr.apply_method(a, "none", {})
    for e in ("sobel", "prewitt", "laplace", "gaussian", "gaussian_laplace"):
        assert Pr.edges(np.ones((5, 5, 5)), e) == pytest.approx(0)
    with pytest.raises(ValueError):
        Pr.edges(a, "none")
    assert Pr.method_id("m", {"b": 1, "a": 2}) == Pr.method_id("m", {"a": 2, "b": 1}) != Pr.method_id("m", {"a": 2})
    assert json.loads(Pr.method_id("m", {}))[0] == "m"
    w = Pr.sinc_kaiser(1.0, 1e-3, 0.4)
    assert w.sum() == pytest.approx(1) and np.allclose(w, w[::-1])
    profile = Pr.atom_profile(2.0, (1.0, 0.5), (10.0, 2.0))
    assert profile(np.array([0.0]))[0] > profile(np.array([1.0]))[0] > 0 == profile(np.array([3.0]))[0]
    assert Pr.scattering(np.array([0.0]), (1.0, 0.5), (10.0, 2.0), True)[0] == 1.5
    assert len(Pr.fit_low_pass(np.exp(-np.linspace(0, 2, 40)))) == 4


def test_preprocess_blocks(spark):
    a = np.random.default_rng(1).random((8, 8, 8))
    blocks = spark.createDataFrame([("0", [0, 0, 0], [8, 8, 8], bytearray(a.tobytes()))], "block_id string, start array<int>, shape array<int>, data binary")
    row = Pr.preprocess_blocks(blocks, "mipmap", {"level": 1}).first()
    assert row.shape == [4, 4, 4] and np.allclose(np.frombuffer(row.data).reshape(4, 4, 4), Pr.mipmap(a, 1))
    with pytest.raises(NotImplementedError):
        Pr.preprocess_blocks(blocks, "none", {})
