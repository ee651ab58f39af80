"""Image files of all formats, artefacts, and the model inside batch and continuous scans."""

import dataclasses

import numpy as np
import pytest
from images import gradient, noise, photo
from pyspark.sql import functions as F

from grainscope.operators import detector as D
from grainscope.operators import learn as L
from grainscope.operators.corpus import MissingColumns
from grainscope.operators.features import full_features
from grainscope.schemas import ALL_FEATURES, BASE, KEY
from grainscope.sources import encode as EN
from grainscope.sources import images as I
from grainscope.sources import models as M
from grainscope.streaming import scan as W

GRAY = photo(20, 31).astype(np.uint8)
RGB = np.random.default_rng(2).integers(0, 256, (6, 5, 3)).astype(np.uint8)


@pytest.fixture
def drop(tmp_path):
    """One file of each format and spelling, colour ones, and damaged ones."""
    folder = tmp_path / "drop"
    folder.mkdir()
    for name, encoder in EN.ENCODERS.items():
        (folder / f"g.{name}").write_bytes(encoder(GRAY))
        (folder / f"bad_{name}.{name}").write_bytes(encoder(GRAY)[:10])
    for name in ("png", "bmp", "tif", "tiff"):
        (folder / f"rgb_{name}.{name.upper()}").write_bytes(EN.ENCODERS[name](RGB))
    (folder / "no.txt").write_text("no image")
    return folder


def name_of(path):
    return path.rsplit("/", 1)[1]


def test_all_formats_decode_exactly(spark, drop):
    good, bad = I.quarantine(I.decode_folder(spark, str(drop)))
    got = {name_of(r.path): np.array(r.px).reshape(r.height, r.width) for r in good.collect()}
    red, green, blue = RGB.astype(int).transpose(2, 0, 1)
    luma = (19595 * red + 38470 * green + 7471 * blue + 32768) >> 16
    assert len(got) == 11 and len(set(got)) == 11
    for name, image in got.items():
        want = luma if name.startswith("rgb") else np.kron(GRAY, np.ones((8, 8), int)) if name[-3:] in ("jpg", "peg") else GRAY
        assert (image == want).all(), name
    assert {name_of(r.path) for r in bad.collect()} == {f"bad_{n}.{n}" for n in EN.ENCODERS}


def test_jpeg_of_any_values(spark, tmp_path):
    """Runs of code bytes 0xFF, both ends of the scale, and one block."""
    rng = np.random.default_rng(5)
    images = {"a": rng.choice([0, 255], (9, 7)), "b": rng.integers(0, 256, (40, 33)), "c": np.array([[200]]), "d": np.full((4, 4), 128)}
    for name, v in images.items():
        (tmp_path / f"{name}.jpg").write_bytes(EN.flat_jpeg(v.astype(np.uint8)))
    for r in I.decode_folder(spark, str(tmp_path)).collect():
        assert (np.array(r.px).reshape(r.height, r.width) == np.kron(images[name_of(r.path)[0]], np.ones((8, 8), int))).all()


def test_files_written_by_tasks(spark, raster, tmp_path):
    r = raster({"p": photo(20, 30), "q": noise(9, 8)}).withColumn("name", F.concat(F.lit("x"), "photo_id", F.lit(".png")))
    folder = str(tmp_path / "out")
    for _ in range(2):      # again: files are replaced
        assert EN.write_files(EN.encode_images(r), folder).agg(F.sum("bytes")).first()[0] > 0
    got = {name_of(x.path): x.px for x in I.decode_folder(spark, folder).collect()}
    assert got == {"x0.png": photo(20, 30).ravel().tolist(), "x1.png": noise(9, 8).ravel().tolist()}


@pytest.fixture(scope="module")
def trained(spark):
    """A model over all 143 columns of plain and noisy images."""
    from grainscope.schemas import RASTER

    images = [photo(64, 64, s) for s in range(6)] + [photo(64, 64, s) ^ (noise(64, 64, s) & 1) for s in range(6)]
    rows = [("t", i, "clean", 64, 64, a.ravel().tolist()) for i, a in enumerate(images)]
    rasters = spark.createDataFrame(rows, RASTER)
    table = full_features(rasters).withColumn("label", (F.col("photo_id") >= 6).cast("int")).cache()
    model = L.pipeline("LR", ALL_FEATURES, 12).fit(table)
    bounds = {r["feature"]: (r["lo"], r["hi"]) for r in L.training_bounds(table, ALL_FEATURES).collect()}
    return rasters, table, M.Artefact("LR", model, tuple(ALL_FEATURES), 0.6, 0.8, bounds, {"rows": 12})


def test_artefact_loads_as_stored(spark, trained, tmp_path):
    _, table, artefact = trained
    mark = M.save_artefact(spark, artefact, str(tmp_path / "m"))
    back = M.load_artefact(spark, str(tmp_path / "m"))
    assert back.status == "ok" and back.available and back.fingerprint == mark
    assert (back.features, back.threshold, back.threshold_low_fp, back.provenance) == (artefact.features, 0.6, 0.8, {"rows": 12})
    a, b = ({r.photo_id: r.ml.probability for r in D.model_block(table, x).collect()} for x in (artefact, back))
    assert a == b and len(a) == 12


@pytest.mark.parametrize(("change", "why"), [
    ({"features": tuple(BASE)}, "fingerprint"), ({"threshold": float("nan")}, "threshold"), ({"threshold_low_fp": 1.5}, "threshold_low_fp")])
def test_artefact_that_does_not_fit_is_refused(spark, trained, tmp_path, change, why):
    _, table, artefact = trained
    path = str(tmp_path / "m")
    if "features" in change:        # the list is changed behind the model's back
        M.save_artefact(spark, artefact, path)
        import json
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0]) | {"features": list(change["features"])}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    else:
        M.save_artefact(spark, dataclasses.replace(artefact, **change), path)
    back = M.load_artefact(spark, path)
    assert not back.available and back.status.startswith("refused") and why in back.status
    rows = D.model_block(table, back).collect()
    assert len(rows) == 12 and all(r.ml.probability is None and r.ml.error == back.status for r in rows)
    listed = M.registry_table(spark, [artefact, back]).collect()
    assert [r.status == "ok" for r in listed] == [True, False]


def test_absent_artefact_and_missing_columns(spark, trained, tmp_path):
    _, table, artefact = trained
    absent = M.load_artefact(spark, str(tmp_path / "nothing"))
    assert not absent.available and absent.name == "nothing"
    with pytest.raises(MissingColumns):
        D.model_block(table.drop("Rm"), artefact)


def test_sensitivity_and_clipping(trained):
    _, table, artefact = trained
    for sensitivity, threshold in (("strict", 0.8), ("balanced", 0.6), ("loose", 0.45)):
        for r in D.model_block(table, artefact, sensitivity).collect():
            assert r.ml.threshold == pytest.approx(threshold)
            assert r.ml.verdict == ("stego" if r.ml.probability >= threshold else "clean" if r.ml.probability < .9 * threshold else "unclear")
    narrow = dataclasses.replace(artefact, bounds={f: (0.0, 0.0) for f in ALL_FEATURES})
    assert len({r.ml.probability for r in D.model_block(table, narrow, clip_outliers=True).collect()}) == 1


def test_scan_has_one_row_per_image_and_no_exchange(trained):
    rasters, table, artefact = trained
    scan = D.model_scan(rasters, artefact, side=64)
    want = {r.photo_id: r.ml.probability for r in D.model_block(table, artefact).collect()}
    rules = {r.photo_id: r.stego_probability for r in D.blind_scan(rasters).collect()}
    got = scan.collect()
    assert {r.photo_id: r.ml.probability for r in got} == pytest.approx(want)
    assert {r.photo_id: r.stego_probability for r in got} == pytest.approx(rules)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")


def test_stream_of_all_formats_equals_batch(spark, drop, trained, tmp_path):
    *_, artefact = trained
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def watch():
        W.watch_folder(spark, str(drop), out, check, artefact=artefact, side=64).awaitTermination()

    watch()
    (drop / "late.png").write_bytes(EN.png(gradient(40, 40).astype(np.uint8)))
    watch()
    good, bad = I.quarantine(I.decode_folder(spark, str(drop)))
    want = {r.path: (r.stego_probability, r.ml.probability, r.image_sha256) for r in W.scan_files(good, artefact=artefact, side=64).collect()}
    got = {r.path: (r.stego_probability, r.ml.probability, r.image_sha256) for r in W.read_verdicts(spark, out).collect()}
    assert got == want and len(got) == 12
    assert {r.path for r in spark.read.parquet(f"{out}/rejects").collect()} == {r.path for r in bad.collect()}


def test_curve_with_and_without_model(spark, trained):
    rasters, _, artefact = trained
    grid = spark.createDataFrame([("c0", "nsF5", 3, 0.0), ("c1", "nsF5", 3, 0.4)], "variant string, method string, p int, density double")
    with_model = D.payload_curve(rasters, grid, artefact=artefact, side=64).collect()
    assert len(with_model) == 24 and all(0 <= r.ml_probability <= 1 for r in with_model)
    assert all(r.ml_probability is None for r in D.payload_curve(rasters, grid).collect())
    assert set(KEY[:2]) < set(D.payload_curve(rasters, grid).columns)
