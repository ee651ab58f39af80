import struct
import zlib

import numpy as np
import pytest
from images import gradient, noise, photo
from pyspark.sql import functions as F

from grainscope.operators import corpus as C
from grainscope.operators import detector as D
from grainscope.operators import evaluate as E
from grainscope.operators import learn as L
from grainscope.operators.features import base_features
from grainscope.operators.variants import coded_pairs
from grainscope.schemas import variant_table
from grainscope.sources import images as I
from grainscope.sources import stores as ST
from grainscope.streaming import scan as W


def pgm(a):
    return f"P5\n# made by a test\n{a.shape[1]} {a.shape[0]}\n255\n".encode() + a.astype(np.uint8).tobytes()


def png(a):
    """Minimal PNG writer; 2-D arrays are gray, 3-D ones RGB."""
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    colour = 2 if a.ndim == 3 else 0
    lines = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in a)
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.PGM").write_bytes(pgm(photo(20, 30)))
    (tmp_path / "deep" / "b.pgm").write_bytes(pgm(noise(8, 8)))
    (tmp_path / "c.png").write_bytes(png(gradient(16, 12)))
    (tmp_path / "d.png").write_bytes(png(np.random.default_rng(2).integers(0, 256, (6, 5, 3))))
    (tmp_path / "bad.png").write_bytes(b"not an image")
    (tmp_path / "short.pgm").write_bytes(pgm(noise(8, 8))[:40])
    (tmp_path / "notes.txt").write_text("no image")
    return tmp_path


def test_scan_lists_images_only(spark, folder):
    names = {r.path.rsplit("/", 1)[1] for r in I.list_images(spark, str(folder)).collect()}
    assert names == {"a.PGM", "b.pgm", "c.png", "d.png", "bad.png", "short.pgm"}
    assert I.list_images(spark, str(folder), recursive=False).count() == 5
    assert I.list_images(spark, str(folder), limit=2).count() == 2


def test_missing_source_is_reported(spark, folder):
    found, report = I.scan_sources(spark, {"here": str(folder), "gone": str(folder / "nothing")}, {"here": 3})
    assert found.count() == 3
    assert {(r.source, r.n_images, r.status) for r in report.collect()} == {("here", 3, "ok"), ("gone", 0, "missing")}


def test_decode_and_quarantine(spark, folder):
    good, bad = I.quarantine(I.decode_folder(spark, str(folder)))
    assert {r.path.rsplit("/", 1)[1] for r in bad.collect()} == {"bad.png", "short.pgm"}
    r = {x.path.rsplit("/", 1)[1]: x for x in I.as_rasters(good).collect()}
    assert r["a.PGM"].px == photo(20, 30).ravel().tolist() and r["c.png"].px == gradient(16, 12).ravel().tolist()
    assert len({x.photo_id for x in r.values()}) == 4
    rgb = np.random.default_rng(2).integers(0, 256, (6, 5, 3))
    luma = np.round(rgb @ [0.299, 0.587, 0.114])
    assert np.abs(np.array(r["d.png"].px).reshape(6, 5) - luma).max() <= 1


def test_pgm_written_by_spark_reads_back(spark, raster):
    r = raster({"p": photo(20, 30)})
    files = r.select("source", F.lit("x").alias("path"), I.pgm_content().alias("content"))
    assert I.decode_pgm(files).first().px == photo(20, 30).ravel().tolist()


def test_stream_equals_batch(spark, tmp_path, folder):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    W.watch_folder(spark, str(folder), out, check).awaitTermination()
    (folder / "late.pgm").write_bytes(pgm(photo(40, 40, seed=9)))
    W.watch_folder(spark, str(folder), out, check).awaitTermination()
    got = {r.path.rsplit("/", 1)[1]: r.stego_probability for r in W.read_verdicts(spark, out).collect()}
    assert set(got) == {"a.PGM", "b.pgm", "late.pgm", "c.png", "d.png"}
    good, _ = I.quarantine(I.decode_folder(spark, str(folder)))
    batch = D.blind_scan(I.as_rasters(good)).join(I.as_rasters(good).select("photo_id", "path"), "photo_id")
    want = {r.path.rsplit("/", 1)[1]: r.stego_probability for r in batch.collect()}
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    assert spark.read.parquet(f"{out}/rejects").count() == 2


def test_detector_on_clean_classes(raster):
    classes = {"gradient": gradient(), "noise": noise(128, 128), "photo": photo(256, 256), "flat": np.kron(noise(8, 8), np.ones((32, 32), int))}
    got = D.with_verdict(D.with_signals(base_features(raster(classes)))).collect()
    assert all(r.stego_probability < 0.65 for r in got)


def test_detector_tells_coded_from_clean(spark, raster):
    cover = raster({"g": gradient()})
    full = spark.createDataFrame([("x", "lsb", 0, 0.99)], "variant string, method string, p int, density double")
    coded = coded_pairs(cover, full).select("source", "photo_id", F.lit("x").alias("variant"), "height", "width", F.col("coded").alias("px"))
    got = {r.variant: r for r in D.with_signals(base_features(cover.unionByName(coded))).collect()}
    assert got["x"].RS_Gn < got["clean"].RS_Gn and got["x"].s_rs > got["clean"].s_rs


def test_store_refuses_wrong_sizes(spark, raster, tmp_path):
    path = str(tmp_path / "store")
    ST.write_rasters(raster({"p": photo(20, 30)}), path)
    assert ST.read_rasters(spark, path).first().px == photo(20, 30).ravel().tolist()
    ST.write_rasters(raster({"p": photo(20, 30)}).withColumn("height", F.lit(7)), path)
    with pytest.raises(Exception, match="pixel count"):
        ST.read_rasters(spark, path).collect()


def test_detection_sink_appends(spark, tmp_path):
    df = spark.createDataFrame([(None, 0.9), ("lsb", 0.2)], "method string, prob double")
    for _ in range(2):
        ST.append_metrics(E.detection_rates(df, ["method"], "prob", F.lit(0.5)), str(tmp_path / "m"), "test")
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.count() == 4 and back.where("method is null").count() == 2


def test_models_never_see_their_photo_and_artefacts_load(spark, tmp_path):
    df = spark.range(240).select(
        F.lit("s").alias("source"), F.expr("id div 4").alias("photo_id"), F.concat(F.lit("v"), F.col("id") % 4).alias("variant"),
        (F.col("id") % 2).cast("int").alias("label"), ((F.col("id") % 2) + F.sin("id")).alias("x"), F.cos("id").alias("y"))
    oof = L.out_of_fold(df, ["x", "y"], ["LR"], 3, override={"LR": {"maxIter": 20}})
    assert oof.count() == 240 and oof.groupBy("photo_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    assert L.candidate_aucs(oof).first().auc > 0.7
    model = L.pipeline("GB", ["x", "y"], 240, maxIter=3).fit(df)
    ST.save_model(model, str(tmp_path / "m"), {"threshold": 0.4})
    loaded, meta = ST.load_model(spark, str(tmp_path / "m"))
    assert meta == {"threshold": 0.4, "status": "ok"}
    a, b = (L.scored(m, df).orderBy("photo_id", "variant").select("prob").collect() for m in (model, loaded))
    assert a == b
    nothing, why = ST.load_model(spark, str(tmp_path / "absent"))
    assert nothing is None and why["status"] != "ok"
    one_pass = L.score_batch(df, {"gb": (model, 0.4)}, L.training_bounds(df, ["x", "y"], 0.5))
    assert one_pass.count() == 480 and one_pass.where("clip").count() == 240


def test_split_registry_has_one_winner(spark, tmp_path):
    """Writers that start together all get the same rows, and other splits are left alone."""
    path = str(tmp_path / "splits")
    splits = [spark.range(20).selectExpr("'s' as source", "id as photo_id", f"if(id % {k} = 0, 'validation', 'training') as side") for k in (2, 3, 4, 5)]
    got = L.fit_all([lambda s=s: sorted(map(tuple, ST.register_split(s, path, "a b", 1).collect())) for s in splits])
    assert all(g == got[0] for g in got) and len(got[0]) == 20
    assert [sorted((r.source, r.photo_id, r.side) for r in s.collect()) for s in splits].count([g[2:] for g in got[0]]) == 1
    other = ST.register_split(splits[1], path, "c/d", 1)
    assert other.count() == 20 and {(r.corpus, r.seed) for r in ST.read_splits(spark, path).select("corpus", "seed").distinct().collect()} == {("a b", 1), ("c/d", 1)}


def test_record_lines(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"schema": "s", "algorithm": {"method": "lsb", "hamming_p": 0}}\n{"schema": "s", "alg\nnot json\n')
    records, broken = ST.read_record_lines(spark, str(tmp_path / "r.json"))
    assert [r.algorithm.method for r in records.collect()] == ["lsb"]
    assert {r.line for r in broken.collect()} == {'{"schema": "s", "alg', "not json"}
