import numpy as np
import pytest
from images import noise, photo
from pyspark.sql import functions as F

from grainscope.operators import variants as V
from grainscope.operators.geometry import crops, jpeg_round_trip, lanczos_weights, resize
from grainscope.schemas import variant_table


def test_presets(spark):
    assert [variant_table(spark, p).count() for p in ("default", "minimal", "all")] == [8, 6, 12]


def test_every_variant_reads_back(spark, raster):
    r = raster({"p": photo(96, 80), "n": noise(64, 64)})
    rows = V.round_trip(V.coded_pairs(r, variant_table(spark, "all"))).collect()
    assert len(rows) == 24 and all(x.text_ok for x in rows)
    assert all(x.hash_ok for x in rows if x.method != "lsb")


def test_both_producers_give_the_same_pixels(spark, raster):
    rng = np.random.default_rng(7)
    grey = np.where(rng.random((64, 64)) < 0.6, 128 + rng.integers(-1, 2, (64, 64)), rng.integers(0, 256, (64, 64)))
    r = raster({"p": photo(96, 80), "g": grey})
    extra = spark.createDataFrame([(f"w{p}", "nsF5", p, 0.5) for p in (1, 4, 5)], variant_table(spark).schema)
    v = variant_table(spark, "all").unionByName(extra)
    a, b = (V.coded_pairs(r, v, "pw", producer=p).select("photo_id", "to_variant", "coded").collect() for p in ("arrow", "native"))
    assert len(a) == 30 and sorted(a) == sorted(b)
    assert all(x.text_ok for x in V.round_trip(V.coded_pairs(r, v, "pw"), "pw", "native").collect())


def test_own_message_password_and_wrong_password(spark, raster):
    r = raster({"p": photo(96, 80)})
    v = variant_table(spark, "all").where("variant in ('v1', 'v5')")
    pairs = V.coded_pairs(r, v, password="k", message=F.lit("naïve café ✓"))
    assert all(x.found_text == "naïve café ✓" for x in V.extract_text(pairs, "k").collect())
    assert all(x.found_text != "naïve café ✓" for x in V.extract_text(pairs, "other").collect())


def test_wet_cells_are_kept_when_a_dry_solution_exists(spark, raster):
    """Near-middle pixels stay, in all code parameters and with few dry cells left."""
    rng = np.random.default_rng(5)
    a = np.where(rng.random((96, 96)) < 0.7, 128 + rng.integers(-1, 2, (96, 96)), rng.integers(0, 256, (96, 96)))
    rows = [(f"w{p}", "nsF5", p, 0.6) for p in range(1, 6)]
    pairs = V.coded_pairs(raster({"a": a}), spark.createDataFrame(rows, "variant string, method string, p int, density double"))
    got = pairs.withColumn("big", F.expr("exists(zip_with(px, coded, (a, b) -> abs(a - b) > 1), x -> x)")).collect()
    assert len(got) == 5 and not any(x.big for x in got)
    assert all(x.text_ok for x in V.round_trip(pairs).collect())
    wet = pairs.select("p", F.expr("aggregate(zip_with(px, coded, (a, b) -> if(abs(a - 128) <= 1 and a <> b, 1, 0)), 0, (s, x) -> s + x)").alias("w"),
                       F.expr("aggregate(zip_with(px, coded, (a, b) -> if(a <> b, 1, 0)), 0, (s, x) -> s + x)").alias("c"))
    share = {x.p: x.w / x.c for x in wet.collect()}
    assert share[5] < 0.05 and share[5] < share[2] <= share[1]


def test_small_images_are_reported_not_dropped(spark, raster):
    r = raster({"s": noise(8, 8)})
    bad = V.rejected_pairs(r, variant_table(spark)).collect()
    assert len(bad) == 7 and {x.status for x in bad} == {"image too small"}
    assert V.labelled_corpus(r, variant_table(spark)).count() == 1 + 1


def test_corpus_counts_and_labels(spark, raster):
    c = V.labelled_corpus(raster({"p": photo(), "q": photo(seed=3)}), variant_table(spark)).cache()
    assert c.where("label = 0").count() == 2 and c.where("label = 1").count() == 16
    assert c.where("label = 0 and (method is not null or density is not null)").isEmpty()
    assert c.where("label = 1 and not (changed_frac > 0)").isEmpty()


def test_changed_bits_per_block(spark, raster):
    """A matrix code changes at most one pixel per block."""
    pairs = V.coded_pairs(raster({"p": photo(128, 128)}), variant_table(spark).where("variant = 'v5'"))
    x = pairs.select(V.changed_pixels().alias("c"), "body_blocks", F.expr("head_px div code_n").alias("h")).first()
    assert 0 < x.c <= x.body_blocks + x.h


def test_resize_and_jpeg(raster):
    assert np.allclose(lanczos_weights(64, 512).sum(1), 1) and np.allclose(lanczos_weights(300, 100).sum(1), 1)
    flat = resize(raster({"f": np.full((30, 40), 77)}), 64).first()
    assert (flat.height, flat.width, set(flat.px)) == (64, 64, {77})
    same = resize(raster({"p": photo(64, 64)}), 64).first()
    assert same.px == photo(64, 64).ravel().tolist()
    j = jpeg_round_trip(raster({"p": photo(61, 50)})).first()
    delta = np.abs(np.array(j.px) - photo(61, 50).ravel())
    assert j.variant == "clean_jpeg" and j.photo_id == 0 and 0 < delta.max() < 20


def test_crops(raster):
    a = photo(20, 30)
    got = {(x.y0, x.x0): np.array(x.px).reshape(x.height, x.width) for x in crops(raster({"a": a}), 16).collect()}
    assert set(got) == {(0, 0), (0, 14), (4, 0), (4, 14), (2, 7)}
    assert all((v == a[y:y + 16, x:x + 16]).all() for (y, x), v in got.items())
    assert crops(raster({"a": photo(16, 16)}), 16).count() == 1


def test_elimination_finds_the_smallest_mask():
    """Against trying all combinations, and exact for up to 255 columns."""
    from grainscope.operators.coding import solve_blocks

    rng = np.random.default_rng(3)
    for p in (1, 2, 3, 4):
        n = (1 << p) - 1
        dry = rng.random((60, n)) < 0.5
        target = rng.integers(1, n + 1, 60)
        picked, solved = solve_blocks(dry, target)
        for row, t, got, ok in zip(dry, target, picked, solved):
            masks = [m for m in range(1, 1 << n) if all(row[j] for j in range(n) if m >> j & 1)
                     and np.bitwise_xor.reduce([j + 1 for j in range(n) if m >> j & 1]) == t]
            assert ok == bool(masks) and (sum(1 << j for j in np.flatnonzero(got)) == (min(masks) if masks else 0))
    dry = rng.random((300, 255)) < 0.03
    target = rng.integers(1, 256, 300)
    picked, solved = solve_blocks(dry, target)
    assert solved.any() and not (picked & ~dry).any()
    for got, t in zip(picked[solved], target[solved]):
        assert np.bitwise_xor.reduce(np.flatnonzero(got) + 1) == t


@pytest.mark.parametrize("method", ["matrix", "nsF5"])
def test_all_code_sizes_read_back(spark, raster, method):
    rng = np.random.default_rng(8)
    grey = np.where(rng.random((160, 160)) < 0.9, 128 + rng.integers(-1, 2, (160, 160)), rng.integers(0, 256, (160, 160)))
    v = spark.createDataFrame([(f"v{p}", method, p, 0.4) for p in range(1, 9)], variant_table(spark).schema)
    pairs = V.coded_pairs(raster({"p": photo(160, 160), "g": grey}), v)
    rows = V.round_trip(pairs).collect()
    assert len(rows) == 16 and all(x.text_ok and x.hash_ok for x in rows)
    alpha = {x.p: x.measured_alpha for x in V.measured_efficiency(pairs.where("photo_id = 0")).collect()}
    assert alpha[8] > alpha[4] > alpha[1] > 1.5


def test_one_call_per_cover_keeps_rejects_out(spark, raster):
    """Covers of all sizes and all variants; those that do not fit are the ones that ``rejected_pairs`` reports."""
    r = raster({"s": noise(8, 8), "m": noise(30, 20), "p": photo(64, 64)})
    v = variant_table(spark, "all")
    pairs = V.coded_pairs(r, v)
    bad = {(x.photo_id, x.variant) for x in V.rejected_pairs(r, v).collect()}
    good = {(x.photo_id, x.to_variant) for x in pairs.collect()}
    assert not good & bad and len(good) + len(bad) == 36 and bad
    sizes = {(x.photo_id, x.to_variant): (x.msg_bytes, x.head_px, x.body_blocks) for x in V.expand(r, v).where("status = 'ok'").collect()}
    assert {(x.photo_id, x.to_variant): (x.msg_bytes, x.head_px, x.body_blocks) for x in pairs.collect()} == sizes
    assert V.coded_pairs(r, v.where("false")).count() == 0


def test_replay_finds_what_was_falsified(spark, raster):
    from grainscope.operators.results import replay_checks

    covers = raster({"p": photo(96, 80), "n": noise(64, 64)})
    v = variant_table(spark, "all")
    pairs = V.coded_pairs(covers, v, password="k")
    records = pairs.select(F.concat_ws(":", "photo_id", "to_variant").alias("record_id"), "source", "photo_id", "method", "p", "message", "cover_sha256",
                           F.sha2("message", 256).alias("message_sha256"), V.changed_pixels().alias("changed_cells"),
                           V.content_hash("coded").alias("stego_sha256")).cache()
    now = V.replay_records(records, covers, "k")
    assert replay_checks(records, now, ["record_id"]).where("not ok").isEmpty()
    for column, value in (("cover_sha256", F.lit("x")), ("message_sha256", F.lit("x")), ("changed_cells", F.col("changed_cells") + 1), ("stego_sha256", F.lit("x"))):
        got = replay_checks(records.withColumn(column, value), now, ["record_id"]).where("not ok").select("check").distinct().collect()
        assert [r.check for r in got] == [column]
    other = replay_checks(records, V.replay_records(records, covers, "another password"), ["record_id"]).where("not ok")
    assert {r.check for r in other.where("record_id not like '%:v7' and record_id not like '%:v10' and record_id not like '%:v11'").collect()} >= {"stego_sha256"}
    absent = replay_checks(records, V.replay_records(records, covers.where("photo_id = 0"), "k"), ["record_id"])
    assert absent.where("not all_ok").select("record_id").distinct().count() == 12
