import brute
import numpy as np
import pytest
from images import checkerboard, gradient, noise, photo
from pyspark.sql import functions as F

from grainscope.functions.special import chi_square_tail
from grainscope.operators import features as FX
from grainscope.operators import residuals as R
from grainscope.operators.stats import arrow_stats, cells, native_stats
from grainscope.schemas import ALL_FEATURES, BASE, FEATURE_SETS, KEY
from grainscope.sources import rasters as S

IMAGES = {"photo": photo(24, 20), "noise": noise(16, 16), "odd": photo(13, 7), "board": checkerboard(12, 12),
          "black": np.zeros((10, 10), int), "line": noise(1, 9), "column": noise(9, 1), "tiny": noise(1, 3)}


def table(df):
    return {(r.photo_id, r.kind, r.k, r.bin): r.cnt for r in df.collect()}


def test_both_producers_match_plain_loops(raster):
    r = raster(IMAGES)
    want = {(i, *key): n for i, a in enumerate(IMAGES.values()) for key, n in brute.stats(a).items()}
    assert table(native_stats(r)) == want
    assert table(arrow_stats(r)) == want


@pytest.mark.parametrize("limit", [1, 40, 100])
def test_bands_add_up(raster, limit):
    """Cutting images into bands changes no count."""
    r = raster(IMAGES)
    whole = table(native_stats(r))
    banded = S.bands(r, max_pixels=limit)
    assert banded.count() >= r.count()
    counted = cells(banded).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("s")).collect()
    sizes = [a.size for a in IMAGES.values()]
    assert all(c.n == sizes[c.photo_id] and c.s == c.n * (c.n - 1) // 2 for c in counted)
    from grainscope.operators import stats as M

    original, M.bands = M.bands, lambda rasters, max_pixels=limit, halo=0: S.bands(rasters, limit, halo)
    try:
        assert table(native_stats(r)) == whole
        assert table(arrow_stats(r)) == whole
    finally:
        M.bands = original


def rounded(df):
    """Rows with floats to nine places: sums of fractions depend on their order in the last bit."""
    def fix(v):
        return [fix(x) for x in v] if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v

    return sorted([fix(v) for v in r] for r in df.collect())


def test_partitioning_does_not_matter(raster):
    r = raster(IMAGES)
    assert rounded(FX.base_features(r)) == rounded(
        FX.base_features(r.repartition(7).orderBy(F.desc("photo_id")), "native"))


def test_residual_sums_match_plain_loops(raster):
    images = {"photo": photo(11, 9), "noise": noise(8, 6), "small": noise(2, 3)}
    r = raster(images)
    taps = R.kernel_taps()
    assert [len(t) for t in taps] == [2] * 8 + [3] * 4 + [4] * 8 + [6] * 4 + [15] * 4 + [9, 25]
    assert all(sum(t.values()) == 0 for t in taps)
    want = {(i, c): s for i, a in enumerate(images.values())
            for c, s in enumerate(brute.residuals(a, taps, R.DIVISORS))}
    for got in (R.residual_sums(r), R.native_residual_sums(r, list(range(30)))):
        assert {(x.photo_id, x.c): (x.s1, x.sa, x.s2) for x in got.collect()} == want


def test_chi_tail_against_integration():
    for x, df in [(0.3, 1), (2.0, 1), (5.0, 2), (40.0, 37), (130.0, 127), (90.0, 126), (300.0, 250)]:
        assert chi_square_tail(np.array([x]), np.array([df]))[0] == pytest.approx(brute.chi_tail(x, df), abs=1e-9)
    assert chi_square_tail(np.array([0.0, 1e6]), np.array([5, 5])).tolist() == [1.0, 0.0]


def test_degenerate_pairs_keep_their_two_meanings(raster):
    """One value pair: p = 1 in the whole-image columns, 0 in the prefix columns."""
    row = FX.interpretable_features(raster({"black": np.zeros((64, 64), int)})).first()
    assert row.chi2_pvalue == 1.0 and row.median_prefix_p == 1.0 and row.prefix_p20 == 0.0
    assert row.diff_entropy == 0.0 and row.RS_Gr == 1.0 and row.texture_noise == 0.0
    tiny = FX.interpretable_features(raster({"tiny": noise(3, 3)})).first()
    assert tiny.prefix_p1 == 1.0 and tiny.lsb_prefix_p20 == 1.0


def test_feature_names_and_sets(raster):
    assert (len(BASE), len(ALL_FEATURES), len(set(ALL_FEATURES))) == (11, 143, 143)
    assert [len(FEATURE_SETS[s]) for s in ("11d", "31d", "51d", "53d", "143d")] == [11, 31, 51, 53, 143]
    f = FX.full_features(raster({"g": gradient(64, 64), "p": photo(64, 64)}))
    assert f.columns == [*KEY, *ALL_FEATURES]
    native = FX.full_features(raster({"g": gradient(64, 64), "p": photo(64, 64)}), "native")
    assert rounded(f) == rounded(native)


def test_feature_plan_moves_pixels_nowhere(spark, raster):
    """The 143 columns need no exchange: pixels are reduced within their row."""
    plan = FX.full_features(raster({"p": photo()}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 0


def test_bytes_round_trip(raster):
    r = raster(IMAGES)
    back = S.pixels_from_bytes(S.bytes_from_pixels(r)).select(*r.columns)
    assert sorted(back.collect()) == sorted(r.collect())
    h = r.select("photo_id", S.content_hash().alias("a")).join(
        S.bytes_from_pixels(r).select("photo_id", F.sha2("content", 256).alias("b")), "photo_id")
    assert all(x.a == x.b for x in h.collect())


@pytest.mark.parametrize("band", [64, 200, 1000])
def test_banded_features_equal_whole_ones(raster, band):
    """All 143 columns of images cut into bands with two rows of neighbours, short last rows and narrow images included."""
    from grainscope.operators.features import full_features
    from grainscope.schemas import ALL_FEATURES, RASTER

    images = {"p": photo(40, 33), "n": noise(50, 7), "one": noise(3, 64), "thin": noise(90, 2)}
    r = raster(images)
    spark = r.sparkSession
    ragged = spark.createDataFrame([("t", 9, "clean", 5, 20, noise(5, 20).ravel().tolist()[:87])], RASTER)
    every = r.unionByName(ragged)
    whole, cut = ({x.photo_id: [x[c] for c in ALL_FEATURES] for x in full_features(every, producer, **options).collect()}
                  for producer, options in (("arrow", {}), ("banded", {"band": band})))
    assert whole.keys() == cut.keys() and len(whole) == 5
    for k in whole:
        assert cut[k] == pytest.approx(whole[k], abs=1e-9), k
