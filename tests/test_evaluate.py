import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from grainscope.functions.columns import wilson
from grainscope.functions.ordering import ranked, running_totals, with_order_bucket
from grainscope.operators import corpus as C
from grainscope.operators import evaluate as E
from grainscope.operators import results as R


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(4)
    rows = [("m%d" % (i % 2), f"s{i % 5}", i // 4, round(rng.random() + 0.2 * (i % 3 == 0), 2), int(i % 3 == 0))
            for i in range(600)]
    return rows, spark.createDataFrame(rows, "model string, source string, photo_id long, score double, label int").cache()


def test_auc_matches_all_pairs(scores):
    rows, df = scores
    got = {r.model: r.auc for r in E.auc(df, ["model"]).collect()}
    for m in ("m0", "m1"):
        assert got[m] == pytest.approx(brute.auc([(r[3], r[4]) for r in rows if r[0] == m]), abs=1e-12)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")
    assert E.auc(df).first().auc is None
    t = E.thresholds(df.where("false")).first()
    assert (t.youden, t.low_fp) == (0.5, 0.5)


def test_thresholds_match_enumeration(scores):
    rows, df = scores
    for r in E.thresholds(df, ["model"]).collect():
        mine = [(x[3], x[4]) for x in rows if x[0] == r.model]
        pos, neg = sum(y for _, y in mine), sum(1 - y for _, y in mine)

        def rates(t):
            return (sum(s >= t and y == 1 for s, y in mine) / pos, sum(s >= t and y == 0 for s, y in mine) / neg)

        cand = sorted({s for s, _ in mine})
        best = max(cand, key=lambda t: (round(rates(t)[0] - rates(t)[1], 12), t))
        assert r.youden == best
        assert r.low_fp == min(t for t in cand if rates(t)[1] <= 0.10 and rates(t)[0] > 0)


def test_running_totals_with_hot_group_and_any_bucketing(spark):
    """A third of the rows in one group; few or many buckets give the same ranks."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
                                  F.md5(F.col("id").cast("string")).alias("o"))
    want = None
    for buckets in (1, 3, 64):
        got = sorted(tuple(r) for r in running_totals(df, "o", {"n": F.lit(1).cast("long")}, ["g"], buckets=buckets).select("g", "o", "n").collect())
        want = want or got
        assert got == want
    hot = [n for g, o, n in want if g == "hot"]
    assert hot == list(range(1, 1001))
    down = ranked(df.where("g = 'hot'"), "o", descending=True).orderBy("rn").collect()
    assert [r.o for r in down] == sorted((o for g, o, n in want if g == "hot"), reverse=True)


def test_no_window_collects_a_whole_group(scores):
    """Plans contain a window per bucket, never one without a partition."""
    _, df = scores
    plan = E.roc(df, ["model"])._jdf.queryExecution().optimizedPlan()
    windows = [w for w in plan.toString().splitlines() if "Window [" in w]
    assert windows and all("_bucket" in w.split("], [")[1] or "_sum_" in w for w in windows), windows


def test_folds_of_unequal_photos_are_balanced(spark):
    sizes = [90, 40, 40, 30, 20, 20, 10, 5, 5, 5, 3, 2, 1, 1, 1, 1]
    rows = [(i,) for i, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame(rows, "photo_id long")
    folds = C.kfold(df, 3, ["photo_id"])
    assert folds.count() == len(sizes)
    counts = [r["count"] for r in df.join(folds, "photo_id").groupBy("fold").count().collect()]
    assert len(counts) == 3 and max(counts) - min(counts) <= 1
    plan = C.deal_sizes([(4, 5), (3, 2), (1, 3)], 2)
    assert [sum(p[1][-1:]) <= n for p, n in zip(plan, (5, 2, 3))] == [True] * 3


def test_values_that_many_groups_share_spread_over_buckets(spark):
    """A value counts once in the sample, however many groups hold it."""
    df = spark.range(500).selectExpr("id / 500.0D AS o").crossJoin(spark.range(200).select(F.col("id").alias("g")))
    used = with_order_bucket(df, "o", 64).groupBy("_bucket").count().collect()
    assert len(used) >= 32 and max(r["count"] for r in used) < 200 * 60


def test_validation_share_rounds_halves_to_even(spark):
    for n, want in ((10, 2), (14, 4), (6, 2), (8, 2)):
        side = C.holdout_split(spark.range(n).select(F.col("id").alias("photo_id")), 0.25, key=["photo_id"])
        assert side.where("side = 'validation'").count() == want


def test_wilson(spark):
    pairs = [(0, 10), (1, 10), (5, 10), (9, 10), (10, 10), (95, 1000), (0, 0)]
    df = spark.createDataFrame(pairs, "k long, n long")
    lo, hi = wilson(F.col("k"), F.col("n"))
    for r in df.select("k", "n", lo.alias("lo"), hi.alias("hi")).collect():
        if r.n == 0:
            assert r.lo is None and r.hi is None
        else:
            assert 0 <= r.lo <= r.k / r.n <= r.hi <= 1
            assert r.hi - r.lo < 0.65


def test_summary_sources_add_up_to_all(scores):
    _, df = scores
    rows = df.select("model", F.lit(False).alias("clip"), "source", F.col("score").alias("ml_prob"),
                     (F.col("score") > 0.5).cast("int").alias("pred_stego"))
    s = E.false_positive_summary(rows).collect()
    for m in ("m0", "m1"):
        parts = [r for r in s if r.model == m and r.source != "ALL"]
        total = next(r for r in s if r.model == m and r.source == "ALL")
        assert sum(r.n_photos for r in parts) == total.n_photos
        assert sum(r.n_false_positive for r in parts) == total.n_false_positive


def test_null_method_rows_stay_a_group(spark):
    df = spark.createDataFrame([(None, 0.9), (None, 0.1), ("lsb", 0.9)], "method string, prob double")
    got = {r.method: r.n_detected for r in E.detection_rates(df, ["method"], "prob", F.lit(0.5)).collect()}
    assert got == {None: 1, "lsb": 1}


def test_bootstrap_draws_are_a_resample(spark, scores):
    _, df = scores
    rows = E.multiplicities(spark, 150, 20).collect()
    times = np.array([r.times for r in sorted(rows, key=lambda r: r.slot)])
    assert times.shape == (150, 20) and (times.sum(axis=0) == 150).all() and len({tuple(c) for c in times.T}) == 20
    assert sorted(r.slot for r in E.numbered_photos(df, ["photo_id"]).collect()) == list(range(150))
    ci = E.bootstrap_auc_interval(df.where("model = 'm0'"), ["photo_id"], 100).first()
    mid = E.auc(df.where("model = 'm0'")).first().auc
    assert ci.auc_lo < mid < ci.auc_hi and ci.n_replicates == 100


def test_splits_keep_photos_together(scores):
    _, df = scores
    split = C.holdout_split(df, 0.25, key=["photo_id"])
    assert split.groupBy("side").count().where("side = 'validation'").first()["count"] == 38
    inside, outside = (f(df, split, "validation", ["photo_id"]) for f in (C.rows_in, C.rows_not_in))
    assert inside.count() + outside.count() == df.count()
    assert inside.select("photo_id").intersect(outside.select("photo_id")).isEmpty()
    sizes = [r["count"] for r in df.join(C.kfold(df, 5, ["photo_id"]), "photo_id").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 4


def test_broken_grouping_is_refused(spark):
    good = [("s", p, v) for p in (1, 2) for v in ("clean", "v0", "v1")]
    df = spark.createDataFrame(good, "source string, photo_id long, variant string")
    assert C.check_grouping(df) is df
    orphan = df.unionByName(spark.createDataFrame([("s", 101, "clean_jpeg"), ("s", 102, "clean_jpeg")], df.schema))
    assert {r.photo_id for r in C.grouping_violations(orphan).collect()} == {101, 102}
    with pytest.raises(C.BrokenCorpus):
        C.check_grouping(orphan)


def test_missing_and_infinite_features_are_refused(spark):
    df = spark.createDataFrame([(1.0, float("nan"))], "a double, b double")
    with pytest.raises(C.MissingColumns):
        C.require_features(df, ["a", "zz"])
    with pytest.raises(C.MissingColumns):
        C.concat_datasets(df, df.drop("b"))
    with pytest.raises(C.BrokenCorpus):
        C.assert_finite(df, ["a", "b"])
    assert C.assert_finite(df, ["a"]) is df


def test_unknown_corpus_is_refused(spark):
    row = spark.createDataFrame([("nowhere", "none", "m", "auc", 0.5)],
                                "corpus string, protocol_id string, model string, metric string, value double").withColumn("subject", F.lit("x"))
    with pytest.raises(Exception, match="unregistered corpus: nowhere"):
        R.canonical(row).collect()
    assert R.canonical(row, check=False).count() == 0 and [r.reason for r in R.unknown_keys(row).collect()] == ["corpus"]


def test_bootstrap_equals_a_plain_one(spark):
    """Vectors of multiplicities against resampled lists, with ties, several rows per photo and one-class replicates."""
    import hashlib
    import random

    rng = random.Random(3)
    rows = [(photo, rng.randrange(2), round(rng.random(), 1)) for photo in range(9) for _ in range(rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "photo_id long, label int, score double").repartition(3)
    order = sorted(range(9), key=lambda p: hashlib.md5(f"5:{p}".encode()).hexdigest())
    want = {}
    for b in range(40):
        drawn = [order[int(hashlib.md5(f"5:{b}:{d}".encode()).hexdigest()[:12], 16) % 9] for d in range(9)]
        sample = [(label, score) for p in drawn for q, label, score in rows if q == p]
        pos, neg = ([s for label, s in sample if label == k] for k in (1, 0))
        want[b] = sum((x > y) + (x == y) / 2 for x in pos for y in neg) / (len(pos) * len(neg)) if pos and neg else None
    got = {r.replicate: r.auc for r in E.bootstrap_aucs(df, ["photo_id"], 40, seed="5").collect()}
    assert got == pytest.approx(want)
    one = E.bootstrap_aucs(df.where("label = 1"), ["photo_id"], 5).collect()
    assert len(one) == 5 and all(r.auc is None for r in one)
    assert E.bootstrap_aucs(df.where("false"), ["photo_id"], 5).count() == 0


def test_bootstrap_in_small_blocks(spark, monkeypatch):
    """Blocks of slots, draws and scores change nothing."""
    df = spark.range(50).selectExpr("id as photo_id", "cast(id % 2 as int) as label", "round(sin(id), 1) as score")
    whole = {r.replicate: r.auc for r in E.bootstrap_aucs(df, ["photo_id"], 20).collect()}
    for name, n in (("SLOTS", 7), ("DRAWS", 3), ("SCORES", 2)):
        monkeypatch.setattr(E, name, n)
    assert {r.replicate: r.auc for r in E.bootstrap_aucs(df, ["photo_id"], 20).collect()} == pytest.approx(whole)


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantiles(spark, share):
    import random

    rng = random.Random(1)
    rows = [(g, float(rng.choice([1, 2, 3, rng.random(), 7.5])), rng.randint(1, 3)) for g in "ab" for _ in range(60)] + [("c", 4.0, 1), ("d", None, 2)]
    df = spark.createDataFrame(rows, "g string, v double, n int").repartition(3)
    got = {r.g: r.q for r in E.exact_quantiles(df, ["g"], "v", share, "q", "n").collect()}
    want = {g: np.quantile([v for h, v, n in rows if h == g and v is not None for _ in range(n)], share) for g in "abc"}
    assert got == pytest.approx(want)
