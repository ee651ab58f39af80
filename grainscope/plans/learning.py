"""Queries on training, scoring and streaming, on the labelled corpus of all images with 143 columns.

What a fitted model says has no SQL form. The statements therefore state which rows must be scored, how often and by whom, and
that figures recomputed from the written scores by other means agree.
"""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from grainscope.functions.columns import feature_group, fixed
from grainscope.operators import corpus as C
from grainscope.operators import detector as D
from grainscope.operators import evaluate as E
from grainscope.operators import learn as L
from grainscope.operators import variants as V
from grainscope.operators.features import features_of
from grainscope.operators.geometry import jpeg_round_trip
from grainscope.operators.stats import row_summary
from grainscope.plans import tables as T
from grainscope.plans.registry import query
from grainscope.plans.sqltext import PX, TILE_PX, detector, stages
from grainscope.plans.variants import grid_table, sizes
from grainscope.schemas import ALL_FEATURES, FEATURE_SETS, KEY, PHOTO, variant_table
from grainscope.session import save_and_reload, shared_dir
from grainscope.sources import encode as EN
from grainscope.sources import images as I
from grainscope.sources import models as M
from grainscope.sources import rasters as S
from grainscope.sources import stores as ST
from grainscope.streaming import scan as W

# Rounds of the fits of weighted_training and gain_importance; all other parameters are those of L.PARAMETERS. MLlib spends
# about a quarter of a second on a boosted round however few the rows are.
BRIEF = {"GB": {"maxIter": 3}, "LGB": {"maxIter": 3}}
CANDIDATES = ["LR", "RF", "GB", "XGB"]
META = ["label", "method", "p", "density", "changed_frac"]


def corpus_table(spark, sf_dir):
    """Labelled corpus (clean, recompressed and coded rows of all images) with 143 columns, stored once: all fits read it.

    Pixels, features and metadata stay in one row from coding to storing."""
    clean = S.embedding_rasters(spark, sf_dir)
    corpus = V.labelled_corpus(clean, variant_table(spark))
    again = jpeg_round_trip(clean).withColumns({
        "label": F.lit(0), **{c: F.lit(None).cast(dict(corpus.dtypes)[c]) for c in META[1:]}})
    rows = corpus.unionByName(again.select(corpus.columns))
    features = features_of(row_summary(rows, residuals=True, keep=[*KEY, *META])).select(*KEY, *META, *ALL_FEATURES)
    return save_and_reload(features.withColumn("weight", L.weak_variant_weight(3.0)), f"{shared_dir(spark)}/corpus")


#: The rows of the corpus: (photo_id, variant, method, label).
CORPUS = f"""{sizes("SELECT 'emb' AS source, vec_id // 64 AS photo_id, 64 * count(*) AS n_px FROM embeddings GROUP BY ALL", 8)},
corpus AS (SELECT photo_id, variant, method, 1 AS label FROM e WHERE status = 'ok'
           UNION ALL SELECT photo_id, unnest(['clean', 'clean_jpeg']), NULL, 0 FROM d)"""


def _models(names) -> str:
    return "(VALUES " + ", ".join(f"('{n}')" for n in names) + ") AS m(model)"


def _area_agrees(scores, by, prob="prob"):
    """Whether the AUC of each group equals MLlib's own, computed from the same scores by trapezoids: rows (by, auc, auc_ok)."""
    groups = E.auc(scores, by, prob).collect()      # one row per model

    def again(r):
        mine = scores.where(" and ".join(f"{c} = '{r[c]}'" for c in by))
        area = BinaryClassificationEvaluator(rawPredictionCol=prob, numBins=0).evaluate(mine.withColumn("label", F.col("label").cast("double")))
        return (*(r[c] for c in by), r["n_pos"], r["n_neg"], abs(area - r["auc"]) < 1e-9)

    kinds = dict(scores.dtypes)
    rows = L.fit_all([lambda r=r: again(r) for r in groups])
    return scores.sparkSession.createDataFrame(
        rows, ", ".join(f"{c} {kinds[c]}" for c in by) + ", n_pos long, n_neg long, auc_ok boolean")


def _oof(spark, sf_dir, names=CANDIDATES, **kw):
    return save_and_reload(L.out_of_fold(corpus_table(spark, sf_dir), ALL_FEATURES, list(names), **kw),
                           f"{shared_dir(spark)}/oof")


@query("out_of_fold", f"""WITH {CORPUS} SELECT model, variant, count(*) AS n, count(DISTINCT photo_id) AS n_photos, 1 AS scores_per_row,
  1 AS folds_per_photo, true AS in_range FROM corpus, {_models(CANDIDATES)} GROUP BY ALL""")
def out_of_fold(spark, sf_dir):
    """Four classifiers on 143 columns in five folds by photo: each row scored once, each photo within one fold."""
    oof = _oof(spark, sf_dir)
    per_row = oof.groupBy("model", *KEY).agg(F.count(F.lit(1)).alias("scores"), F.min("prob").alias("lo"), F.max("prob").alias("hi"))
    folds = oof.groupBy("model", *PHOTO).agg(F.count_distinct("fold").alias("folds"))
    return per_row.join(folds, ["model", *PHOTO]).groupBy("model", "variant").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(*PHOTO).alias("n_photos"), F.max("scores").cast("int").alias("scores_per_row"),
        F.max("folds").cast("int").alias("folds_per_photo"), F.bool_and(F.expr("lo >= 0 and hi <= 1")).alias("in_range"))


@query("stacked_model", f"""WITH {CORPUS} SELECT model, count_if(label = 1) AS n_pos, count_if(label = 0) AS n_neg, true AS auc_ok, true AS picked
FROM corpus, {_models([*CANDIDATES, "STACK"])} GROUP BY ALL""")
def stacked_model(spark, sf_dir):
    """Four candidates and the model stacked on their out-of-fold scores; the AUC of each agrees with MLlib's, and the
    pick is the largest."""
    oof = _oof(spark, sf_dir)
    _, stacked = L.stack(oof, CANDIDATES)
    every = save_and_reload(oof.select(*stacked.columns).unionByName(stacked), f"{shared_dir(spark)}/stacked")
    aucs = L.candidate_aucs(every)
    best = L.pick_model(aucs).select(F.col("auc").alias("best"))
    picked = aucs.crossJoin(F.broadcast(best)).agg(F.bool_and(F.col("auc") <= F.col("best")).alias("picked"))
    return _area_agrees(every, ["model"]).crossJoin(F.broadcast(picked))


@query("calibrated_scores", f"""WITH {CORPUS} SELECT variant, label, count(*) AS n, true AS in_range, true AS monotone FROM corpus GROUP BY ALL""")
def calibrated_scores(spark, sf_dir):
    """Sigmoid calibration in three folds; each fold's map rises with the score it calibrates."""
    t = corpus_table(spark, sf_dir)
    pairs = L.calibrated_models(t, ALL_FEATURES, "LR")
    rising = all(sigmoid.stages[-1].coefficients[0] >= 0 for _, sigmoid in pairs)
    return L.calibrated_score(pairs, t).groupBy("variant", "label").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.expr("prob between 0 and 1")).alias("in_range")).withColumn("monotone", F.lit(rising))


@query("weighted_training", f"""WITH {CORPUS} SELECT variant, CASE WHEN method = 'nsF5' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, count(*) AS n,
  count(*) AS n_scored FROM corpus GROUP BY ALL""")
def weighted_training(spark, sf_dir):
    """Out-of-fold scores of a model for which the hardest method's rows weigh three times."""
    t = corpus_table(spark, sf_dir)
    scores = L.out_of_fold(t, ALL_FEATURES, ["GB"], weight="weight", override=BRIEF)
    return t.select(*KEY, "weight").join(scores, KEY, "left").groupBy("variant", "weight").agg(
        F.count(F.lit(1)).alias("n"), F.count("prob").alias("n_scored"))


@query("seed_sweep", f"""WITH {CORPUS} SELECT stage, 8 AS n_seeds, CAST(8 * round_even(count(*) * 0.25, 0) AS BIGINT) AS n_validation, true AS in_range
FROM d, (VALUES ('143d'), ('53d')) AS s(stage) GROUP BY ALL""")
def seed_sweep(spark, sf_dir):
    """Held-out AUC over eight splits by photo for both deployed feature sets."""
    t = corpus_table(spark, sf_dir)
    out = None
    for stage in ("143d", "53d"):
        scores = L.seed_sweep(t, FEATURE_SETS[stage], "LGB", range(8), lambda df, seed: C.holdout_split(df, 0.25, seed))
        aucs = E.auc(scores, ["seed"], "prob").select(F.lit(stage).alias("stage"), "seed", "auc")
        spread = E.spread_over_seeds(aucs, ["stage"])
        photos = scores.select("seed", *PHOTO).distinct().agg(F.count(F.lit(1)).alias("n_validation"))
        row = spread.crossJoin(F.broadcast(photos)).select(
            "stage", F.col("n_seeds").cast("int").alias("n_seeds"), "n_validation",
            F.expr("auc_min >= 0 and auc_max <= 1 and auc_min <= auc_mean and auc_mean <= auc_max").alias("in_range"))
        out = row if out is None else out.unionByName(row)
    return out


GRID = ["LR", "XGB", "LGB", "RF"]


@query("feature_set_grid", f"""WITH {CORPUS} SELECT stage, n_feat, model, 3 AS n_seeds, 3 * count(*) AS n_scores, true AS auc_ok
FROM corpus, {_models(GRID)}, (VALUES {", ".join(f"('{k}', {len(v)})" for k, v in FEATURE_SETS.items())}) AS s(stage, n_feat) GROUP BY ALL""")
def feature_set_grid(spark, sf_dir):
    """Five feature sets by four classifiers by three seeds in five folds: 300 fits, each scoring its own fold."""
    t = corpus_table(spark, sf_dir)
    scores = L.run_grid(t, FEATURE_SETS, GRID, range(3), override=L.GRID_PARAMETERS)
    aucs = E.auc(scores, ["stage", "model", "seed"], "prob")
    n_feat = F.create_map(*[F.lit(x) for k, v in FEATURE_SETS.items() for x in (k, len(v))])
    return aucs.groupBy("stage", n_feat[F.col("stage")].alias("n_feat"), "model").agg(
        F.count("auc").cast("int").alias("n_seeds"), F.sum(F.col("n_pos") + F.col("n_neg")).alias("n_scores"),
        F.bool_and(F.expr("auc between 0 and 1")).alias("auc_ok"))


@query("gain_importance", f"""WITH {CORPUS} SELECT 'LGB' AS model, g AS "group", k AS n_feat, 143 AS n_ranked, true AS shares_ok
FROM (VALUES ('SRM 90', 90), ('BASE 11', 11), ('LSB PREFIX 20', 20), ('PREFIX 20', 20), ('TEXTURE/EST 2', 2)) AS t(g, k)
WHERE (SELECT count(*) FROM corpus) > 0""")
def gain_importance(spark, sf_dir):
    """Gain of all 143 columns in a boosted model of the corpus: ranks, shares and families."""
    t = corpus_table(spark, sf_dir)
    model = L.pipeline("LGB", ALL_FEATURES, t.count(), **BRIEF["LGB"]).fit(t)
    gains = spark.createDataFrame(L.importances(model, ALL_FEATURES, "LGB"), "model string, position int, feature string, gain double")
    ranked = E.importance_ranked(gains)
    whole = ranked.groupBy("model").agg(F.count_distinct("rank").cast("int").alias("n_ranked"), F.sum("gain_pct").alias("shares"),
                                        F.max("gain_cum").alias("last"))
    groups = E.importance_groups(gains, feature_group(F.col("feature")))
    return groups.join(whole, "model").select("model", "group", F.col("n_feat").cast("int").alias("n_feat"), "n_ranked", F.expr(
        "abs(shares - 1) < 1e-9 and abs(last - 1) < 1e-9 and gain_pct between 0 and 1").alias("shares_ok"))


# ---------------------------------------------------------------- deployed models
def deploy(spark, sf_dir, stages_=("143d", "53d"), name="LR"):
    """Train one model per feature set on three quarters of the photos, take thresholds from the others and clipping bounds
    from all rows, and store the artefacts: {feature set: (path, fingerprint)}."""
    t = corpus_table(spark, sf_dir)
    split = C.holdout_split(t, 0.25, 0)
    bounds = {r["feature"]: (r["lo"], r["hi"]) for r in L.training_bounds(t, ALL_FEATURES).collect()}

    def one(stage):
        features = FEATURE_SETS[stage]
        model, scores = L.train_holdout(t, features, name, split, **BRIEF.get(name, {}))
        cut, area = E.thresholds(scores, score="prob").first(), E.auc(scores, score="prob").first()
        artefact = M.Artefact(
            f"{name}-{stage}", model, tuple(features), cut["youden"], cut["low_fp"], {f: bounds[f] for f in features},
            {"feature_set": stage, "held_out_auc": area["auc"], "split": {"by": "photo", "validation": 0.25, "seed": 0}})
        path = f"{shared_dir(spark)}/{stage}"
        return path, M.save_artefact(spark, artefact, path)

    return dict(zip(stages_, L.fit_all([lambda s=s: one(s) for s in stages_])))


@query("model_registry", """SELECT unnest(['LR-143d', 'LR-53d', 'changed', 'absent']) AS name, unnest(['ok', 'ok', 'refused', 'refused']) AS status,
  unnest([143, 53, 0, 0]) AS n_features, unnest([true, true, false, false]) AS same_fingerprint, count(*) AS n_vectors FROM embeddings""")
def model_registry(spark, sf_dir):
    """Two artefacts that load as they were stored, one whose feature list was changed, and one that is not there."""
    paths = deploy(spark, sf_dir)
    loaded = [M.load_artefact(spark, path) for path, _ in paths.values()]
    marks = [mark for _, mark in paths.values()]
    meta = spark.read.text(f"{paths['53d'][0]}/meta")
    other = f"{shared_dir(spark)}/changed"
    M.load_artefact(spark, paths["53d"][0]).model.write().save(f"{other}/model")
    meta.select(F.regexp_replace(F.regexp_replace("value", '"Rm", "Sm"', '"Sm", "Rm"'), "LR-53d", "changed").alias("value")).coalesce(1).write.text(f"{other}/meta")
    entries = [*loaded, M.load_artefact(spark, other), M.load_artefact(spark, f"{shared_dir(spark)}/absent")]
    table = M.registry_table(spark, entries)
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.count(F.lit(1)).alias("n_vectors"))
    return table.select("name", F.regexp_extract("status", "^[a-z]+", 0).alias("status"), "n_features",
                        F.col("fingerprint").isin(marks).alias("same_fingerprint")).crossJoin(F.broadcast(n))


def _verdict_ok():
    """The verdict recomputed from probability and threshold."""
    p, t = F.col("ml.probability"), F.col("ml.threshold")
    return F.col("ml.verdict") == F.when(p >= t, "stego").when(p < 0.9 * t, "clean").otherwise("unclear")


_BLIND = f"WITH {PX}, {stages()}{detector()}"


@query("model_scan", _BLIND + """ SELECT photo_id, sensitivity, round(prob, 6) AS prob, true AS available, true AS verdict_ok, true AS threshold_ok, true AS hashed
FROM det, (VALUES ('strict'), ('balanced'), ('loose')) AS s(sensitivity)
UNION ALL SELECT photo_id, 'no model', round(prob, 6), false, NULL, NULL, true FROM det""")
def model_scan(spark, sf_dir):
    """Batch scan of all images with the rules and a stored model side by side, in each sensitivity, and without a model."""
    rasters = S.embedding_rasters(spark, sf_dir)
    artefact = M.load_artefact(spark, deploy(spark, sf_dir, ("143d",))["143d"][0])
    wanted = {"strict": artefact.threshold_low_fp, "balanced": artefact.threshold, "loose": max(0.05, 0.75 * artefact.threshold)}
    out = None
    for sensitivity, threshold in wanted.items():
        rows = D.model_scan(rasters, artefact, sensitivity, side=S.EMBEDDING_SIDE).select(
            "photo_id", F.lit(sensitivity).alias("sensitivity"), fixed(F.col("prob")).alias("prob"), "ml.available",
            _verdict_ok().alias("verdict_ok"), (F.abs(F.col("ml.threshold") - threshold) < 1e-12).alias("threshold_ok"),
            (F.length("image_sha256") == 64).alias("hashed"))
        out = rows if out is None else out.unionByName(rows)
    without = D.model_scan(rasters, M.load_artefact(spark, f"{shared_dir(spark)}/absent")).select(
        "photo_id", F.lit("no model").alias("sensitivity"), fixed(F.col("prob")).alias("prob"), "ml.available",
        F.col("ml.verdict").isNotNull().alias("verdict_ok"), F.col("ml.threshold").isNotNull().alias("threshold_ok"),
        (F.length("image_sha256") == 64).alias("hashed"))
    return out.unionByName(without.withColumns({c: F.when(F.col(c), True) for c in ("verdict_ok", "threshold_ok")}))


@query("payload_curve_model", f"""WITH {CORPUS} SELECT photo_id, density, true AS scored, density = 0 AS as_cover FROM (
  SELECT photo_id, unnest([0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4])::DOUBLE AS density FROM d)""")
def payload_curve_model(spark, sf_dir):
    """Model probability of every image at every density; at density 0 it is the probability of the cover."""
    covers = S.embedding_rasters(spark, sf_dir)
    artefact = M.load_artefact(spark, deploy(spark, sf_dir, ("53d",))["53d"][0])
    curve = D.payload_curve(covers, grid_table(spark), artefact=artefact, side=S.EMBEDDING_SIDE)
    cover = D.model_scan(covers, artefact, side=S.EMBEDDING_SIDE).select(*PHOTO, F.col("ml.probability").alias("own"))
    return curve.join(cover, PHOTO).select("photo_id", "density", F.expr("ml_probability between 0 and 1").alias("scored"), (
        (F.col("density") == 0) & (F.abs(F.col("ml_probability") - F.col("own")) < 1e-12)).alias("as_cover"))


@query("batch_scoring", """SELECT model, clip AS clip_outliers, coalesce(source, 'ALL') AS source, n_photos, true AS rate_ok, true AS interval_ok FROM (
  SELECT source, count(*) AS n_photos FROM documents WHERE octet_length(encode(text)) > 0 GROUP BY GROUPING SETS ((source), ())),
  (VALUES ('LR-143d'), ('LR-53d')) AS m(model), (VALUES (false), (true)) AS c(clip)""")
def batch_scoring(spark, sf_dir):
    """False positives of both deployed models on images that none was trained on (all documents), with and without
    clipping, per source and in all; thresholds come from held-out photos."""
    artefacts = [M.load_artefact(spark, path) for path, _ in deploy(spark, sf_dir).values()]
    summary = row_summary(S.document_bytes(spark, sf_dir), residuals=True)
    table = save_and_reload(features_of(summary).select(*KEY, *ALL_FEATURES), f"{shared_dir(spark)}/documents")
    rows = None
    for artefact in artefacts:
        for clip in (False, True):
            part = D.model_block(table, artefact, clip_outliers=clip).select(
                *KEY, F.col("ml.name").alias("model"), F.lit(clip).alias("clip"), F.round("ml.probability", 6).alias("ml_prob"),
                (F.col("ml.probability") >= F.col("ml.threshold")).cast("int").alias("pred_stego"))
            rows = part if rows is None else rows.unionByName(part)
    s = E.false_positive_summary(rows)
    return s.select("model", "clip_outliers", "source", "n_photos",
                    (F.abs(F.col("fp_rate") - F.col("n_false_positive") / F.col("n_photos")) < 1e-4).alias("rate_ok"),
                    F.expr("fp_ci_lo <= fp_rate + 1e-4 and fp_rate <= fp_ci_hi + 1e-4").alias("interval_ok"))


@query("stacked_selection", f"""WITH {T.SCORED}, {T.ROC}, a AS (SELECT model, sum(pos * (nn - fp + neg / 2.0)) / (max(np) * max(nn)) AS auc FROM roc GROUP BY ALL)
SELECT '53d' AS model, round(auc, 6) AS auc FROM a WHERE model = '53d'""")
def stacked_selection(spark, sf_dir):
    """A forced candidate wins over a better one."""
    p = L.pick_model(E.auc(T.scored(spark, sf_dir), ["model"]), force="53d")
    return p.select("model", fixed(F.col("auc")).alias("auc"))


@query("stream_scan", f"""WITH {TILE_PX}, {stages('source, photo_id')}{detector('source, photo_id')}
SELECT source, photo_id, round(prob, 6) AS stego_probability FROM det""")
def stream_scan(spark, sf_dir):
    """Continuous scan of a raster store until it has caught up; equal to the batch scan."""
    base = shared_dir(spark)
    ST.write_rasters(S.tile_rasters(spark, sf_dir), f"{base}/drop")
    W.watch_raster_store(spark, f"{base}/drop", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    v = W.read_verdicts(spark, f"{base}/out")
    return v.select("source", "photo_id", fixed(F.col("stego_probability")).alias("stego_probability"))


# ---------------------------------------------------------------- image files of all formats
FORMATS = ["pgm", "png", "bmp", "tif", "tiff", "jpg", "jpeg"]
DAMAGED, COLOURED = "photo_id % 3 = 2", "format in ('png', 'bmp', 'tif', 'tiff') and photo_id div 7 % 2 = 1"


def write_table_images(spark, sf_dir, folder):
    """All images of the embeddings table as files: the format goes by the number, some are colour, every third is damaged."""
    pick = F.element_at(F.array(*[F.lit(f) for f in FORMATS]), (F.col("photo_id") % len(FORMATS) + 1).cast("int"))
    named = S.embedding_rasters(spark, sf_dir).withColumn("format", pick).withColumn("channels", F.expr(f"if({COLOURED}, 3, 1)")).withColumn(
        "name", F.concat(F.lit("i"), F.col("photo_id").cast("string"), F.lit("."), F.col("format"))).withColumn(
        "px", F.expr("if(channels = 3, flatten(transform(px, v -> array(v, cast(255 - v as smallint), v))), px)"))
    files = EN.encode_images(named, "name", "channels").withColumn(
        "photo_id", F.regexp_extract("name", "([0-9]+)", 1).cast("long")).withColumn(
        "content", F.when(F.expr(DAMAGED), F.substring("content", 1, 10)).otherwise(F.col("content")))
    return EN.write_files(files, folder).agg(F.count(F.lit(1)).alias("n")).first()["n"]


# pixels of the decoded files: luma of colour files, blocks of 8 x 8 equal pixels in JPEG files
_FILE_PX = f"""{PX.replace("px AS", "px0 AS", 1)},
f AS (SELECT photo_id, {FORMATS}[CAST(photo_id % 7 + 1 AS INTEGER)] AS format, photo_id % 3 = 2 AS damaged FROM (SELECT DISTINCT photo_id FROM px0)),
g AS (SELECT photo_id, format, i // 64 AS y, i % 64 AS x, CASE WHEN format IN ('png', 'bmp', 'tif', 'tiff') AND photo_id // 7 % 2 = 1
             THEN (19595 * v + 38470 * (255 - v) + 7471 * v + 32768) >> 16 ELSE v END AS v FROM px0 JOIN f USING (photo_id) WHERE NOT damaged),
px AS (SELECT photo_id, y * 64 + x AS i, y, x, v FROM g WHERE format NOT IN ('jpg', 'jpeg')
       UNION ALL SELECT photo_id, (8 * y + a) * 512 + 8 * x + b, 8 * y + a, 8 * x + b, v FROM g, range(8) t(a), range(8) u(b) WHERE format IN ('jpg', 'jpeg'))"""


@query("scan_image_files", f"""WITH {_FILE_PX}, s AS (SELECT photo_id, max(y) + 1 AS height, max(x) + 1 AS width, sum(v)::BIGINT AS sum_v,
  sum(v * (i % 1009))::BIGINT AS sum_iv FROM px GROUP BY ALL)
SELECT 'i' || photo_id || '.' || format AS name, height::INTEGER AS height, width::INTEGER AS width, sum_v, sum_iv, damaged AS rejected FROM f LEFT JOIN s USING (photo_id)""")
def scan_image_files(spark, sf_dir):
    """Files of seven formats written from a table, scanned and decoded; damaged ones are set aside."""
    folder = shared_dir(spark)
    write_table_images(spark, sf_dir, folder)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    good, bad = I.quarantine(I.decode_folder(spark, folder))
    total = F.expr("aggregate(px, 0L, (a, v) -> a + v)")
    placed = F.expr("aggregate(zip_with(px, sequence(0, size(px) - 1), (v, i) -> cast(v as long) * (i % 1009)), 0L, (a, x) -> a + x)")
    rows = good.select(name.alias("name"), "height", "width", total.alias("sum_v"), placed.alias("sum_iv"), F.lit(False).alias("rejected"))
    none = {c: F.lit(None).cast(k) for c, k in rows.dtypes if c not in ("name", "rejected")}
    return rows.unionByName(bad.select(name.alias("name"), F.lit(True).alias("rejected")).withColumns(none))


@query("stream_image_files", f"""WITH {_FILE_PX}, {stages()}{detector()}
SELECT 'i' || photo_id || '.' || format AS name, round(prob, 6) AS prob, CASE WHEN NOT damaged THEN true END AS scored, damaged AS rejected
FROM f LEFT JOIN det USING (photo_id)""")
def stream_image_files(spark, sf_dir):
    """The same files through the continuous scan, with a stored model: verdicts equal the batch's, damaged files go aside."""
    base = shared_dir(spark)
    write_table_images(spark, sf_dir, f"{base}/drop")
    artefact = M.load_artefact(spark, deploy(spark, sf_dir, ("53d",))["53d"][0])
    W.watch_folder(spark, f"{base}/drop", f"{base}/out", f"{base}/checkpoint", artefact=artefact, side=S.EMBEDDING_SIDE).awaitTermination()
    name = F.regexp_extract("path", "([^/]+)$", 1).alias("name")
    rows = W.read_verdicts(spark, f"{base}/out").select(
        name, fixed(F.col("prob")).alias("prob"), (F.expr("ml.probability between 0 and 1") & _verdict_ok()).alias("scored"), F.lit(False).alias("rejected"))
    return rows.unionByName(spark.read.parquet(f"{base}/out/rejects").select(
        name, F.lit(None).cast("double").alias("prob"), F.lit(None).cast("boolean").alias("scored"), F.lit(True).alias("rejected")))
