"""Queries on evaluation: ROC, thresholds, rates, intervals, bootstrap, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainscope.functions.columns import feature_group, feature_subgroup, fixed, ratio, wilson
from grainscope.operators import corpus as C
from grainscope.operators import evaluate as E
from grainscope.operators.features import base_features
from grainscope.operators.residuals import residual_stats
from grainscope.plans import tables as T
from grainscope.plans.registry import query
from grainscope.plans.sqltext import DOC_PX, PX, kernels, stages
from grainscope.schemas import BASE
from grainscope.session import save_and_reload, shared_dir
from grainscope.sources import rasters as S


@query("roc_points", f"""WITH {T.SCORED}, {T.ROC}
SELECT model, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / np, 6) AS tpr, round(fp / nn, 6) AS fpr FROM roc""")
def roc_points(spark, sf_dir):
    r = E.roc(T.scored(spark, sf_dir), ["model"])
    return r.select("model", "threshold", "tp", "fp", fixed(F.col("tpr")).alias("tpr"), fixed(F.col("fpr")).alias("fpr"))


_AUC = "round(sum(pos * (nn - fp + neg / 2.0)) / (max(np) * max(nn)), 6)"


@query("auc_ties", f"""WITH {T.SCORED}, {T.ROC}
SELECT model, CAST(max(np) AS BIGINT) AS n_pos, CAST(max(nn) AS BIGINT) AS n_neg, {_AUC} AS auc FROM roc GROUP BY ALL""")
def auc_ties(spark, sf_dir):
    a = E.auc(T.scored(spark, sf_dir), ["model"])
    return a.select("model", "n_pos", "n_neg", fixed(F.col("auc")).alias("auc"))


@query("youden", f"""WITH {T.SCORED}, {T.ROC}
SELECT model, coalesce(arg_max(threshold, {{'j': tp / np - fp / nn, 't': threshold}}), 0.5) AS youden FROM roc GROUP BY ALL""")
def youden(spark, sf_dir):
    return E.thresholds(T.scored(spark, sf_dir), ["model"]).select("model", "youden")


@query("low_fp_threshold", f"""WITH {T.SCORED}, {T.ROC}
SELECT model, coalesce(min(threshold) FILTER (fp / nn <= 0.10 AND tp > 0), 0.5) AS low_fp FROM roc GROUP BY ALL""")
def low_fp_threshold(spark, sf_dir):
    return E.thresholds(T.scored(spark, sf_dir), ["model"]).select("model", "low_fp")


@query("confusion", f"""WITH {T.PRED}, c AS (SELECT model, count_if(label = 1 AND pred = 1) AS tp, count_if(label = 0 AND pred = 1) AS fp,
  count_if(label = 0 AND pred = 0) AS tn, count_if(label = 1 AND pred = 0) AS fn FROM pred GROUP BY ALL)
SELECT model, tp, fp, tn, fn, round(tp / (tp + fn), 6) AS tpr, round(fp / (fp + tn), 6) AS fpr, round(tn / (fp + tn), 6) AS tnr,
  round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((tp / (tp + fn) + tn / (fp + tn)) / 2, 6) AS balanced_accuracy,
  round(tp / nullif(tp + fp, 0), 6) AS precision_1, round(tn / nullif(tn + fn, 0), 6) AS precision_0,
  round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1_1, round(2 * tn / nullif(2 * tn + fp + fn, 0), 6) AS f1_0 FROM c""")
def confusion(spark, sf_dir):
    c = E.confusion(T.with_threshold(T.scored(spark, sf_dir)), ["model"])
    rates = [x for x in c.columns if x not in ("model", "tp", "fp", "tn", "fn")]
    return c.select("model", "tp", "fp", "tn", "fn", *[fixed(F.col(x)).alias(x) for x in rates])


@query("auc_by_fold_wins", f"""WITH {T.SCORED}, s AS (SELECT *, ('0x' || substr(md5('fold:' || source), 1, 4))::INT % 8 AS fold FROM scored),
a AS (SELECT x.model, x.fold, avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0.0 END) AS auc
      FROM s x JOIN s y ON x.model = y.model AND x.fold = y.fold AND x.label = 1 AND y.label = 0 GROUP BY ALL),
w AS (SELECT fold, max(auc) FILTER (model = '143d') AS a, max(auc) FILTER (model = '53d') AS b FROM a GROUP BY ALL)
SELECT round(avg(a), 6) AS mean_a, round(stddev_samp(a), 6) AS std_a, round(avg(b), 6) AS mean_b, round(stddev_samp(b), 6) AS std_b,
       count_if(a > b) AS wins_a, count_if(b > a) AS wins_b FROM w""")
def auc_by_fold_wins(spark, sf_dir):
    fold = F.conv(F.substring(F.md5(F.concat(F.lit("fold:"), "source")), 1, 4), 16, 10).cast("int") % 8
    folds = E.auc(T.scored(spark, sf_dir).withColumn("fold", fold), ["model", "fold"])
    w = E.wins(folds, ["fold"], "143d", "53d")
    return w.select(*[fixed(F.col(c)).alias(c) for c in ("mean_a", "std_a", "mean_b", "std_b")], "wins_a", "wins_b")


_SEED_AUC = f"""WITH {T.SCORED}, s AS (SELECT scored.*, seed FROM scored, (SELECT unnest(range(8)) AS seed)
  WHERE ('0x' || substr(md5(seed || ':' || source), 1, 2))::INT < 160),
cnt AS (SELECT model, seed, score, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM s GROUP BY ALL),
cum AS (SELECT *, sum(neg) OVER (PARTITION BY model, seed ORDER BY score) - neg AS below FROM cnt),
a AS (SELECT model, seed, sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM cum GROUP BY ALL)"""


def _seed_aucs(spark, sf_dir):
    """AUC of each model on eight hash-drawn halves of the sources."""
    seeds = F.explode(F.sequence(F.lit(0), F.lit(7)))
    drawn = T.scored(spark, sf_dir).withColumn("seed", seeds).where(
        F.conv(F.substring(F.md5(F.concat_ws(":", "seed", "source")), 1, 2), 16, 10).cast("int") < 160)
    return E.auc(drawn, ["model", "seed"])


@query("auc_over_seeds", _SEED_AUC + """ SELECT model, round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_std_pop,
  round(stddev_samp(auc), 6) AS auc_std, round(min(auc), 6) AS auc_min, round(max(auc), 6) AS auc_max, count(auc) AS n_seeds FROM a GROUP BY ALL""")
def auc_over_seeds(spark, sf_dir):
    s = E.spread_over_seeds(_seed_aucs(spark, sf_dir), ["model"])
    return s.select("model", *[fixed(F.col(c)).alias(c) for c in s.columns if c.startswith("auc_")], "n_seeds")


@query("auc_pivot", _SEED_AUC + """ SELECT seed::INT AS seed, round(max(auc) FILTER (model = '143d'), 6) AS "143d",
  round(max(auc) FILTER (model = '53d'), 6) AS "53d" FROM a GROUP BY ALL""")
def auc_pivot(spark, sf_dir):
    p = _seed_aucs(spark, sf_dir).groupBy("seed").pivot("model", ["143d", "53d"]).agg(F.max("auc"))
    return p.select("seed", *[fixed(F.col(f"`{c}`")).alias(c) for c in ("143d", "53d")])


@query("best_model", f"""WITH {T.SCORED}, {T.ROC}, a AS (SELECT model, {_AUC} AS auc FROM roc GROUP BY ALL)
SELECT arg_max(model, auc) AS model, max(auc) AS auc FROM a""")
def best_model(spark, sf_dir):
    from grainscope.operators.learn import pick_model

    aucs = E.auc(T.scored(spark, sf_dir), ["model"])
    return pick_model(aucs).select("model", fixed(F.col("auc")).alias("auc"))


# ---------------------------------------------------------------- rates and intervals
@query("detection_by_method", f"""WITH {T.LABELLED} SELECT method, p, density, count(*) AS n, count_if(f_vowels >= 0.355) AS n_detected,
  round(avg(CASE WHEN f_vowels >= 0.355 THEN 1.0 ELSE 0.0 END), 6) AS detection_rate FROM lab GROUP BY ALL""")
def detection_by_method(spark, sf_dir):
    r = E.detection_rates(T.labelled(spark, sf_dir), ["method", "p", "density"], "f_vowels", F.lit(0.355))
    return r.withColumn("detection_rate", fixed(F.col("detection_rate")))


@query("detection_by_variant", f"""WITH {T.LABELLED}, r AS (SELECT variant, count(*) AS n, count_if(f_vowels >= 0.355) AS n_detected,
  avg(CASE WHEN f_vowels >= 0.355 THEN 1.0 ELSE 0.0 END) AS rate FROM lab GROUP BY ALL)
SELECT variant, n, n_detected, round(rate, 6) AS detection_rate,
       round((SELECT max(rate) FROM r WHERE variant IN ('clean', 'clean_jpeg')), 6) AS clean_fp FROM r""")
def detection_by_variant(spark, sf_dir):
    r = E.detection_rates(T.labelled(spark, sf_dir), ["variant"], "f_vowels", F.lit(0.355))
    return r.crossJoin(F.broadcast(E.clean_false_positives(r))).select(
        "variant", "n", "n_detected", fixed(F.col("detection_rate")).alias("detection_rate"), fixed(F.col("clean_fp")).alias("clean_fp"))


@query("density_curve", f"""WITH {T.LABELLED}, cnt AS (SELECT f_vowels AS s, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM lab GROUP BY ALL),
roc AS (SELECT s, sum(pos) OVER (ORDER BY s DESC) / sum(pos) OVER () AS tpr, sum(neg) OVER (ORDER BY s DESC) / sum(neg) OVER () AS fpr FROM cnt),
y AS (SELECT arg_max(s, {{'j': tpr - fpr, 't': s}}) AS thr FROM roc)
SELECT method, density, count(*) AS n, round(avg(CASE WHEN f_vowels >= thr THEN 1.0 ELSE 0.0 END), 6) AS detection_rate,
       round((SELECT avg(CASE WHEN f_vowels >= thr THEN 1.0 ELSE 0.0 END) FROM lab, y WHERE label = 0), 6) AS clean_fp
FROM lab, y WHERE method IS NOT NULL GROUP BY ALL""")
def density_curve(spark, sf_dir):
    """Detection per method and density at the Youden point, clean false positives beside it."""
    lab = T.labelled(spark, sf_dir)
    thr = F.broadcast(E.thresholds(lab, score="f_vowels").select("youden"))
    joined = lab.crossJoin(thr)
    coded = E.detection_rates(joined.where("method is not null"), ["method", "density"], "f_vowels", F.col("youden"))
    clean = E.detection_rates(joined.where("label = 0"), [], "f_vowels", F.col("youden")).select(
        F.col("detection_rate").alias("clean_fp"))
    return coded.crossJoin(F.broadcast(clean)).select(
        "method", "density", "n", fixed(F.col("detection_rate")).alias("detection_rate"), fixed(F.col("clean_fp")).alias("clean_fp"))


def _wilson_sql(k: str, n: str, sign: str) -> str:
    return (f"(({k}/{n} + 1.96*1.96/(2.0*{n})) {sign} 1.96*sqrt({k}/{n}*(1-{k}/{n})/{n} + 1.96*1.96/(4.0*{n}*{n})))"
            f" / (1 + 1.96*1.96/{n})")


@query("fp_summary_grouping_sets", f"""WITH {T.PHOTOS}, g AS (SELECT model, clip, CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS source,
  count(*) AS n, CAST(sum(pred_stego) AS DOUBLE) AS k, median(ml_prob) AS m FROM photos GROUP BY GROUPING SETS ((model, clip, source), (model, clip)))
SELECT model, clip AS clip_outliers, source, n AS n_photos, CAST(k AS BIGINT) AS n_false_positive, round(k / n, 4) AS fp_rate,
  round(greatest(0, {_wilson_sql('k', 'n', '-')}), 4) AS fp_ci_lo, round(least(1, {_wilson_sql('k', 'n', '+')}), 4) AS fp_ci_hi,
  round(m, 6) AS median_prob FROM g""")
def fp_summary(spark, sf_dir):
    return E.false_positive_summary(T.scored_photos(spark, sf_dir))


@query("wilson_ci", f"""WITH {T.PRED}, g AS (SELECT model, source, count(*) AS n, CAST(count_if(pred = 1) AS DOUBLE) AS k FROM pred WHERE label = 0 GROUP BY ALL)
SELECT model, source, n, CAST(k AS BIGINT) AS k, round(greatest(0, {_wilson_sql('k', 'n', '-')}), 6) AS lo,
  round(least(1, {_wilson_sql('k', 'n', '+')}), 6) AS hi FROM g""")
def wilson_ci(spark, sf_dir):
    g = T.with_threshold(T.scored(spark, sf_dir)).where("label = 0").groupBy("model", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pred").alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return g.select("model", "source", "n", "k", fixed(lo).alias("lo"), fixed(hi).alias("hi"))


@query("score_histogram", f"""WITH {T.PHOTOS}, e AS (SELECT model, clip, min(ml_prob) AS lo, max(ml_prob) AS hi FROM photos GROUP BY ALL)
SELECT model, clip, CASE WHEN hi > lo THEN least(29, CAST(floor((ml_prob - lo) / (hi - lo) * 30) AS INTEGER)) ELSE 0 END AS bin, count(*) AS n,
  count_if(pred_stego = 1) AS n_false_positive FROM photos JOIN e USING (model, clip) GROUP BY ALL""")
def score_histogram(spark, sf_dir):
    return E.score_histogram(T.scored_photos(spark, sf_dir), by=["model", "clip"])


@query("scored_rows_ordered", f"""WITH {T.PHOTOS} SELECT model, clip, source, photo_name, ml_prob, threshold, pred_stego FROM photos
ORDER BY model, clip, source, photo_name""")
def scored_rows_ordered(spark, sf_dir):
    p = T.scored_photos(spark, sf_dir)
    return p.orderBy("model", "clip", "source", "photo_name").select(
        "model", "clip", "source", "photo_name", "ml_prob", "threshold", "pred_stego")


_REPLICATES = 1000


@query("bootstrap_auc_ci", f"""WITH {T.SCORED}, s AS (SELECT * FROM scored WHERE model = '143d'),
num AS (SELECT source, doc_id, row_number() OVER (ORDER BY md5('0:' || source || ':' || doc_id)) - 1 AS slot FROM (SELECT DISTINCT source, doc_id FROM s)),
n AS (SELECT count(*) AS n FROM num),
draw AS (SELECT b, CAST('0x' || substr(md5('0:' || b || ':' || slot), 1, 12) AS BIGINT) % n AS slot FROM num, n, (SELECT unnest(range({_REPLICATES})) AS b)),
tm AS (SELECT b, slot, count(*) AS t FROM draw GROUP BY ALL),
w AS (SELECT b, score, sum(CASE WHEN label = 1 THEN t ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN t ELSE 0 END) AS neg
      FROM s JOIN num USING (source, doc_id) JOIN tm USING (slot) GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER (PARTITION BY b ORDER BY score) - neg AS below FROM w),
a AS (SELECT b, sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM c GROUP BY ALL)
SELECT count(auc) AS n_replicates, round(quantile_cont(auc, 0.025), 6) AS auc_lo, round(quantile_cont(auc, 0.975), 6) AS auc_hi FROM a""")
def bootstrap_auc_ci(spark, sf_dir):
    s = T.scored(spark, sf_dir).where("model = '143d'")
    b = E.bootstrap_auc_interval(s, ["source", "doc_id"], replicates=_REPLICATES)
    return b.select("n_replicates", fixed(F.col("auc_lo")).alias("auc_lo"), fixed(F.col("auc_hi")).alias("auc_hi"))


@query("bootstrap_auc_by_source", f"""WITH {T.SCORED}, s AS (SELECT * FROM scored WHERE model = '53d'),
num AS (SELECT source, row_number() OVER (ORDER BY md5('7:' || source)) - 1 AS slot FROM (SELECT DISTINCT source FROM s)),
n AS (SELECT count(*) AS n FROM num),
draw AS (SELECT b, CAST('0x' || substr(md5('7:' || b || ':' || slot), 1, 12) AS BIGINT) % n AS slot FROM num, n, (SELECT unnest(range(1000)) AS b)),
tm AS (SELECT b, slot, count(*) AS t FROM draw GROUP BY ALL),
w AS (SELECT b, score, sum(CASE WHEN label = 1 THEN t ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN t ELSE 0 END) AS neg
      FROM s JOIN num USING (source) JOIN tm USING (slot) GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER (PARTITION BY b ORDER BY score) - neg AS below FROM w),
a AS (SELECT b, sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM c GROUP BY ALL)
SELECT count(auc) AS n_replicates, round(quantile_cont(auc, 0.025), 6) AS auc_lo, round(quantile_cont(auc, 0.975), 6) AS auc_hi FROM a""")
def bootstrap_auc_by_source(spark, sf_dir):
    """Whole sources resampled 1000 times."""
    s = T.scored(spark, sf_dir).where("model = '53d'")
    b = E.bootstrap_auc_interval(s, ["source"], replicates=1000, seed="7")
    return b.select("n_replicates", fixed(F.col("auc_lo")).alias("auc_lo"), fixed(F.col("auc_hi")).alias("auc_hi"))


# ---------------------------------------------------------------- features as evidence
_FEATURES = BASE
_COUNTS = ("Rm", "Sm", "Rn", "Sn")
_FEATURE_SQL = f"""WITH {DOC_PX}, {stages('source, photo_id')},
ft AS (SELECT photo_id AS doc_id, source, "Rm", "Sm", "Rn", "Sn", round(gr, 6) AS "RS_Gr", round(gn, 6) AS "RS_Gn", round(chi2_pvalue, 6) AS chi2_pvalue,
       round(h, 6) AS diff_entropy, round(lg, 6) AS lsb_diff_entropy, round(median_prefix_p, 6) AS median_prefix_p, round(chi2_stat, 3) AS chi2_stat
       FROM med JOIN rsg USING (source, photo_id) JOIN ent USING (source, photo_id))"""
_NAMES_SQL = "unnest([" + ", ".join(f"'{c}'" for c in _FEATURES) + "])"
_VALUES_SQL = "unnest([" + ", ".join(f'CAST("{c}" AS DOUBLE)' for c in _FEATURES) + "])"


def _corr_sql(a: str, b: str) -> str:
    """Correlation of two columns, 0 where one of them is constant."""
    return f"CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) ELSE 0 END"


def document_features(spark, sf_dir):
    f = base_features(S.document_bytes(spark, sf_dir))
    return f.select(F.col("photo_id").alias("doc_id"), "source", *[
        F.col(c).cast("long").alias(c) if c in _COUNTS else fixed(F.col(c), 3 if c == "chi2_stat" else 6).alias(c) for c in _FEATURES])


def stored_features(spark, sf_dir):
    """The same table written once, for queries that pass over it several times."""
    return save_and_reload(document_features(spark, sf_dir), f"{shared_dir(spark)}/features")


def _gains(spark, sf_dir):
    """Importance of features: absolute correlation with the label."""
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet")
    t = document_features(spark, sf_dir).join(lab, "doc_id")
    wide = t.agg(*[F.when(F.stddev_pop(c) > 0, F.abs(F.corr(F.col(c).cast("double"), F.col("quality")))).otherwise(0.0).alias(c) for c in _FEATURES])
    return wide.select(F.inline(F.array(*[F.struct(
        F.lit("143d").alias("model"), F.lit(i).alias("position"), F.lit(c).alias("feature"), fixed(F.col(c)).alias("gain"))
        for i, c in enumerate(_FEATURES)])))


_GAINS_SQL = _FEATURE_SQL + f""", g AS (SELECT unnest(range({len(_FEATURES)})) AS position, {_NAMES_SQL} AS feature,
  unnest([{", ".join(f"""round(abs({_corr_sql(f'CAST("{c}" AS DOUBLE)', 'quality')}), 6)""" for c in _FEATURES)}]) AS gain FROM ft JOIN labels USING (doc_id))"""


@query("importance_share", _GAINS_SQL + """, r AS (SELECT *, row_number() OVER (ORDER BY gain DESC, position) AS rank, gain / sum(gain) OVER () AS pct FROM g)
SELECT feature, gain, CAST(rank AS INTEGER) AS rank, round(pct, 6) AS gain_pct, round(sum(pct) OVER (ORDER BY rank), 6) AS gain_cum FROM r""")
def importance_share(spark, sf_dir):
    r = E.importance_ranked(_gains(spark, sf_dir))
    return r.select("feature", "gain", "rank", fixed(F.col("gain_pct")).alias("gain_pct"), fixed(F.col("gain_cum")).alias("gain_cum"))


@query("importance_groups", _GAINS_SQL + """ SELECT 'BASE 11' AS "group", count(*) AS n_feat, round(sum(gain), 6) AS gain_sum, round(avg(gain), 6) AS gain_mean,
  round(stddev_pop(gain), 6) AS gain_std, max(gain) AS gain_max, min(gain) AS gain_min, 1.0::DOUBLE AS gain_pct FROM g""")
def importance_groups(spark, sf_dir):
    r = E.importance_groups(_gains(spark, sf_dir), feature_group(F.col("feature")))
    return r.select("group", "n_feat", *[fixed(F.col(c)).alias(c) for c in (
        "gain_sum", "gain_mean", "gain_std", "gain_max", "gain_min", "gain_pct")])



_RESIDUAL_MEANS = f"""WITH {PX}, {kernels(range(30))},
r0 AS (SELECT c.photo_id, c.i, k.c, k.dv, sum(k.w * coalesce(q.v, 0)) AS r
       FROM px AS c CROSS JOIN kern AS k LEFT JOIN px AS q ON q.photo_id = c.photo_id AND q.y = c.y + k.dy AND q.x = c.x + k.dx GROUP BY ALL),
r1 AS (SELECT photo_id, c, least(4.0, greatest(-4.0, r / CAST(dv AS DOUBLE))) AS r FROM r0),
mo AS (SELECT photo_id, c, avg(r) AS mu, avg(abs(r)) AS am, stddev_pop(abs(r)) AS sd FROM r1 GROUP BY ALL)"""


@query("importance_subgroups", _RESIDUAL_MEANS + """, sp AS (SELECT c, stddev_pop(mu) AS a, stddev_pop(am) AS b, stddev_pop(sd) AS d FROM mo GROUP BY ALL),
g AS (SELECT c, unnest(['SRM mu (30)', 'SRM absmean (30)', 'SRM std (30)']) AS "group", unnest([a, b, d]) AS gain FROM sp)
SELECT "group", count(*) AS n_feat, round(sum(gain), 6) AS gain_sum, round(avg(gain), 6) AS gain_mean, round(stddev_pop(gain), 6) AS gain_std,
  round(max(gain), 6) AS gain_max, round(min(gain), 6) AS gain_min, round(sum(gain) / (SELECT sum(gain) FROM g), 6) AS gain_pct FROM g GROUP BY ALL""")
def importance_subgroups(spark, sf_dir):
    """Finer families over all residual columns: gain is the spread of a column over images."""
    stats = residual_stats(S.embedding_rasters(spark, sf_dir))
    names = [c for c in stats.columns if c.startswith("srm_")]
    wide = stats.agg(*[F.stddev_pop(c).alias(c) for c in names])
    gains = wide.select(F.inline(F.array(*[F.struct(
        F.lit("143d").alias("model"), F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(c).alias("gain"))
        for i, c in enumerate(names)])))
    r = E.importance_groups(gains, feature_subgroup(F.col("feature")))
    return r.select("group", "n_feat", *[fixed(F.col(c)).alias(c) for c in (
        "gain_sum", "gain_mean", "gain_std", "gain_max", "gain_min", "gain_pct")])


@query("top_features", _GAINS_SQL + """ SELECT feature, gain FROM g ORDER BY gain DESC, feature LIMIT 20""")
def top_features(spark, sf_dir):
    return _gains(spark, sf_dir).orderBy(F.desc("gain"), "feature").limit(20).select("feature", "gain")


@query("single_feature_auc", _FEATURE_SQL + """, fo AS (SELECT *, ('0x' || substr(md5('fold:' || source), 1, 4))::INT % 5 AS fold FROM ft JOIN labels USING (doc_id)),
lo AS (SELECT fold, quality AS label, """ + _NAMES_SQL + " AS feature, " + _VALUES_SQL + """ AS score FROM fo),
sg AS (SELECT f.fold, feature, count(*) * sum(score * label) - sum(score) * sum(label) >= 0 AS up FROM (SELECT DISTINCT fold FROM lo) AS f JOIN lo ON lo.fold <> f.fold GROUP BY ALL),
au AS (SELECT x.fold, x.feature, avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0.0 END) AS auc
       FROM lo x JOIN lo y ON x.fold = y.fold AND x.feature = y.feature AND x.label = 1 AND y.label = 0 GROUP BY ALL),
si AS (SELECT feature, CASE WHEN up THEN auc ELSE 1 - auc END AS auc FROM au JOIN sg USING (fold, feature))
SELECT feature, round(avg(auc), 6) AS single_auc_mean, round(stddev_pop(auc), 6) AS single_auc_std FROM si GROUP BY ALL""")
def single_feature_auc(spark, sf_dir):
    fold = F.conv(F.substring(F.md5(F.concat(F.lit("fold:"), "source")), 1, 4), 16, 10).cast("int") % 5
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet")
    t = stored_features(spark, sf_dir).join(lab, "doc_id").withColumn("fold", fold)
    s = E.single_feature_auc(t, _FEATURES, label="quality")
    return s.select("feature", *[fixed(F.col(c)).alias(c) for c in ("single_auc_mean", "single_auc_std")])


_PAIRS = [(a, b) for i, a in enumerate(_FEATURES) for b in _FEATURES[i + 1:]]


@query("feature_correlation", _FEATURE_SQL + " " + " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, round({_corr_sql(f'CAST("{a}" AS DOUBLE)', f'CAST("{b}" AS DOUBLE)')}, 6) AS r FROM ft""" for a, b in _PAIRS))
def feature_correlation(spark, sf_dir):
    """All pairs of the feature columns."""
    p = E.correlation_pairs(document_features(spark, sf_dir), _FEATURES)
    return p.select("a", "b", fixed(F.nanvl("r", F.lit(0.0))).alias("r"))


@query("residual_correlation", _RESIDUAL_MEANS + """, cc AS (SELECT a.c AS a, b.c AS b, corr(a.am, b.am) AS r FROM mo a JOIN mo b ON a.photo_id = b.photo_id AND a.c < b.c GROUP BY ALL)
SELECT round(avg(r), 5) AS corr_mean, round(stddev_pop(r), 5) AS corr_std, round(min(r), 5) AS corr_min, round(max(r), 5) AS corr_max,
  round(quantile_cont(r, 0.05), 5) AS corr_p5, round(quantile_cont(r, 0.25), 5) AS corr_p25, round(quantile_cont(r, 0.5), 5) AS corr_p50,
  round(quantile_cont(r, 0.75), 5) AS corr_p75, round(quantile_cont(r, 0.95), 5) AS corr_p95 FROM cc""")
def residual_correlation(spark, sf_dir):
    """Spread of the correlations between the 30 absolute residual means."""
    stats = residual_stats(S.embedding_rasters(spark, sf_dir))
    c = E.correlation_summary(E.correlation_pairs(stats, [f"srm_absmean_c{c}" for c in range(30)]))
    return c.select(*[fixed(F.col(x), 5).alias(x) for x in c.columns])


@query("outlier_bounds", _FEATURE_SQL + """, l AS (SELECT """ + _NAMES_SQL + " AS feature, " + _VALUES_SQL + """ AS x FROM ft)
SELECT feature, round(avg(x), 4) AS mean, round(avg(x) - 5 * stddev_pop(x), 4) AS lo, round(avg(x) + 5 * stddev_pop(x), 4) AS hi FROM l GROUP BY ALL""")
def outlier_bounds(spark, sf_dir):
    b = E.outlier_bounds(document_features(spark, sf_dir), _FEATURES)
    return b.select("feature", *[fixed(F.col(c), 4).alias(c) for c in ("mean", "lo", "hi")])


@query("clipped_outliers", _FEATURE_SQL + """, l AS (SELECT source, """ + _NAMES_SQL + " AS feature, " + _VALUES_SQL + """ AS x FROM ft),
b AS (SELECT feature, avg(x) AS m, 3 * greatest(stddev_pop(x), 1e-9) AS w FROM l GROUP BY ALL)
SELECT source, feature, round(avg(least(m + w, greatest(m - w, x))), 4) AS mean_value, count_if(abs(x - m) > w * (1 + 1e-9)) AS n_clipped FROM l JOIN b USING (feature) GROUP BY ALL""")
def clipped_outliers(spark, sf_dir):
    """All columns clipped to mean -+ 3 deviations by the scoring operator, and how many values that changes."""
    from grainscope.operators.learn import clip_outliers

    f = stored_features(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in _FEATURES})
    bounds = E.outlier_bounds(f, _FEATURES, 3.0)
    clipped = clip_outliers(f, bounds).select("doc_id", "source", *[F.col(c).alias(f"c_{c}") for c in _FEATURES])
    both = f.join(clipped, ["doc_id", "source"]).select("source", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("x"), F.col(f"c_{c}").alias("y")) for c in _FEATURES])))
    wide = F.abs(F.col("x") - F.col("y")) > 1e-9 * F.greatest(F.lit(1.0), F.abs("x"))
    return both.groupBy("source", "feature").agg(fixed(F.avg("y"), 4).alias("mean_value"), F.count_if(wide).alias("n_clipped"))


# ---------------------------------------------------------------- decisions
@query("threshold_modes", f"""WITH {T.SCORED}, {T.ROC}, t AS (SELECT model, arg_max(threshold, {{'j': tp / np - fp / nn, 't': threshold}}) AS y,
  coalesce(min(threshold) FILTER (fp / nn <= 0.10 AND tp > 0), 0.5) AS l FROM roc GROUP BY ALL)
SELECT model, sensitivity, round(CASE sensitivity WHEN 'strict' THEN l WHEN 'loose' THEN greatest(0.05, 0.75 * y) ELSE y END, 6) AS threshold
FROM t, (SELECT unnest(['strict', 'balanced', 'loose']) AS sensitivity)""")
def threshold_modes(spark, sf_dir):
    from grainscope.operators.learn import threshold_for

    t = E.thresholds(T.scored(spark, sf_dir), ["model"]).withColumn(
        "sensitivity", F.explode(F.array(*[F.lit(s) for s in ("strict", "balanced", "loose")])))
    return t.select("model", "sensitivity", fixed(threshold_for(F.col("youden"), F.col("low_fp"), F.col("sensitivity"))).alias("threshold"))


@query("three_way_verdict", f"""WITH {T.PHOTOS} SELECT model, clip, source, CASE WHEN ml_prob >= threshold THEN 'stego' WHEN ml_prob < 0.9::DOUBLE * threshold THEN 'clean'
  ELSE 'unclear' END AS verdict, count(*) AS n FROM photos GROUP BY ALL""")
def three_way_verdict(spark, sf_dir):
    from grainscope.operators.learn import verdict

    p = T.scored_photos(spark, sf_dir).withColumn("verdict", verdict(F.col("ml_prob"), F.col("threshold")))
    return p.groupBy("model", "clip", "source", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("class_counts", f"""WITH {T.LABELLED} SELECT source, count_if(label = 0) AS n_clean, count_if(label = 1) AS n_stego, count(*) AS n_total FROM lab GROUP BY ALL""")
def class_counts(spark, sf_dir):
    return C.class_counts(T.labelled(spark, sf_dir), ["source"])


@query("distinct_photos", f"""WITH {T.LABELLED} SELECT source, count(DISTINCT photo_id) AS n_photos FROM lab GROUP BY ALL""")
def distinct_photos(spark, sf_dir):
    return C.distinct_photos(T.labelled(spark, sf_dir), ["source"])


@query("method_counts", f"""WITH {T.LABELLED} SELECT method, count(*) AS n FROM lab GROUP BY ALL""")
def method_counts(spark, sf_dir):
    return T.labelled(spark, sf_dir).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@query("toxic_rate_ratio", f"""WITH {T.PRED} SELECT model, toxic, count(*) AS n, round(count_if(pred = 1) / count(*), 6) AS flagged FROM pred GROUP BY ALL""")
def toxic_rate_ratio(spark, sf_dir):
    """Detection rate by a second label of the same rows."""
    p = T.with_threshold(T.scored(spark, sf_dir)).groupBy("model", "toxic").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pred").alias("k"))
    return p.select("model", "toxic", "n", fixed(ratio(F.col("k"), F.col("n"))).alias("flagged"))
