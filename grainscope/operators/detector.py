"""Blind detector: rules as column expressions over the 11 base columns, and a fitted model beside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainscope.functions.columns import clip, sigmoid
from grainscope.operators.corpus import require_features
from grainscope.operators.features import base_features, features_of, hashed_base_features
from grainscope.operators.geometry import WORK_SIDE, resize
from grainscope.operators.learn import scored, threshold_for, verdict
from grainscope.operators.stats import row_summary
from grainscope.operators.variants import coded_pairs
from grainscope.schemas import KEY, PHOTO, sensitivity_table
from grainscope.sources.models import Artefact
from grainscope.sources.rasters import bytes_from_pixels

# Expected gap of a clean structured image, and the regular-gap counterpart.
CLEAN_GN = 0.62
CLEAN_GR = 0.72


def entropy_texture(diff_entropy: Column) -> Column:
    """Content texture in [0, 1] from the difference entropy."""
    return clip((diff_entropy - 1.2) / 5.8, 0.0, 1.0)


def collapse_signal(gn: Column, tex: Column) -> Column:
    """How far the gap fell below what a clean image of this texture shows."""
    expected = CLEAN_GN * (1.0 - 0.8 * tex) + 0.06 * tex
    drop = F.greatest(F.lit(0.0), (expected - gn) / F.greatest(expected, F.lit(1e-3)))
    return sigmoid((drop - (0.34 + 0.20 * tex)) / 0.12)


def chi_signal(median_p: Column, tex: Column) -> Column:
    return clip((median_p - 0.35) / 0.5, 0.0, 1.0) * F.pow(1.0 - tex, 2)


def gap_rate(gn: Column, gr: Column) -> Column:
    """Embedding-rate estimate from the two gaps."""
    def short(value: Column, clean: float) -> Column:
        return F.greatest(F.lit(0.0), (clean - value) / clean)

    return clip(0.55 * short(gn, CLEAN_GN) + 0.45 * short(gr, CLEAN_GR), 0.0, 1.0)


def with_signals(features: DataFrame) -> DataFrame:
    """Add texture, both signals, the rate estimate, the raw probability and the abstention."""
    return (features.withColumn("texture_h", entropy_texture(F.col("diff_entropy")))
            .withColumn("s_rs", collapse_signal(F.col("RS_Gn"), F.col("texture_h")))
            .withColumn("s_chi", chi_signal(F.col("median_prefix_p"), F.col("texture_h")))
            .withColumn("rate_rs", gap_rate(F.col("RS_Gn"), F.col("RS_Gr")))
            .withColumn("raw", F.greatest("s_rs", "s_chi"))
            .withColumn("lsb_random", clip((F.col("lsb_diff_entropy") - 0.90) / 0.08, 0.0, 1.0))
            .withColumn("abstain", F.when(F.col("texture_h") >= 0.55, "noisy content")
                        .when(F.col("lsb_random") > 0, "random low bits"))
            .withColumn("prob", calibrated()))


def calibrated() -> Column:
    tex, raw = F.col("texture_h"), F.col("raw")
    decided = clip(0.04 + 0.96 * raw, 0.0, 1.0)
    calm = (tex < 0.35) & (F.col("RS_Gn") / CLEAN_GN > 0.82) & (F.col("median_prefix_p") < 0.1)
    return (F.when(tex >= 0.55, clip(0.5 + 0.10 * raw, 0.5, 0.62))
            .when(F.col("lsb_random") > 0, clip(0.5 + 0.12 * F.col("lsb_random") * raw, 0.5, 0.62))
            .when(calm, F.least(decided, F.lit(0.15))).otherwise(decided))


def with_verdict(signals: DataFrame, sensitivity: str | None = "balanced") -> DataFrame:
    """Join the sensitivity rows; thresholds apply to ``prob``, the reported value is pulled
    around one half. ``sensitivity=None`` gives a row per setting."""
    levels = sensitivity_table(signals.sparkSession)
    if sensitivity is not None:
        levels = levels.where(F.col("sensitivity") == sensitivity)
    pulled = clip(0.5 + (F.col("prob") - 0.5) * F.col("pull"), 0.0, 1.0)
    verdict = (F.when(F.col("abstain").isNotNull(), F.concat(F.lit("undecidable: "), F.col("abstain")))
               .when(F.col("prob") >= F.col("thr_high"), "very likely stego")
               .when(F.col("prob") >= F.col("thr_possible"), "possibly stego")
               .otherwise("unlikely stego"))
    return (signals.crossJoin(F.broadcast(levels))
            .withColumn("stego_probability", pulled).withColumn("verdict", verdict)
            .drop("thr_possible", "thr_high", "pull"))


def blind_scan(rasters: DataFrame, sensitivity: str | None = "balanced",
               producer: str = "arrow", keep: Sequence[str] = KEY) -> DataFrame:
    """Statistics, probability and verdict for every image, with the content hash. ``keep`` (``arrow`` only) names the
    columns that come along."""
    if producer == "arrow":
        return with_verdict(with_signals(hashed_base_features(rasters, keep)), sensitivity)
    hashes = bytes_from_pixels(rasters.select(*KEY, "px")).select(
        *KEY, F.sha2("content", 256).alias("image_sha256"))
    return with_verdict(with_signals(base_features(rasters, producer)), sensitivity).join(hashes, KEY)


#: The model's part of a scan: NULL numbers and the reason when no model could be used.
ML = "struct<available: boolean, name: string, probability: double, threshold: double, verdict: string, error: string>"


def model_block(features: DataFrame, artefact: Artefact | None, sensitivity: str = "balanced", clip_outliers: bool = False,
                keep: Sequence[str] = KEY) -> DataFrame:
    """``keep`` and the struct ``ml``: probability by the artefact, threshold by sensitivity, and the verdict.

    ``features`` has the artefact's columns; they are clipped to its bounds on request. Without a usable artefact all
    numbers are NULL and ``error`` says why; no row is lost.
    """
    if artefact is None or not artefact.available:
        why = artefact.status if artefact else "no model"
        return features.select(*keep, F.lit(None).cast("double").alias("_p")).select(*keep, F.struct(
            F.lit(False).alias("available"), F.lit(artefact.name if artefact else None).cast("string").alias("name"),
            F.col("_p").alias("probability"), F.col("_p").alias("threshold"), F.lit(None).cast("string").alias("verdict"),
            F.lit(why).alias("error")).cast(ML).alias("ml"))
    require_features(features, artefact.features, artefact.name)
    if clip_outliers:
        features = features.withColumns({c: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))
                                         for c, (lo, hi) in artefact.bounds.items()})
    threshold = threshold_for(F.lit(artefact.threshold), F.lit(artefact.threshold_low_fp).cast("double"), F.lit(sensitivity))
    p = F.col("_prob")
    return scored(artefact.model, features, "_prob").select(*keep, F.struct(
        F.lit(True).alias("available"), F.lit(artefact.name).alias("name"), p.alias("probability"), threshold.alias("threshold"),
        verdict(p, threshold).alias("verdict"), F.lit(None).cast("string").alias("error")).cast(ML).alias("ml"))


def model_scan(rasters: DataFrame, artefact: Artefact | None, sensitivity: str = "balanced", clip_outliers: bool = False,
               side: int = WORK_SIDE) -> DataFrame:
    """``blind_scan`` with the struct ``ml`` beside it, without an exchange.

    The rules judge the image as it is. The model judges the square gray image of ``side`` pixels that its training images
    were made to; both stay in one row, so nothing is joined. Images without pixels have no row.
    """
    judged = blind_scan(rasters, sensitivity, keep=[*KEY, "height", "width", "px"])
    if artefact is None or not artefact.available:
        return model_block(judged.drop("height", "width", "px"), artefact, sensitivity,
                           keep=[c for c in judged.columns if c not in ("height", "width", "px")])
    names = [c for c in judged.columns if c not in ("height", "width", "px")]
    held = judged.select(F.struct(*names).alias("_scan"), *KEY, "height", "width", "px")
    summary = row_summary(resize(held, side), residuals=True, keep=["_scan", *KEY])
    return model_block(features_of(summary), artefact, sensitivity, clip_outliers, ["_scan"]).select("_scan.*", "ml")


def payload_curve(covers: DataFrame, densities: DataFrame, producer: str = "arrow", artefact: Artefact | None = None,
                  sensitivity: str = "balanced", side: int = WORK_SIDE) -> DataFrame:
    """Observables of every cover at every payload density; density 0 is the cover itself.

    ``densities`` has columns variant, method, p, density. ``ml_probability`` is NULL without a model.
    """
    zero = F.col("density") <= 1e-9
    coded = coded_pairs(covers, densities.where(~zero)).select(
        *PHOTO, F.col("to_variant").alias("variant"), "density", "height", "width", F.col("coded").alias("px"))
    plain = covers.drop("variant").crossJoin(F.broadcast(densities.where(zero).select("variant", "density")))
    every = coded.unionByName(plain.select(*coded.columns))
    if producer == "arrow":
        judged = model_scan(every, artefact, sensitivity, side=side)
    else:
        judged = with_verdict(with_signals(base_features(every, producer))).withColumn("ml", F.lit(None).cast(ML))
    names = densities.select("variant", "density")
    return judged.join(F.broadcast(names), "variant").select(
        *PHOTO, "density", "chi2_pvalue", (F.col("rate_rs") * 100.0).alias("rs_rate"), "stego_probability",
        F.col("ml.probability").alias("ml_probability"))
