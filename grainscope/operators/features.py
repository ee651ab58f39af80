"""Feature columns from the additive statistics.

Every feature is a projection of the summary of an image. ``row_summary`` makes it within the image's row;
``image_summary`` folds a table of counts to the same columns, which checks the former independently.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainscope.functions.columns import clip, entropy_bits, ratio
from grainscope.functions.special import chi2_sf_each
from grainscope.operators.residuals import DIVISORS, PREPROCESSORS, moments_of
from grainscope.operators.stats import MIN_PREFIX, PREFIXES, arrow_counts, native_stats, row_summary
from grainscope.schemas import ALL_FEATURES, BASE, FEATURE_SETS, KEY, LSB_PREFIX, PREFIX, RESIDUAL
from grainscope.sources.rasters import BAND_PIXELS

KERNELS = len(DIVISORS)


def gray_histogram(stats: DataFrame) -> DataFrame:
    return (stats.where(F.col("kind") == "hist")
            .groupBy(*KEY, F.col("bin").alias("v")).agg(F.sum("cnt").alias("cnt")))


def image_summary(stats: DataFrame, prefixes: int = PREFIXES, residuals: bool = False) -> DataFrame:
    """One row per image: chi-square sums per prefix, moments, differences, 4-groups.

    Step one folds counts to value pairs (cumulative over prefixes, which needs no window:
    a count of prefix bin k belongs to all prefixes from k on). Step two folds pairs to the
    image. An image has a few thousand counts at most, so placing them by key is even.
    """
    ks = range(1, prefixes + 1)
    hist, diff, rs, res = (F.col("kind") == kind for kind in ("hist", "diff", "rs", "res"))
    bin_, cnt = F.col("bin"), F.col("cnt")
    odd = bin_ % 2 == 1

    def total(condition: Column, value: Column = cnt) -> Column:
        return F.sum(F.when(condition, value).otherwise(0))

    slot_ = F.when(hist, F.expr("bin div 2")).when(res, (F.col("k") - 1) * KERNELS + bin_).otherwise(bin_)
    pairs = stats.repartition(*KEY).groupBy(*KEY, "kind", slot_.alias("slot")).agg(
        *[total(hist & (F.col("k") <= k) & ~odd).alias(f"e{k}") for k in ks],
        *[total(hist & (F.col("k") <= k) & odd).alias(f"o{k}") for k in ks],
        F.sum("cnt").alias("c"), F.sum(cnt * bin_).alias("cv"), F.sum(cnt * bin_ * bin_).alias("cvv"))

    def chi(k: int) -> Column:
        both = F.col(f"e{k}") + F.col(f"o{k}")
        return F.when(hist & (both > 0), F.pow(F.col(f"e{k}") - F.col(f"o{k}"), 2) / both)

    c, slot = F.col("c"), F.col("slot")
    folded = pairs.groupBy(*KEY).agg(
        *[F.coalesce(F.sum(chi(k)), F.lit(0.0)).alias(f"chi{k}") for k in ks],
        *[F.count(chi(k)).cast("int").alias(f"np{k}") for k in ks],
        *[F.sum(f"e{k}").alias(f"zero{k}") for k in ks],
        *[F.sum(f"o{k}").alias(f"one{k}") for k in ks],
        total(hist, c).alias("n_pixels"), total(hist, F.col("cv")).alias("sum_v"),
        total(hist, F.col("cvv")).alias("sum_vv"),
        *[total(rs & (slot == b), c).alias(name)
          for b, name in enumerate(("Rm", "Sm", "Rn", "Sn", "n_groups"))],
        total(diff, c).alias("d_total"), total(diff & (slot % 2 == 1), c).alias("d_odd"),
        F.sum(F.when(diff, c * F.log2(c)).otherwise(0.0)).alias("d_clogc"),
        *[total(res & (slot == i), c).alias(f"res{i}") for i in range(3 * KERNELS if residuals else 0)])
    return folded.select(
        *KEY, *[F.array(*[F.col(f"{stem}{k}") for k in ks]).alias(name)
                for stem, name in (("chi", "chi_stats"), ("np", "n_pairs"),
                                   ("zero", "zeros"), ("one", "ones"))],
        "n_pixels", "sum_v", "sum_vv", "Rm", "Sm", "Rn", "Sn", "n_groups",
        "d_total", "d_odd", "d_clogc", *[c for c in folded.columns if c.startswith("res")])


def summary_of(rasters: DataFrame, producer: str = "arrow", residuals: bool = False, band: int = BAND_PIXELS) -> DataFrame:
    """The summary by the row-local kernel (``arrow``); by the kernel on bands of ``band`` pixels, one after the other where
    the image lies, so that a giant image needs the memory of a band (``banded``); or from counts by expressions (``native``;
    residual sums always come from the kernel)."""
    if producer == "banded":
        summary = row_summary(rasters, residuals, max_pixels=band)
    elif producer == "arrow":
        summary = row_summary(rasters, residuals)
    if producer in ("arrow", "banded"):
        return summary.select("*", *[F.get("res", F.lit(i)).alias(f"res{i}") for i in range(3 * KERNELS if residuals else 0)])
    stats = native_stats(rasters)
    if residuals:
        stats = stats.unionByName(arrow_counts(rasters, ("res",)))
    return image_summary(stats, residuals=residuals)


def last(array: str) -> Column:
    return F.element_at(array, -1)


# Projections of the summary ------------------------------------------------------------
def rs_gap(regular: str, singular: str) -> Column:
    return F.coalesce(ratio(F.col(regular) - F.col(singular), F.col("n_groups")), F.lit(0.0))


def difference_entropy() -> Column:
    return F.when(F.col("d_total") > 0, entropy_bits(F.col("d_total"), F.col("d_clogc"))).otherwise(0.0)


def lsb_difference_entropy() -> Column:
    """Entropy of lowest-bit differences: |a - b| and the XOR of the lowest bits have the
    same parity, so the parity of the difference histogram is enough."""
    def plogp(n: Column) -> Column:
        return F.when(n > 0, n * F.log2(n)).otherwise(0.0)

    odd = F.col("d_odd")
    even = F.col("d_total") - odd
    return F.when(F.col("d_total") > 0,
                  entropy_bits(F.col("d_total"), plogp(odd) + plogp(even))).otherwise(0.0)


def pixel_deviation() -> Column:
    """Population standard deviation; n sum(v^2) - sum(v)^2 is a whole number, nothing cancels."""
    n, s1, s2 = (F.col(c).cast("double") for c in ("n_pixels", "sum_v", "sum_vv"))
    return F.sqrt(F.greatest(n * s2 - s1 * s1, F.lit(0.0))) / n


def deviation_texture() -> Column:
    return clip((pixel_deviation() - 1.2) / 5.8, 0.0, 1.0)


def chi_rate(chi_p: Column, median_p: Column) -> Column:
    """Embedding-rate estimate from the chi-square p-values."""
    return clip(1.0 - 2.0 * F.least(chi_p, median_p), 0.0, 1.0)


def lsb_prefix_ps() -> Column:
    """exp(-chi/2) of lowest-bit counts against an even split, per prefix."""
    def p(c: Column) -> Column:
        half = (c["zeros"] + c["ones"]) / 2.0
        return F.exp(-(F.pow(c["zeros"] - half, 2) + F.pow(c["ones"] - half, 2)) / half / 2.0)

    return F.transform(F.arrays_zip("zeros", "ones"), p)


def with_p_values(summary: DataFrame) -> DataFrame:
    """Add ``tails``: chi-square p per prefix, NULL where a prefix has fewer than two pairs.

    Such a prefix counts as 1 in the whole-image and median p (``prefix_ps``) and as 0 in
    the 20 prefix columns. A row summary has them already.
    """
    tails = F.col("tails") if "tails" in summary.columns else chi2_sf_each(F.col("chi_stats"), F.transform("n_pairs", lambda n: n - 1))
    return (summary.withColumn("tails", tails)
            .withColumn("prefix_ps", F.transform("tails", lambda p: F.coalesce(p, F.lit(1.0))))
            .withColumn("chi2_pvalue", last("prefix_ps"))
            .withColumn("median_prefix_p", median_of_sorted(F.array_sort("prefix_ps"))))


def median_of_sorted(a: Column) -> Column:
    return (F.element_at(a, PREFIXES // 2) + F.element_at(a, PREFIXES // 2 + 1)) / 2.0


def with_base_columns(summary: DataFrame) -> DataFrame:
    """Add the 11 columns to the summary."""
    return with_p_values(summary).withColumns({
        "chi2_stat": last("chi_stats"),
        "RS_Gr": rs_gap("Rm", "Sm"), "RS_Gn": rs_gap("Rn", "Sn"),
        "diff_entropy": difference_entropy(), "lsb_diff_entropy": lsb_difference_entropy()})


def base_features(rasters: DataFrame, producer: str = "arrow") -> DataFrame:
    """The 11 columns, one row per image, plus the array of prefix p-values."""
    return with_base_columns(summary_of(rasters, producer)).select(*KEY, *BASE, "prefix_ps")


def hashed_base_features(rasters: DataFrame, keep: Sequence[str] = KEY) -> DataFrame:
    """The 11 columns and the content hash, from one pass over the pixels, beside the columns ``keep``."""
    return with_base_columns(row_summary(rasters, keep=keep)).select(*keep, *BASE, "prefix_ps", "image_sha256")


def prefix_columns() -> list[Column]:
    """The 20 + 20 prefix columns; images below 64 pixels have 1 throughout."""
    tiny = F.col("n_pixels") < MIN_PREFIX
    pairs = F.transform("tails", lambda p: F.coalesce(p, F.lit(0.0)))
    return ([F.when(tiny, 1.0).otherwise(F.element_at(pairs, k)).alias(n) for k, n in enumerate(PREFIX, 1)]
            + [F.when(tiny, 1.0).otherwise(F.element_at("lsb_ps", k)).alias(n)
               for k, n in enumerate(LSB_PREFIX, 1)])


def wide_features(summary: DataFrame) -> DataFrame:
    """The 53 columns that need no residuals, beside the summary."""
    f = with_base_columns(summary).withColumns({
        "lsb_ps": lsb_prefix_ps(), "texture_noise": deviation_texture(),
        "est_rate": chi_rate(F.col("chi2_pvalue"), F.col("median_prefix_p"))})
    return f.select("*", *prefix_columns())


def interpretable_features(rasters: DataFrame, producer: str = "arrow") -> DataFrame:
    """The 53 columns that need no residuals, one row per image."""
    return wide_features(summary_of(rasters, producer)).select(
        *KEY, *FEATURE_SETS["53d"])


def residual_columns() -> list[Column]:
    """The 90 residual columns from the sums in the summary."""
    out = {}
    for c in range(KERNELS):
        sums = (F.col(f"res{k * KERNELS + c}") for k in range(3))
        for stat, m in moments_of(F.col("n_pixels"), *sums, F.lit(DIVISORS[c])).items():
            out[f"srm_{stat}_c{c}"] = m
    return [out[name].alias(name) for name in RESIDUAL]


def full_features(rasters: DataFrame, producer: str = "arrow", band: int = BAND_PIXELS) -> DataFrame:
    """All 143 columns, one row per image, from one pass over the pixels, without an exchange."""
    f = wide_features(summary_of(rasters, producer, residuals=True, band=band)).select("*", *residual_columns())
    return f.select(*KEY, *[F.col(c).cast("double").alias(c) for c in ALL_FEATURES])


def features_of(summary: DataFrame) -> DataFrame:
    """All 143 columns beside what a row summary with residual sums carries along."""
    sums = summary.select("*", *[F.get("res", F.lit(i)).alias(f"res{i}") for i in range(3 * KERNELS)])
    f = wide_features(sums).select("*", *residual_columns())
    return f.withColumns({c: F.col(c).cast("double") for c in ALL_FEATURES})


FEATURIZERS = {
    "v1": lambda rasters, producer="arrow": base_features(rasters, producer).drop("prefix_ps"),
    "v2": full_features,
}


def featurize(rasters: DataFrame, feature_set: str = "v1", preprocess: str = "none",
              producer: str = "arrow") -> DataFrame:
    """Features by registry name; the 11 columns may be taken of the residual-enhanced image."""
    shaped = PREPROCESSORS[preprocess if feature_set == "v1" else "none"](rasters)
    return FEATURIZERS[feature_set](shaped, producer)
