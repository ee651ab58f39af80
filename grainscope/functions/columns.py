"""Small column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def fixed(c: Column, digits: int = 6) -> Column:
    """Round for publication; the added zero turns a negative zero into zero.

    The double itself is scaled and rounded, as engines on IEEE numbers do. ``round(c, digits)`` would round its shortest decimal
    form, which shows 0.31375 for a double whose ten-thousandfold lies below the half.
    """
    scale = F.lit(10.0 ** digits)
    return F.round(c * scale) / scale + F.lit(0.0)


def entropy_bits(total: Column, sum_c_log_c: Column) -> Column:
    """Shannon entropy of counts from two additive sums: log2 T - sum(c log2 c) / T."""
    return F.abs(F.log2(total) - sum_c_log_c / total)


def ratio(num: Column, den: Column) -> Column:
    """num / den as a double, NULL when den is zero."""
    return F.when(den != 0, num.cast("double") / den)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of k successes in n, clipped to [0, 1]; NULL when n = 0."""
    p = ratio(k, n)
    scale = 1.0 + z * z / n
    mid = (p + z * z / (2.0 * n)) / scale
    half = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / scale
    some = n > 0
    return (F.when(some, F.greatest(F.lit(0.0), mid - half)),
            F.when(some, F.least(F.lit(1.0), mid + half)))


def psnr(mean_square_error: Column, peak: float = 255.0) -> Column:
    """Peak signal-to-noise ratio in dB; NULL when the images are equal."""
    return F.when(mean_square_error > 0, 10.0 * F.log10(F.lit(peak * peak) / mean_square_error))


def feature_group(name: Column) -> Column:
    """Feature family by name."""
    from grainscope.schemas import BASE

    return (F.when(name.startswith("srm_"), "SRM 90")
            .when(name.isin(BASE), "BASE 11")
            .when(name.startswith("lsb_prefix_p"), "LSB PREFIX 20")
            .when(name.startswith("prefix_p"), "PREFIX 20")
            .otherwise("TEXTURE/EST 2"))


def feature_subgroup(name: Column) -> Column:
    """Finer families used by the importance report: residual statistics apart."""
    return (F.when(name.startswith("srm_mu_"), "SRM mu (30)")
            .when(name.startswith("srm_absmean_"), "SRM absmean (30)")
            .when(name.startswith("srm_std_"), "SRM std (30)")
            .otherwise(feature_group(name)))


def variant_label(method: Column, p: Column, density: Column) -> Column:
    """Readable variant text, such as ``nsF5 p3 d=0.25`` or ``lsb d=0.50``."""
    code = F.when(p > 0, F.concat(F.lit(" p"), p.cast("string"))).otherwise("")
    return F.concat(method, code, F.lit(" d="), F.format_number(density, 2))


def comparable_group(dataset: Column, protocol: Column) -> Column:
    """Rows may be compared only within one group: same corpus and same photo-held-out protocol."""
    main = (dataset == "bossbase_npz") & F.contains(protocol, F.lit("holdout by source photo"))
    return F.when(main, "A_bossbase_npz_holdout").otherwise("B_other")


def string_keys(c: Column) -> Column:
    """Map keys as strings, the only form JSON keeps."""
    return F.transform_keys(c, lambda k, v: k.cast("string"))


def utf8_bytes(text: Column) -> Column:
    """Bytes of a short text as an array<int> (payload messages; rasters are decoded in Arrow)."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int"))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)
