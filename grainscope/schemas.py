"""Table schemas, feature names and the fixed dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# One image, or one labelled version of it. A bare photo_id is not an identity:
# two sources may number their photos alike.
KEY = ["source", "photo_id", "variant"]
PHOTO = ["source", "photo_id"]

RASTER = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("photo_id", T.LongType(), False),
    T.StructField("variant", T.StringType(), False),
    T.StructField("height", T.IntegerType(), False),
    T.StructField("width", T.IntegerType(), False),
    T.StructField("px", T.ArrayType(T.ShortType(), False), False),
])

# Feature names and their order.
BASE = ["Rm", "Sm", "Rn", "Sn", "RS_Gr", "RS_Gn", "chi2_pvalue", "diff_entropy",
        "lsb_diff_entropy", "median_prefix_p", "chi2_stat"]
RESIDUAL = [f"srm_{stat}_c{c}" for stat in ("mu", "absmean", "std") for c in range(30)]
PREFIX = [f"prefix_p{k}" for k in range(1, 21)]
LSB_PREFIX = [f"lsb_prefix_p{k}" for k in range(1, 21)]
EXTRA = ["texture_noise", "est_rate"]
ALL_FEATURES = BASE + RESIDUAL + PREFIX + EXTRA + LSB_PREFIX

FEATURE_SETS = {
    "11d": BASE,
    "31d": BASE + PREFIX,
    "51d": BASE + PREFIX + LSB_PREFIX,
    "53d": BASE + PREFIX + EXTRA + LSB_PREFIX,
    "143d": ALL_FEATURES,
}

META = ["source", "label", "photo_id", "variant", "method", "p", "density",
        "changed_frac", "basename"]

LABELLED_META = T.StructType([
    T.StructField("label", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("photo_id", T.LongType()),
    T.StructField("variant", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("p", T.IntegerType()),
    T.StructField("density", T.DoubleType()),
    T.StructField("changed_frac", T.DoubleType()),
])

VARIANT = T.StructType([
    T.StructField("variant", T.StringType(), False),
    T.StructField("method", T.StringType(), False),
    T.StructField("p", T.IntegerType(), False),
    T.StructField("density", T.DoubleType(), False),
])

# The variant dimension (coding method, code parameter, share of capacity).
VARIANTS = [
    ("v0", "nsF5", 3, 0.25),
    ("v1", "nsF5", 3, 0.40),
    ("v2", "nsF5", 3, 0.55),
    ("v3", "nsF5", 2, 0.35),
    ("v4", "nsF5", 2, 0.85),
    ("v5", "matrix", 3, 0.50),
    ("v6", "matrix", 2, 0.80),
    ("v7", "lsb", 0, 0.50),
    ("v8", "matrix", 3, 0.40),
    ("v9", "matrix", 3, 0.60),
    ("v10", "lsb", 0, 0.30),
    ("v11", "lsb", 0, 0.70),
]

# The presets that hold each variant.
PRESETS_OF = {
    "v0": ["default", "minimal", "all"],
    "v1": ["default", "all"],
    "v2": ["default", "minimal", "all"],
    "v3": ["default", "minimal", "all"],
    "v4": ["default", "minimal", "all"],
    "v5": ["default", "minimal", "all"],
    "v6": ["default", "minimal", "all"],
    "v7": ["default", "all"],
    "v8": ["all"],
    "v9": ["all"],
    "v10": ["all"],
    "v11": ["all"],
}

# Detector sensitivity (thresholds possible / high, pull around one half).
SENSITIVITY = [
    ("strict", 0.50, 0.80, 0.85),
    ("balanced", 0.40, 0.70, 1.00),
    ("loose", 0.30, 0.60, 1.18),
]

# Image file extensions that are scanned.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "tif", "tiff", "pgm"]

SCORED = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("clip", T.BooleanType()),
    T.StructField("source", T.StringType()),
    T.StructField("photo_path", T.StringType()),
    T.StructField("photo_name", T.StringType()),
    T.StructField("ml_prob", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("pred_stego", T.IntegerType()),
])

RESULT_COLUMNS = ["corpus", "corpus_label", "dataset_file", "protocol_id", "protocol",
                  "model", "subject", "family", "feat_set", "n_features", "n_samples",
                  "n_photos", "metric", "value", "ci_lo", "ci_hi", "ci_method",
                  "source_file", "traceable", "producer", "note"]

_CHECK = T.StructType([
    T.StructField("sha256", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("size", T.ArrayType(T.IntegerType())),
    T.StructField("format", T.StringType()),
])

# Experiment record as stored in JSON, one object per line or document.
RECORD = T.StructType([
    T.StructField("schema", T.StringType()),
    T.StructField("created_utc", T.TimestampType()),
    T.StructField("tool", T.MapType(T.StringType(), T.StringType())),
    T.StructField("algorithm", T.StructType([
        T.StructField("domain", T.StringType()), T.StructField("method", T.StringType()),
        T.StructField("hamming_p", T.IntegerType()),
        T.StructField("password_used", T.BooleanType())])),
    T.StructField("payload", T.StructType([
        T.StructField("bits", T.LongType()), T.StructField("chars", T.LongType()),
        T.StructField("message_sha256", T.StringType())])),
    T.StructField("cover", _CHECK),
    T.StructField("stego", _CHECK),
    T.StructField("result", T.StructType([
        T.StructField("changed_cells", T.LongType()),
        T.StructField("cell_unit", T.StringType()),
        T.StructField("changed_ratio", T.DoubleType()),
        T.StructField("capacity_bits", T.LongType()),
        T.StructField("truncated", T.BooleanType())])),
    T.StructField("determinism", T.StringType()),
    T.StructField("detector", T.MapType(T.StringType(), T.StringType())),
])


def variant_table(spark: SparkSession, preset: str = "default") -> DataFrame:
    """Variant dimension. ``default`` has 8 rows, ``minimal`` 6, ``all`` 12."""
    return spark.createDataFrame([v for v in VARIANTS if preset in PRESETS_OF[v[0]]], VARIANT)


def sensitivity_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SENSITIVITY, "sensitivity string, thr_possible double, thr_high double, pull double")
