"""Canonical results table: typed rows per (corpus, protocol, model, subject, metric)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainscope.schemas import RESULT_COLUMNS

# Corpus ids in report order, with label and dataset file.
CORPORA = [
    ("bossbase_npz", "BOSSbase 1.01 subset", "dataset_bossbase_npz_v2.csv", True),
    ("bossbase_csv", "BOSSbase 1.01 full", "dataset_bossbase.csv", False),
    ("merged_campus_bossbase", "campus and BOSSbase merged", "imageset", False),
    ("campus_v2_jpeg", "campus photos with recompressed clean rows", "dataset_campus_v2_jpeg.csv", False),
    ("campus_imageset", "campus photo image set", "imageset_photobase", False),
    ("campus_v1", "campus photos, first version", "dataset.csv", False),
    ("ood_real_jpeg", "clean photos from other sources", "ood photos", False),
]
# Protocol ids in report order.
PROTOCOLS = [
    ("holdout_by_photo", "held out by source photo"),
    ("holdout_by_photo_seed0", "held out by source photo, quarter of photos, seed 0"),
    ("holdout_by_photo_8seed", "held out by source photo, mean of seeds 0 to 7"),
    ("groupkfold8_oof", "out of fold, 8 folds by photo"),
    ("groupkfold5_oof_3seed", "out of fold, 5 folds by photo, mean of 3 seeds"),
    ("groupkfold5_oof_8seed", "out of fold, 5 folds by photo, mean of 8 seeds"),
    ("groupkfold5_oof", "out of fold, 5 folds by photo"),
    ("cnn_holdout_tta5", "held out by source photo, mean of 5 crops"),
    ("ood_clean_fp", "false positives on clean photos, Wilson 95% interval"),
    ("gpu_pipeline_lr", "held out by source photo, 80/20, logistic regression"),
    ("train_model_holdout", "held out by source photo, stacked out-of-fold models"),
    ("none", "unknown"),
]


def corpora(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CORPORA)],
                                 "corpus_rank int, corpus string, corpus_label string, dataset_file string, headline boolean")


def protocols(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PROTOCOLS)],
                                 "protocol_rank int, protocol_id string, protocol string")


def unknown_keys(rows: DataFrame) -> DataFrame:
    """Rows whose corpus or protocol is not registered, with the reason."""
    spark = rows.sparkSession
    no_corpus = rows.join(F.broadcast(corpora(spark)), "corpus", "left_anti").withColumn("reason", F.lit("corpus"))
    no_protocol = rows.join(F.broadcast(protocols(spark)), "protocol_id", "left_anti").withColumn(
        "reason", F.lit("protocol"))
    return no_corpus.unionByName(no_protocol)


def metric_rows(table: DataFrame, keep: dict[str, Column], metrics: Sequence[str]) -> DataFrame:
    """Unpivot metric columns into (.., metric, value) rows; missing values give no row."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return (table.select(*[c.alias(n) for n, c in keep.items()], F.inline(pairs))
            .where(F.col("value").isNotNull()))


def union_sources(*tables: DataFrame) -> DataFrame:
    """Stack result rows of different producers; columns a producer lacks become NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def canonical(rows: DataFrame, check: bool = True) -> DataFrame:
    """Attach registry labels, complete the columns and sort in registry order.

    With ``check``, a row whose corpus or protocol is not registered ends the job that reads the result (``unknown_keys`` lists
    such rows); without, it has NULL labels left out by the join. The test is part of the one reading.
    """
    spark = rows.sparkSession
    how = "left" if check else "inner"
    labelled = (rows.drop("corpus_label", "dataset_file", "protocol")
                .join(F.broadcast(corpora(spark).drop("headline")), "corpus", how)
                .join(F.broadcast(protocols(spark)), "protocol_id", how))
    if check:
        for rank, key in (("corpus_rank", "corpus"), ("protocol_rank", "protocol_id")):
            labelled = labelled.withColumn(rank, F.when(F.col(rank).isNotNull(), F.col(rank)).otherwise(F.raise_error(
                F.concat(F.lit(f"results rows name an unregistered {key}: "), F.coalesce(key, F.lit("NULL")))).cast("int")))
    missing = [c for c in RESULT_COLUMNS if c not in labelled.columns]
    full = labelled.withColumns({c: F.lit(None).cast("string") for c in missing})
    return (full.orderBy("corpus_rank", "protocol_rank", "model", "metric", "subject")
            .select(*RESULT_COLUMNS))


def untraceable(claims: DataFrame, produced: DataFrame, key: Sequence[str]) -> DataFrame:
    """Claims no producer reproduced, marked as such."""
    return claims.join(produced.select(*key).distinct(), list(key), "left_anti").withColumn(
        "traceable", F.lit("no"))


def aliased(rows: DataFrame, alias: DataFrame, column: str) -> DataFrame:
    """Replace alias names by their canonical name. ``alias`` is a hand-kept table."""
    names = alias.select(F.col("alias").alias(column), "canonical")
    return rows.join(names, column, "left").withColumn(
        column, F.coalesce("canonical", column)).drop("canonical")


def differences(published: DataFrame, recomputed: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """Rows that differ between a published and a recomputed table, missing ones included."""
    a = published.select(*key, F.col(value).alias("published"), F.lit(True).alias("_a"))
    b = recomputed.select(*key, F.col(value).alias("recomputed"), F.lit(True).alias("_b"))
    joined = a.join(b, list(key), "full_outer")
    problem = (F.when(F.col("_b").isNull(), "not recomputed").when(F.col("_a").isNull(), "not published")
               .when(~F.equal_null("published", "recomputed"), "different"))
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull()).drop("_a", "_b")


def stale(published: DataFrame, recomputed: DataFrame, key: Sequence[str], tolerance: float = 5e-4,
          value: str = "value") -> DataFrame:
    """Published values further than the tolerance from their recomputation."""
    both = published.select(*key, F.col(value).alias("published")).join(
        recomputed.select(*key, F.col(value).alias("recomputed")), list(key))
    return both.where(F.abs(F.col("published") - F.col("recomputed")) > tolerance)


def missing_sweeps(metrics: DataFrame, column: str = "auc_8split_mean") -> DataFrame:
    """Models whose multi-seed value was never produced."""
    return metrics.where(F.col(column).isNull())


def replay_checks(records: DataFrame, recomputed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Compare experiment records with recomputed variants: one row per record and check.

    Both sides carry cover_sha256, message_sha256, changed_cells and stego_sha256. ``all_ok``
    repeats the record's overall outcome on each of its rows (four per record).
    """
    names = ["cover_sha256", "message_sha256", "changed_cells", "stego_sha256"]
    a = records.select(*key, *[F.col(c).cast("string").alias(f"e_{c}") for c in names])
    b = recomputed.select(*key, *[F.col(c).cast("string").alias(f"r_{c}") for c in names])
    joined = a.join(b, list(key), "left")
    ok = {c: F.equal_null(f"e_{c}", f"r_{c}") for c in names}
    every = ok[names[0]] & ok[names[1]] & ok[names[2]] & ok[names[3]]
    return joined.select(*key, every.alias("all_ok"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("check"), F.col(f"e_{c}").alias("expected"), F.col(f"r_{c}").alias("actual"),
                 ok[c].alias("ok")) for c in names])))


def with_detector_block(records: DataFrame, scans: DataFrame, key: Sequence[str]) -> DataFrame:
    """Attach the detector's findings to records; records without a scan keep NULL. Scans with a model's struct ``ml`` add its
    probability and verdict, or that there was none."""
    fields = ["chi2_stat", "chi2_pvalue", "RS_Gn", "RS_Gr", F.col("rate_rs").alias("est_rate"), "stego_probability", "verdict", "sensitivity"]
    if "ml" in scans.columns:
        fields += [F.col("ml.available").alias("ml_available"), F.col("ml.probability").alias("ml_probability"), F.col("ml.verdict").alias("ml_verdict")]
    return records.join(scans.select(*key, F.struct(*fields).alias("detector")), list(key), "left")
