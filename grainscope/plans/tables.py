"""Scored and labelled tables derived from documents and their labels.

``scored``: one row per labelled document and model; the label is its quality, the score a
text statistic rounded to four places (so ties occur). ``labelled``: all documents arranged
as photos of 14 variants each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainscope.functions.columns import fixed
from grainscope.plans.sqltext import variant_rows
from grainscope.schemas import variant_table

THRESHOLDS = {"143d": 0.355, "53d": 0.165}


def share(pattern: str) -> Column:
    """Share of a text's characters that match, rounded to four places."""
    return fixed(1.0 - F.length(F.regexp_replace("text", pattern, "")) / F.length("text"), 4)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") > 0).select(
        "doc_id", "source", "lang", "n_chars", share("[aeiou]").alias("score_a"), share("[ ]").alias("score_b"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    d = documents(spark, sf_dir).join(labels, "doc_id").withColumnRenamed("quality", "label")
    return d.select("doc_id", "source", "label", "toxic", F.inline(F.array(
        F.struct(F.lit("143d").alias("model"), F.col("score_a").alias("score")),
        F.struct(F.lit("53d").alias("model"), F.col("score_b").alias("score")))))


def with_threshold(df: DataFrame) -> DataFrame:
    t = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])
    return df.withColumn("threshold", t[F.col("model")]).withColumn(
        "pred", (F.col("score") >= F.col("threshold")).cast("int"))


def scored_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean-photo evaluation rows: model, clip, source, photo, ml_prob, threshold, pred_stego."""
    d = documents(spark, sf_dir)
    rows = d.select("source", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("photo_name"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(clip).alias("clip"), (F.least(F.col(c), F.lit(cap)) if clip else F.col(c)).alias("ml_prob"),
                 F.lit(THRESHOLDS[m]).alias("threshold"))
        for m, c, cap in (("143d", "score_a", 0.36), ("53d", "score_b", 0.17)) for clip in (False, True)])))
    return rows.withColumn("pred_stego", (F.col("ml_prob") >= F.col("threshold")).cast("int"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as photos with variants clean, clean_jpeg, v0..v11 and coding metadata."""
    slot = F.col("doc_id") % 14
    d = documents(spark, sf_dir).select(
        F.concat(F.lit("set"), (F.expr("doc_id div 14") % 3).cast("string")).alias("source"),
        F.expr("doc_id div 14").alias("photo_id"),
        F.when(slot == 0, "clean").when(slot == 1, "clean_jpeg").otherwise(
            F.concat(F.lit("v"), (slot - 2).cast("string"))).alias("variant"),
        (slot >= 2).cast("int").alias("label"), F.col("n_chars").cast("double").alias("f_chars"),
        F.col("score_a").alias("f_vowels"), F.col("score_b").alias("f_spaces"))
    return d.join(F.broadcast(variant_table(spark, "all")), "variant", "left")


# ---------------------------------------------------------------- the same tables in SQL
def _share(pattern: str) -> str:
    return f"round(1.0 - length(regexp_replace(text, '{pattern}', '', 'g')) / CAST(length(text) AS DOUBLE), 4)"


DOCS = f"""docs AS (SELECT doc_id, source, lang, n_chars, {_share('[aeiou]')} AS score_a, {_share('[ ]')} AS score_b
  FROM documents WHERE length(text) > 0)"""

SCORED = f"""{DOCS},
scored AS (SELECT doc_id, source, quality AS label, toxic, unnest(['143d', '53d']) AS model, unnest([score_a, score_b]) AS score
           FROM docs JOIN labels USING (doc_id))"""

PRED = f"""{SCORED}, pred AS (SELECT *, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS pred FROM (
  SELECT *, CASE WHEN model = '143d' THEN {THRESHOLDS['143d']}::DOUBLE ELSE {THRESHOLDS['53d']}::DOUBLE END AS threshold FROM scored))"""

PHOTOS = f"""{DOCS}, photos AS (SELECT *, CASE WHEN ml_prob >= threshold THEN 1 ELSE 0 END AS pred_stego FROM (
  SELECT source, 'doc' || doc_id AS photo_name, unnest(['143d', '143d', '53d', '53d']) AS model, unnest([false, true, false, true]) AS clip,
         unnest([score_a, least(score_a, 0.36::DOUBLE), score_b, least(score_b, 0.17::DOUBLE)]) AS ml_prob,
         unnest([{THRESHOLDS['143d']}::DOUBLE, {THRESHOLDS['143d']}::DOUBLE, {THRESHOLDS['53d']}::DOUBLE, {THRESHOLDS['53d']}::DOUBLE]) AS threshold FROM docs))"""

LABELLED = f"""{DOCS}, {variant_rows()}, lab AS (SELECT l.*, method, p, density FROM (
  SELECT 'set' || ((doc_id // 14) % 3) AS source, doc_id // 14 AS photo_id,
         CASE doc_id % 14 WHEN 0 THEN 'clean' WHEN 1 THEN 'clean_jpeg' ELSE 'v' || (doc_id % 14 - 2) END AS variant,
         CASE WHEN doc_id % 14 >= 2 THEN 1 ELSE 0 END AS label, CAST(n_chars AS DOUBLE) AS f_chars, score_a AS f_vowels, score_b AS f_spaces
  FROM docs) AS l LEFT JOIN var USING (variant))"""

# ROC points of pred per model: threshold, tp, fp, tpr, fpr
ROC = """cnt AS (SELECT model, score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS neg
         FROM scored GROUP BY ALL),
roc AS (SELECT model, score AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(neg) OVER (PARTITION BY model) AS nn,
               sum(pos) OVER (PARTITION BY model) AS np, pos, neg FROM cnt WINDOW w AS (PARTITION BY model ORDER BY score DESC))"""
