"""Stores written between jobs: rasters, labelled datasets, metrics, splits, models, records."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainscope.operators.corpus import feature_columns
from grainscope.schemas import LABELLED_META, RECORD
from grainscope.sources.images import file_system
from grainscope.sources.rasters import bytes_from_pixels, pixels_from_bytes

def write_rasters(rasters: DataFrame, path: str, mode: str = "append") -> None:
    """Raster store: Parquet with one byte per pixel and their number, partitioned by source."""
    bytes_from_pixels(rasters.withColumn("n_px", F.size("px"))).write.mode(mode).partitionBy("source").parquet(path)


def read_rasters(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Read a raster store back. An image whose bytes do not match the stored number, or do not fill all rows but
    the last, ends the job that reads it; the test is part of the one reading."""
    stored = spark.read.parquet(path)
    rows_but_last = (F.col("height").cast("long") - 1) * F.col("width")
    whole = (F.octet_length("content") == F.col("n_px")) & (F.col("n_px") > rows_but_last) & (
        F.col("n_px") <= rows_but_last + F.col("width"))
    if check:
        stored = stored.withColumn("content", F.when(whole, F.col("content")).otherwise(F.raise_error(
            F.lit("raster store holds an image whose pixel count differs from its size"))))
    return pixels_from_bytes(stored.drop("n_px"))


def write_dataset(df: DataFrame, path: str, csv: bool = False) -> None:
    """Labelled dataset as Parquet, or as CSV with a header for exchange."""
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if csv else writer.parquet(path)


def read_dataset_csv(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """CSV dataset with an explicit schema; empty metadata of clean rows becomes NULL."""
    meta = [f for f in LABELLED_META.fields]
    schema = T.StructType([T.StructField(f, T.DoubleType()) for f in features] + meta)
    return spark.read.option("header", "true").option("enforceSchema", "false").schema(schema).csv(path)


def drop_incomplete(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    return df.dropna(subset=features or feature_columns(df))


def append_metrics(df: DataFrame, path: str, producer: str) -> None:
    """Append-only metrics table; each run adds its producer and time."""
    (df.withColumn("producer", F.lit(producer)).withColumn("ran_at", F.current_timestamp())
     .write.mode("append").parquet(path))


def register_split(split: DataFrame, path: str, corpus: str, seed: int) -> DataFrame:
    """Write a split once. The first writer of (corpus, seed) wins; later callers get its rows.

    Each split is a folder of its own, so that a reader opens no other. A writer makes a draft under a name of its own and
    publishes it by a rename that must not find the target; who comes second drops the draft. So there is no moment at
    which a split is half there, and a writer that dies leaves a draft that nobody reads.
    """
    spark = split.sparkSession
    fs, folder = file_system(spark, f"{path}/corpus={quote(corpus, safe='')}/seed={int(seed)}")
    rows, draft = (spark._jvm.org.apache.hadoop.fs.Path(folder, name) for name in ("rows", f"_draft-{uuid.uuid4().hex}"))
    if not fs.exists(rows):
        split.write.parquet(draft.toString())
        kinds = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        fresh = spark.sparkContext._gateway.new_array(kinds, 1)
        fresh[0] = kinds.NONE
        try:
            spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, rows, fresh)
        except Py4JJavaError:           # somebody else was first
            fs.delete(draft, True)
            if not fs.exists(rows):
                raise
    return spark.read.parquet(rows.toString()).select(F.lit(corpus).alias("corpus"), F.lit(int(seed)).alias("seed"), "*")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """All published splits: (corpus, seed, columns of the splits)."""
    paths = f"{path}/corpus=*/seed=*/rows"
    return spark.read.option("basePath", path).option("recursiveFileLookup", "false").parquet(paths).withColumn(
        "corpus", F.url_decode(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "/corpus=([^/]*)/", 1)))).withColumn(
        "seed", F.regexp_extract(F.col("_metadata.file_path"), "/seed=([^/]*)/", 1).cast("int"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Experiment records from JSON files, with an explicit nested schema."""
    return spark.read.schema(RECORD).option("multiLine", "true").json(path)


def read_record_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Experiment records from files with one JSON object per line: (records, lines that are none as ``line``)."""
    schema = T.StructType([*RECORD.fields, T.StructField("_corrupt_record", T.StringType())])
    # the file is parsed again for each of the two, column pruning would hide corrupt lines otherwise
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.from_json("value", schema, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    broken = F.col("r._corrupt_record").isNotNull() | F.col("r.schema").isNull()
    return rows.where(~broken).select("r.*").drop("_corrupt_record"), rows.where(broken).select("line")


def parse_records(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("record", F.from_json(column, RECORD))


def save_model(model: PipelineModel, path: str, meta: dict) -> None:
    """Model artefact: the fitted pipeline and one JSON line with its metadata."""
    import json

    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode(
        "overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel | None, dict]:
    """Load an artefact; a model that cannot be loaded is reported in ``status``."""
    import json

    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return PipelineModel.load(f"{path}/model"), {**meta, "status": "ok"}
    except Exception as exc:  # noqa: BLE001 - the reason is part of the result
        return None, {"status": f"{type(exc).__name__}: {str(exc).splitlines()[0]}"}
