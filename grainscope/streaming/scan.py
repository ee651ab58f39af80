"""Continuous scan of a drop folder: new files become verdicts, unreadable files are set aside.

Each micro-batch runs the batch operators of the blind scan. Images do not interact, so no
state or watermark is kept; the checkpoint records which files are done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grainscope.operators.detector import model_scan
from grainscope.schemas import KEY
from grainscope.session import save_and_reload
from grainscope.sources.images import decode_with, quarantine
from grainscope.sources.models import Artefact
from grainscope.sources.rasters import pixels_from_bytes


def scan_files(good: DataFrame, sensitivity: str = "balanced", artefact: Artefact | None = None, **options) -> DataFrame:
    """Verdicts of decoded images, in batch and stream alike. The path is the identity: numbering photos would need all
    files at once."""
    rasters = good.select("source", F.xxhash64("path").alias("photo_id"), F.col("path").alias("variant"), "height", "width", "px")
    return model_scan(rasters, artefact, sensitivity, **options).withColumnRenamed("variant", "path").drop("photo_id")


def scan_batch(decoded: DataFrame, out: str, batch_id: int, sensitivity: str = "balanced", artefact: Artefact | None = None,
               **options) -> None:
    """Score one micro-batch and write verdicts and rejects.

    Each output is a folder of the batch that a replay overwrites, so each file is reported once. Decoded images are
    written beside them for the time of the batch, since both outputs read them."""
    good, bad = quarantine(save_and_reload(decoded, f"{out}/decoded"))
    scan_files(good, sensitivity, artefact, **options).write.mode("overwrite").parquet(f"{out}/verdicts/batch={batch_id}")
    bad.write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}")


def watch_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, source: str = "drop",
                 sensitivity: str = "balanced", once: bool = True, artefact: Artefact | None = None, **options) -> StreamingQuery:
    """Start the scan of image files dropped below a folder, of all formats that the batch scan reads."""
    writer = (decode_with(spark.readStream, folder, source).writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, batch_id: scan_batch(df, out, batch_id, sensitivity, artefact, **options)))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def watch_raster_store(spark: SparkSession, store: str, out: str, checkpoint: str,
                       sensitivity: str = "balanced", artefact: Artefact | None = None, **options) -> StreamingQuery:
    """Scan rasters as another job appends them to a raster store."""
    schema = spark.read.parquet(store).schema
    rasters = pixels_from_bytes(spark.readStream.schema(schema).parquet(store))

    def each(df: DataFrame, batch_id: int) -> None:
        model_scan(df.select(*KEY, "height", "width", "px"), artefact, sensitivity, **options).write.mode(
            "overwrite").parquet(f"{out}/verdicts/batch={batch_id}")

    return (rasters.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
            .trigger(availableNow=True).start())


def read_verdicts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/verdicts")
