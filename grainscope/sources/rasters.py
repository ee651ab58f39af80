"""Raster tables derived from ordinary tables, and the byte <-> pixel boundary.

A raster is one row: identity, size and the row-major pixels as array<smallint>. The
last image row may be short (a byte stream rarely fills it); all 1-D statistics use
every pixel, all 2-D ones use every neighbour pair that exists.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainscope.schemas import KEY, RASTER
from grainscope.session import spread

EMBEDDING_SIDE = 64
BAND_PIXELS = 1 << 20
BYTE_WIDTH = 32
SLICE_PIXELS = 1 << 18      # pixels that a task works on or holds at once, besides the batch it reads
ROW_PIXELS = 256            # what an image counts besides its pixels


def unit_to_gray(array: str) -> Column:
    """Array of floats in [-1, 1] to gray values 0..255."""
    return F.expr(f"transform({array}, e -> cast(least(255, greatest(0, "
                  f"floor((cast(e as double) + 1) * 127.5))) as smallint))")


def embedding_rasters(spark: SparkSession, sf_dir: str, rows: int = EMBEDDING_SIDE) -> DataFrame:
    """So many consecutive vectors form one image, one vector per pixel row."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.expr(f"vec_id div {rows}").alias("photo_id"),
        F.expr(f"vec_id % {rows}").alias("y"),
        unit_to_gray("embedding").alias("line"))
    # At most ``rows`` lines of 64 pixels meet in one group.
    lines = vectors.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("y", "line"))).alias("lines"))
    return lines.select(
        F.lit("emb").alias("source"), "photo_id", F.lit("clean").alias("variant"),
        F.size("lines").alias("height"), F.lit(EMBEDDING_SIDE).alias("width"),
        F.flatten("lines.line").alias("px"))


def tile_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8 x 8 image per vector; the source is its label."""
    vectors = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id")
    return vectors.select(
        F.concat(F.lit("label"), F.col("label").cast("string")).alias("source"),
        F.col("vec_id").alias("photo_id"), F.lit("clean").alias("variant"),
        F.lit(8).alias("height"), F.lit(8).alias("width"), unit_to_gray("embedding").alias("px"))


def document_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of ``document_rasters`` with their pixels as ``content``, one byte each: no Python is needed to make them."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", "text"),
                  "doc_id")
    return docs.where(F.octet_length("text") > 0).select(
        "source", F.col("doc_id").alias("photo_id"), F.lit("clean").alias("variant"),
        F.expr(f"cast(ceil(octet_length(text) / {BYTE_WIDTH}) as int)").alias("height"),
        F.lit(BYTE_WIDTH).alias("width"), F.encode("text", "UTF-8").alias("content"))


def document_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The UTF-8 bytes of each whole document, 32 per image row; the source is kept."""
    return pixels_from_bytes(document_bytes(spark, sf_dir))


def pixel_column(images: DataFrame) -> tuple[str, Column]:
    """The column that holds the pixels (``px``, or ``content`` with a byte for each), and how many there are in a row."""
    if "px" in images.columns:
        return "px", F.size("px")
    return "content", F.octet_length("content")


def slices(batches: Iterator[pa.RecordBatch], column: str = "px", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in pieces of about ``limit`` pixels (bytes of a binary column); a larger image is alone.

    What a task makes of its input is thus bounded by the piece and not by the rows that come in one batch.
    """
    limit = limit or SLICE_PIXELS
    for batch in batches:
        values = batch.column(column)
        lengths = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        sizes = pc.fill_null(lengths(values), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_PIXELS
        starts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // limit, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(batch)]):
            yield batch.slice(a, b - a)


def pixels_from_bytes(raw: DataFrame, content: str = "content") -> DataFrame:
    """Replace a binary column by ``px``; one Arrow buffer becomes another, no per-row Python."""
    keep = [f for f in raw.schema.fields if f.name != content]
    out = T.StructType(keep + [T.StructField("px", T.ArrayType(T.ShortType()))])
    names = [f.name for f in keep]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, content):
            values = batch.column(content).cast(pa.large_binary())
            offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[
                values.offset:values.offset + len(values) + 1]
            data = values.buffers()[2]
            octets = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, np.uint8)
            shorts = pa.array(octets[offsets[0]:offsets[-1]].astype(np.int16))
            px = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), shorts)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [px],
                                             names + ["px"])

    return raw.mapInArrow(convert, out)


def bytes_from_pixels(rasters: DataFrame, content: str = "content") -> DataFrame:
    """Inverse of ``pixels_from_bytes``: one byte per pixel, again buffer to buffer."""
    keep = [f for f in rasters.schema.fields if f.name != "px"]
    out = T.StructType(keep + [T.StructField(content, T.BinaryType())])
    names = [f.name for f in keep]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            px = batch.column("px")
            offsets = px.offsets.to_numpy()
            octets = px.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.uint8)
            data = pa.BinaryArray.from_buffers(
                pa.binary(), len(px), [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(octets)])
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [data], names + [content])

    return rasters.select(*names, "px").mapInArrow(convert, out)


def pixel_bytes(px: str = "px") -> Column:
    """Pixels back to binary, for hashing and file sinks."""
    return F.unhex(F.array_join(F.transform(px, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def content_hash(px: str = "px") -> Column:
    """SHA-256 of the pixel bytes: independent of file format and metadata."""
    return F.sha2(pixel_bytes(px), 256)


def pixels(rasters: DataFrame, *keep: str) -> DataFrame:
    """Long form: one row per pixel with its linear index and coordinates."""
    return rasters.select(*(keep or KEY), "width", F.posexplode("px").alias("i", "v")).select(
        *(keep or KEY), F.col("i").cast("long").alias("i"),
        F.expr("i div width").cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"),
        F.col("v").cast("int").alias("v"))


def large_enough(rasters: DataFrame, min_pixels: int = 64 * 64) -> DataFrame:
    """Drop images with fewer than 64 x 64 pixels."""
    return rasters.where(F.col("height").cast("long") * F.col("width") >= min_pixels)


def bands(rasters: DataFrame, max_pixels: int = BAND_PIXELS, halo: int = 0, keep: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Cut large images into bands of whole rows of about ``max_pixels``, so that no task works on one giant image.

    A band carries the pixels it counts (``own`` of them, from linear index ``start`` of ``total``), before them ``before``
    pixels of up to ``halo`` image rows, and after them what its last neighbours reach: ``halo`` rows, at least one, and one
    pixel, at least three pixels. All statistics add up over bands.
    """
    n = "size(px)"
    step = f"(greatest(1, {max_pixels} div width) * width)"
    before = f"least({halo} * width, b * {step})"
    after = f"greatest({max(halo, 1)} * width + 1, 3)"
    whole = f"array(named_struct('start', 0L, 'own', cast({n} as long), 'before', 0L, 'px', px))"
    cut = (f"transform(sequence(0L, ({n} - 1) div {step}), b -> named_struct("
           f"'start', b * {step}, 'own', least({step}, {n} - b * {step}), 'before', {before}, "
           f"'px', slice(px, cast(b * {step} - {before} + 1 as int), cast({before} + {step} + {after} as int))))")
    kept = list(dict.fromkeys([*keep, "width"]))
    return rasters.where(F.size("px") > 0).select(
        *kept, F.expr(n).cast("long").alias("total"),
        F.explode(F.expr(f"if({n} <= {step}, {whole}, {cut})")).alias("band")).select(
        *kept, "total", "band.start", "band.own", "band.before", "band.px")


def empty_rasters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RASTER)
