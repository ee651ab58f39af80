"""Image folders: scan, decode to gray rasters, quarantine of unreadable files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from grainscope.operators.corpus import first_per_source
from grainscope.schemas import IMAGE_EXTENSIONS
from grainscope.sources.rasters import SLICE_PIXELS

# Luma weights of ITU-R BT.601 in 16-bit fixed point.
LUMA_RED, LUMA_GREEN, LUMA_BLUE, LUMA_HALF = 19595, 38470, 7471, 32768

DECODED = ("source string, path string, height int, width int, px array<smallint>, error string")


def any_case_glob(extensions: list[str] = IMAGE_EXTENSIONS) -> str:
    """Glob that matches the extensions in upper and lower case."""
    def letters(ext: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)

    return "*.{" + ",".join(letters(e) for e in extensions) + "}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in its form."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = file_system(spark, path)
    return fs.exists(hadoop_path)


def _files(reader, path: str, recursive: bool, extensions: list[str]) -> DataFrame:
    return (reader.format("binaryFile").option("pathGlobFilter", any_case_glob(extensions))
            .option("recursiveFileLookup", str(recursive).lower()).load(path))


def list_images(spark: SparkSession, root: str, source: str = "images", recursive: bool = True,
                limit: int = 0) -> DataFrame:
    """Image paths below a folder, one per exact path: two names that differ in case are two photos.

    Only paths are read: ``content`` is pruned from the scan.
    """
    files = _files(spark.read, root, recursive, IMAGE_EXTENSIONS).select(
        F.lit(source).alias("source"), "path", "length")
    once = files.groupBy("source", "path").agg(F.max("length").alias("length"))
    return first_per_source(once, limit)


def scan_sources(spark: SparkSession, roots: dict[str, str], limits: dict[str, int] | None = None,
                 recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """Paths of several named folders, and a report with one row per source.

    A folder that does not exist is reported as missing; it is never dropped silently.
    """
    limits = limits or {}
    found, report = None, None
    for source, root in roots.items():
        if path_exists(spark, root):
            paths = list_images(spark, root, source, recursive, limits.get(source, 0))
            found = paths if found is None else found.unionByName(paths)
            line = paths.agg(F.lit(source).alias("source"), F.lit(root).alias("root"),
                             F.count(F.lit(1)).alias("n_images"), F.lit("ok").alias("status"))
        else:
            line = spark.createDataFrame([(source, root, 0, "missing")],
                                         "source string, root string, n_images long, status string")
        report = line if report is None else report.unionByName(line)
    if found is None:
        found = spark.createDataFrame([], "source string, path string, length long")
    return found, report


# ---------------------------------------------------------------- decoding
_PGM = re.compile(rb"P5(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s")


def _gray_from_pgm(content: bytes) -> tuple[int, int, np.ndarray]:
    head = _PGM.match(content or b"")
    if not head:
        raise ValueError("not a binary PGM file")
    width, height, peak = (int(g) for g in head.groups())
    pixels = np.frombuffer(content, np.uint8, offset=head.end())
    if peak != 255 or pixels.size < width * height:
        raise ValueError("unsupported depth" if peak != 255 else "file is cut short")
    return height, width, pixels[:width * height]


def _gray_from_struct(height: int, width: int, channels: int, data: bytes) -> tuple[int, int, np.ndarray]:
    if height <= 0 or width <= 0:
        raise ValueError("cannot decode image")
    values = np.frombuffer(data, np.uint8).reshape(-1, channels)
    if channels == 1:
        return height, width, values[:, 0]
    blue, green, red = (values[:, c].astype(np.int64) for c in range(3))
    luma = (LUMA_RED * red + LUMA_GREEN * green + LUMA_BLUE * blue + LUMA_HALF) >> 16
    return height, width, luma.astype(np.uint8)


def _decode(df: DataFrame, columns: list[str], gray) -> DataFrame:
    """Apply a one-image decoder to every row; an exception becomes the row's error."""
    def rows(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        heights, widths, px, errors = zip(*found)
        return pa.RecordBatch.from_arrays(
            [batch.column("source"), batch.column("path"), pa.array(heights, pa.int32()),
             pa.array(widths, pa.int32()), pa.array(px, pa.list_(pa.int16())),
             pa.array(errors, pa.string())],
            ["source", "path", "height", "width", "px", "error"])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held, first = [], 0, 0
            for i in range(len(batch)):
                try:
                    h, w, v = gray(*(batch.column(c)[i].as_py() for c in columns))
                    found.append((h, w, v.astype(np.int16), None))
                    held += v.size
                except Exception as exc:  # noqa: BLE001 - one bad file must not end the batch
                    found.append((None, None, None, str(exc)))
                if held >= SLICE_PIXELS:        # compressed files become many times larger
                    yield rows(batch.slice(first, len(found)), found)
                    found, held, first = [], 0, i + 1
            if found:
                yield rows(batch.slice(first), found)

    return df.mapInArrow(convert, DECODED)


def decode_pgm(files: DataFrame) -> DataFrame:
    """Decode rows (source, path, content) of binary PGM files."""
    return _decode(files.select("source", "path", "content"), ["content"], _gray_from_pgm)


#: What the JVM image source gives: one column of this type.
IMAGE = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"
FILES = "path string, modificationTime timestamp, length long, content binary"


def decode_with(reader: DataFrameReader | DataStreamReader, root: str, source: str = "images", recursive: bool = True) -> DataFrame:
    """Decode all images below a folder, by ``spark.read`` or ``spark.readStream`` alike: PGM in Arrow batches, the other
    formats by the JVM image source, colour reduced to luma. A file that cannot be decoded is a row with an ``error``.

    Spark lists no files of zero length; they appear in neither output.
    """
    def files(kind: str, schema: str, extensions: list[str]) -> DataFrame:
        return (reader.format(kind).schema(schema).option("pathGlobFilter", any_case_glob(extensions))
                .option("recursiveFileLookup", str(recursive).lower()).option("dropInvalid", "false").load(root))

    pgm = decode_pgm(files("binaryFile", FILES, ["pgm"]).select(F.lit(source).alias("source"), "path", "content"))
    jvm = files("image", IMAGE, [e for e in IMAGE_EXTENSIONS if e != "pgm"])
    rows = jvm.select(F.lit(source).alias("source"), F.col("image.origin").alias("path"), "image.height",
                      "image.width", "image.nChannels", "image.data")
    return pgm.unionByName(_decode(rows, ["height", "width", "nChannels", "data"], _gray_from_struct))


def decode_folder(spark: SparkSession, root: str, source: str = "images", recursive: bool = True) -> DataFrame:
    """``decode_with`` of the files that are there now."""
    return decode_with(spark.read, root, source, recursive)


def quarantine(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split decoded rows into readable images and (source, path, error)."""
    good = decoded.where(F.col("error").isNull()).drop("error")
    return good, decoded.where(F.col("error").isNotNull()).select("source", "path", "error")


def as_rasters(good: DataFrame) -> DataFrame:
    """Raster form; the photo is named by a hash of its source and path, so that pixels stay where they are decoded.
    ``number_photos`` over the paths alone gives dense numbers, as a table of its own."""
    return good.select("source", F.xxhash64("source", "path").alias("photo_id"), F.lit("clean").alias("variant"),
                       "height", "width", "px", "path")


def pgm_content(height: str = "height", width: str = "width", px: str = "px", content: Column | None = None) -> Column:
    """A raster as the bytes of a binary PGM file; ``content`` has the pixels if they are bytes already."""
    from grainscope.sources.rasters import pixel_bytes

    head = F.concat(F.lit("P5\n"), F.col(width).cast("string"), F.lit(" "),
                    F.col(height).cast("string"), F.lit("\n255\n"))
    return F.concat(F.encode(head, "UTF-8"), pixel_bytes(px) if content is None else content)
