"""Resize, crops and the JPEG-recompressed clean variant."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainscope.schemas import KEY
from grainscope.sources.rasters import SLICE_PIXELS, slices

WORK_SIDE = 512

# Luminance quantisation table of the JPEG standard, row by row.
JPEG_LUMINANCE = [
    [16, 11, 10, 16, 24, 40, 51, 61],
    [12, 12, 14, 19, 26, 58, 60, 55],
    [14, 13, 16, 24, 40, 57, 69, 56],
    [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77],
    [24, 35, 55, 64, 81, 104, 113, 92],
    [49, 64, 78, 87, 103, 121, 120, 101],
    [72, 92, 95, 98, 112, 100, 103, 99]]


def map_images(rasters: DataFrame, change: Callable[[np.ndarray], np.ndarray],
               variant: str | None = None) -> DataFrame:
    """Apply a function of one 2-D image to every raster; identity columns are kept."""
    names = [f.name for f in rasters.schema.fields]

    def rows(batch: pa.RecordBatch, out: list[np.ndarray]) -> pa.RecordBatch:
        new = {"height": pa.array([a.shape[0] for a in out], pa.int32()),
               "width": pa.array([a.shape[1] for a in out], pa.int32()),
               "px": pa.array([a.ravel() for a in out], pa.list_(pa.int16()))}
        return pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, held, first = [], 0, 0
            for i, (px, h, w) in enumerate(zip(batch.column("px"), batch.column("height").to_pylist(), batch.column("width").to_pylist()), 1):
                out.append(change(px.values.to_numpy(zero_copy_only=False).reshape(h, w)).astype(np.int16))
                held += out[-1].size
                if held >= SLICE_PIXELS:        # an image may become larger than it was
                    yield rows(batch.slice(first, i - first), out)
                    out, held, first = [], 0, i
            if out:
                yield rows(batch.slice(first), out)

    changed = rasters.mapInArrow(convert, rasters.schema)
    return changed if variant is None else changed.withColumn("variant", F.lit(variant))


def lanczos_weights(size_in: int, size_out: int) -> np.ndarray:
    """(out, in) weights of a three-lobe Lanczos filter, widened when shrinking."""
    stretch = max(size_in / size_out, 1.0)
    offset = (np.arange(size_in)[None, :] + 0.5 - (np.arange(size_out)[:, None] + 0.5) * size_in / size_out) / stretch
    w = np.where(offset == 0, 1.0, 0.0)
    for o, j in zip(*np.nonzero((np.abs(offset) < 3) & (offset != 0))):
        x = math.pi * float(offset[o, j])
        w[o, j] = math.sin(x) / x * math.sin(x / 3) / (x / 3)
    return w / w.cumsum(axis=1)[:, -1:]


@lru_cache(maxsize=64)
def _taps(size_in: int, size_out: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and weights of each output's first, second, ... tap."""
    w = lanczos_weights(size_in, size_out)
    many = int((w != 0).sum(axis=1).max())
    at = np.sort(np.argsort(w == 0, axis=1, kind="stable")[:, :many], axis=1)
    return [(at[:, k], w[np.arange(size_out), at[:, k]]) for k in range(many)]


def _filtered_rows(image: np.ndarray, side: int) -> np.ndarray:
    """Columns of ``image`` to ``side`` columns. Taps are added from left to right: weights have whole ratios, so that sums of
    exactly a half do occur, and which way they round is the order's."""
    return sum(image[:, at] * w for at, w in _taps(image.shape[1], side))


def resize(rasters: DataFrame, side: int = WORK_SIDE) -> DataFrame:
    """Square Lanczos resize, columns then rows, rounded to gray values after each pass.

    The same function prepares training corpora and images to be scored.
    """
    def to_gray(a: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(a + 0.5), 0, 255)

    def change(image: np.ndarray) -> np.ndarray:
        h, w = image.shape
        if (h, w) == (side, side):
            return image
        return to_gray(_filtered_rows(to_gray(_filtered_rows(image, side)).T, side)).T

    return map_images(rasters, change)


def jpeg_round_trip(rasters: DataFrame, quality: int = 90, variant: str = "clean_jpeg") -> DataFrame:
    """Clean images after JPEG quantisation of their 8 x 8 blocks; the photo id is inherited,
    so that the recompressed row stays with its source photo in every split."""
    factor = 5000 / quality if quality < 50 else 200 - 2 * quality
    table = np.clip(np.floor((np.array(JPEG_LUMINANCE) * factor + 50) / 100), 1, 255)
    freq, pos = np.arange(8)[:, None], np.arange(8)[None, :]
    dct = np.cos((2 * pos + 1) * freq * np.pi / 16) * np.where(freq == 0, np.sqrt(1 / 8), 0.5)

    def change(image: np.ndarray) -> np.ndarray:
        h, w = image.shape
        padded = np.pad(image, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128.0
        blocks = padded.reshape(padded.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
        kept = np.rint(dct @ blocks @ dct.T / table) * table
        back = (dct.T @ kept @ dct).swapaxes(1, 2).reshape(padded.shape) + 128.0
        return np.clip(np.rint(back), 0, 255)[:h, :w]

    return map_images(rasters, change, variant)


# ---------------------------------------------------------------- crops
def crop_corners(height: str, width: str, side: int) -> Column:
    """Top-left corners of the four corner crops and the centre crop, without repeats."""
    bottom, right = f"{height} - {side}", f"{width} - {side}"
    corners = [("0", "0"), ("0", right), (bottom, "0"), (bottom, right),
               (f"({bottom}) div 2", f"({right}) div 2")]
    five = ", ".join(f"named_struct('y0', cast({y} as int), 'x0', cast({x} as int))" for y, x in corners)
    return F.expr(f"if({height} <= {side} or {width} <= {side}, "
                  f"array(named_struct('y0', 0, 'x0', 0)), array_distinct(array({five})))")


def crops(rasters: DataFrame, side: int, centre_only: bool = False) -> DataFrame:
    """One row per crop: (key, crop number, y0, x0, pixels). Row-local array slices."""
    where = crop_corners("height", "width", side)
    if centre_only:
        where = F.expr(f"array(named_struct('y0', cast(greatest(0, height - {side}) div 2 as int), "
                       f"'x0', cast(greatest(0, width - {side}) div 2 as int)))")
    cut = rasters.select(*KEY, "height", "width", "px", where.alias("at")).select(
        *KEY, F.posexplode(F.expr(
            f"transform(at, a -> named_struct('y0', a.y0, 'x0', a.x0, "
            f"'height', least({side}, height), 'width', least({side}, width), 'px', "
            f"flatten(transform(sequence(0, least({side}, height) - 1), y -> "
            f"slice(px, (a.y0 + y) * width + a.x0 + 1, least({side}, width))))))")).alias("crop", "c"))
    return cut.select(*KEY, "crop", "c.*")


def mean_over_crops(scored: DataFrame, prob: str = "prob") -> DataFrame:
    """Mean probability of an image's crops."""
    return scored.groupBy(*KEY).agg(F.avg(prob).alias(prob), F.count(F.lit(1)).alias("n_crops"))
