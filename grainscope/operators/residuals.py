"""High-pass residuals: 30 fixed 5 x 5 kernels, their statistics and the enhanced image.

Kernel weights and divisors are whole numbers, so clipped residuals are kept as integer
numerators (``residual * divisor``). Their sums are exact integers and add up over images,
bands and partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainscope.schemas import KEY
from grainscope.sources.rasters import slices

# Truncation, the two square kernels and the divisors per kernel class.
TRUNCATION = 4
SQUARE_3 = [[-1, 2, -1],
            [2, -4, 2],
            [-1, 2, -1]]
SQUARE_5 = [[-1, 2, -2, 2, -1],
            [2, -6, 8, -6, 2],
            [-2, 8, -12, 8, -2],
            [2, -6, 8, -6, 2],
            [-1, 2, -2, 2, -1]]
DIVISORS = [1] * 8 + [2] * 4 + [3] * 8 + [4] * 4 + [12] * 4 + [4, 12]
# Directions (dy, dx) in kernel order.
FIRST_ORDER = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
SECOND_ORDER = [(-1, -1), (-1, 0), (-1, 1), (0, -1)]
THIRD_ORDER = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]


def _square(weights: list[list[int]], keep=lambda dy, dx: True) -> dict[tuple[int, int], int]:
    r = len(weights) // 2
    return {(y - r, x - r): w for y, line in enumerate(weights) for x, w in enumerate(line)
            if keep(y - r, x - r)}


def kernel_taps() -> list[dict[tuple[int, int], int]]:
    """The 30 kernels as {(dy, dx): weight}, built from the rules of their classes."""
    first = [{d: 1, (0, 0): -1} for d in FIRST_ORDER]
    second = [{(y, x): 1, (0, 0): -2, (-y, -x): 1} for y, x in SECOND_ORDER]
    third = [{(2 * y, 2 * x): -1, (y, x): 3, (0, 0): -3, (-y, -x): 1} for y, x in THIRD_ORDER]
    halves = [lambda dy, dx: dy <= 0, lambda dy, dx: dx >= 0,
              lambda dy, dx: dy >= 0, lambda dy, dx: dx <= 0]
    edges = [_square(sq, half) for sq in (SQUARE_3, SQUARE_5) for half in halves]
    return first + second + third + edges + [_square(SQUARE_3), _square(SQUARE_5)]


def kernel_table(spark: SparkSession) -> DataFrame:
    """Kernels as a dimension table (c, dy, dx, w, divisor); fewer than 300 rows."""
    rows = [(c, dy, dx, w, DIVISORS[c])
            for c, taps in enumerate(kernel_taps()) for (dy, dx), w in taps.items()]
    return spark.createDataFrame(rows, "c int, dy int, dx int, w int, divisor int")


# ---------------------------------------------------------------- native form
def _neighbours(rasters: DataFrame, reach: int) -> DataFrame:
    """One row per pixel with its neighbours up to ``reach`` as columns ``p_<dy>_<dx>``.

    The pixel array is padded with zeros and shifted; columns beyond the left or right
    border are zeroed by the pixel's x. No window, no shuffle.
    """
    n = "size(px)"
    spans = range(-reach, reach + 1)
    pad = f"array_repeat(cast(0 as smallint), {reach} * width + {reach})"
    padded = rasters.select(*KEY, "width", F.expr(n).alias("n"),
                            F.expr(f"concat({pad}, px, {pad})").alias("z"))

    def name(dy: int, dx: int) -> str:
        return f"p_{dy}_{dx}".replace("-", "m")

    shifted = ", ".join(f"slice(z, {reach} * width + {reach} + {dy} * width + {dx} + 1, n)"
                        for dy in spans for dx in spans)
    flat = padded.select(*KEY, "width", F.expr(f"inline(arrays_zip(sequence(0, n - 1), {shifted}))")
                         .alias("i", *[name(dy, dx) for dy in spans for dx in spans]))
    x = F.col("i") % F.col("width")

    def seen(dy: int, dx: int) -> Column:
        value = F.col(name(dy, dx)).cast("int")
        if dx == 0:
            return value.alias(name(dy, dx))
        inside = x + dx >= 0 if dx < 0 else x + dx < F.col("width")
        return F.when(inside, value).otherwise(0).alias(name(dy, dx))

    return flat.select(*KEY, "i", *[seen(dy, dx) for dy in spans for dx in spans])


def native_residual_sums(rasters: DataFrame, kernels: list[int]) -> DataFrame:
    """Additive sums per kernel in Spark expressions; rows (key, c, n, s1, sa, s2)."""
    taps = kernel_taps()
    reach = max(abs(o) for c in kernels for d in taps[c] for o in d)
    near = _neighbours(rasters, reach)

    def clipped(c: int) -> Column:
        terms = [F.col(f"p_{dy}_{dx}".replace("-", "m")) * w for (dy, dx), w in taps[c].items()]
        bound = TRUNCATION * DIVISORS[c]
        return F.least(F.greatest(sum(terms[1:], terms[0]), F.lit(-bound)), F.lit(bound))

    sums = near.select(*KEY, *[clipped(c).alias(f"r{c}") for c in kernels]).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        *[agg for c in kernels for agg in (
            F.sum(f"r{c}").alias(f"s1_{c}"), F.sum(F.abs(f"r{c}")).alias(f"sa_{c}"),
            F.sum(F.col(f"r{c}") * F.col(f"r{c}")).alias(f"s2_{c}"))])
    return sums.select(*KEY, F.inline(F.array(*[
        F.struct(F.lit(c).alias("c"), "n", F.col(f"s1_{c}").alias("s1"), F.col(f"sa_{c}").alias("sa"),
                 F.col(f"s2_{c}").alias("s2")) for c in kernels])))


# ---------------------------------------------------------------- Arrow form
def _numerators(px: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The 30 residual images as integer numerators, one at a time.

    All intermediate values fit into 16 bits, which keeps one image within the cache.
    Pixels missing from a short last row have residual 0.
    """
    height = -(-len(px) // width)
    image = np.zeros(height * width, np.int16)
    image[:len(px)] = px
    for r in _filtered(image.reshape(height, width)):
        r.ravel()[len(px):] = 0
        yield r


def _filtered(image: np.ndarray) -> Iterator[np.ndarray]:
    """What each kernel makes of an image with zeros around it; the array is used again for the next kernel."""
    height, width = image.shape
    z = np.zeros((height + 4, width + 4), np.int16)
    z[2:-2, 2:-2] = image
    r, term = np.empty((2, height, width), np.int16)
    for taps in kernel_taps():
        r.fill(0)
        for (dy, dx), w in taps.items():
            near = z[2 + dy:2 + dy + height, 2 + dx:2 + dx + width]
            if w == 1:
                r += near
            elif w == -1:
                r -= near
            else:
                r += np.multiply(near, w, out=term)
        yield r


def residual_sums_of(px: np.ndarray, width: int, first: int = 0, count: int | None = None) -> list[tuple[int, int, int]]:
    """Per kernel the sums of clipped numerators, of their absolute values and squares.

    Of ``count`` pixels from ``first`` on, which begins an image row; the others are neighbours only."""
    def total(r: np.ndarray, largest: int) -> int:
        # as many rows at a time as a 16-bit column sum can hold
        rows = max(1, 32767 // largest)
        if rows < 64:
            return int(r.sum(axis=0, dtype=np.int32).sum(dtype=np.int64))
        return sum(int(r[y:y + rows].sum(axis=0, dtype=np.int16).sum(dtype=np.int64))
                   for y in range(0, len(r), rows))

    end = len(px) if count is None else first + count
    out = []
    for r, divisor in zip(_numerators(px, width), DIVISORS):
        r = r[first // width:-(-end // width)]
        r.reshape(-1)[end - first:] = 0
        bound = TRUNCATION * divisor
        np.clip(r, -bound, bound, out=r)
        s1 = total(r, bound)
        np.abs(r, out=r)
        sa = total(r, bound)
        r *= r
        out.append((s1, sa, total(r, bound * bound)))
    return out


def residual_sums_of_each(images: list[np.ndarray], widths: list[int], firsts: list[int], counts: list[int]) -> np.ndarray:
    """``residual_sums_of`` for many images: (image, kernel, sum). Images of one width are filtered as one tall image, with
    two rows of zeros between them, which no kernel reaches across; small images then cost their pixels and not their calls."""
    out = np.zeros((len(images), len(DIVISORS), 3), np.int64)
    for width in set(widths):
        which = [i for i, w in enumerate(widths) if w == width]
        if len(which) == 1:
            i = which[0]
            out[i] = residual_sums_of(images[i], width, firsts[i], counts[i])
            continue
        heights = np.array([-(-len(images[i]) // width) + 2 for i in which])
        tops = np.cumsum(heights) - heights
        tall, own = np.zeros((2, int(heights.sum()) * width), np.int16)
        for i, at in zip(which, (tops * width).tolist()):
            tall[at:at + len(images[i])] = images[i]
            own[at + firsts[i]:at + firsts[i] + counts[i]] = 1
        own = own.reshape(-1, width)
        for c, (r, divisor) in enumerate(zip(_filtered(tall.reshape(-1, width)), DIVISORS)):
            bound = TRUNCATION * divisor
            np.clip(r, -bound, bound, out=r)
            r *= own
            for k in range(3):      # plain, absolute, squared
                if k:
                    np.abs(r, out=r) if k == 1 else np.multiply(r, r, out=r)
                out[which, c, k] = np.add.reduceat(r.sum(axis=1, dtype=np.int64), tops)
    return out


def residual_sums(rasters: DataFrame) -> DataFrame:
    """Additive sums for all 30 kernels; rows (key, c, n, s1, sa, s2)."""
    schema = _key_schema(rasters) + ", c int, n bigint, s1 bigint, sa bigint, s2 bigint"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            widths = batch.column("width").to_pylist()
            rasters_ = [px.values.to_numpy(zero_copy_only=False) for px in batch.column("px")]
            if rasters_:
                sizes = [len(px) for px in rasters_]
                s = residual_sums_of_each(rasters_, widths, [0] * len(sizes), sizes).reshape(-1, 3)
                n = np.repeat(sizes, 30)
                take = pa.array(np.repeat(np.arange(len(rasters_)), 30))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).take(take) for k in KEY]
                    + [pa.array(np.tile(np.arange(30, dtype=np.int32), len(rasters_))), pa.array(n)]
                    + [pa.array(s[:, i]) for i in range(3)],
                    KEY + ["c", "n", "s1", "sa", "s2"])

    return rasters.select(*KEY, "width", "px").mapInArrow(sums, schema)


def moments_of(n: Column, s1: Column, sa: Column, s2: Column, divisor: Column) -> dict[str, Column]:
    """Mean, mean absolute value and population deviation of the absolute value."""
    n, sa = n.cast("double"), sa.cast("double")
    return {"mu": s1 / (n * divisor), "absmean": sa / (n * divisor),
            "std": F.sqrt(F.greatest(n * s2 - sa * sa, F.lit(0.0))) / (n * divisor)}


def residual_moments(sums: DataFrame) -> DataFrame:
    """The three moments, one row per image and kernel."""
    divisor = F.element_at(F.array(*[F.lit(d) for d in DIVISORS]), F.col("c") + 1)
    moments = moments_of(*(F.col(c) for c in ("n", "s1", "sa", "s2")), divisor)
    return sums.select(*KEY, "c", *[m.alias(name) for name, m in moments.items()])


def residual_stats(rasters: DataFrame) -> DataFrame:
    """The 90 columns, one row per image (pivot over the fixed kernel list)."""
    m = residual_moments(residual_sums(rasters))
    return m.groupBy(*KEY).agg(*[
        F.max(F.when(F.col("c") == c, F.col(stat))).alias(f"srm_{stat}_c{c}")
        for stat in ("mu", "absmean", "std") for c in range(30)])


def enhanced(rasters: DataFrame) -> DataFrame:
    """Residual-enhanced image: the largest absolute residual of each pixel as a gray value."""
    fields = [f for f in rasters.schema.fields if f.name != "px"]
    schema = T.StructType(fields + [T.StructField("px", T.ArrayType(T.ShortType()))])
    names = [f.name for f in fields]

    def enhance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for px, width in zip(batch.column("px"), batch.column("width").to_pylist()):
                values = px.values.to_numpy(zero_copy_only=False)
                top = np.zeros(len(values))
                for r, divisor in zip(_numerators(values, width), DIVISORS):
                    np.maximum(top, np.abs(r.ravel()[:len(values)]) / divisor, out=top)
                top = np.minimum(top, TRUNCATION)
                out.append(np.rint((top + TRUNCATION) / (2 * TRUNCATION) * 255).astype(np.int16))
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(out, pa.list_(pa.int16()))],
                names + ["px"])

    return rasters.select(*names, "px").mapInArrow(enhance, schema)


def _key_schema(df: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"{c} {kinds[c]}" for c in KEY)


PREPROCESSORS = {"none": lambda rasters: rasters, "residual": enhanced}
