"""Corpus tables: validation, splits, numbering, unions and joins by photo."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainscope.functions.ordering import hash_ranked, ranked
from grainscope.schemas import FEATURE_SETS, META, PHOTO


LIMITED = 1000          # up to this rank Spark limits a window before its exchange


class MissingColumns(ValueError):
    """A requested feature column does not exist; there is no fallback to fewer features."""


class BrokenCorpus(ValueError):
    """The corpus violates an invariant that its evaluation relies on."""


# ---------------------------------------------------------------- columns
def feature_columns(df: DataFrame) -> list[str]:
    """All columns that are not metadata."""
    return [c for c in df.columns if c not in META]


def schema_gaps(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """What stands in the way of using ``columns`` as features: column -> reason."""
    kinds = dict(df.dtypes)
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    reasons = {c: "absent" if c not in kinds else f"of type {kinds[c]}" for c in columns}
    return {c: r for c, r in reasons.items() if not kinds.get(c, "").startswith(numeric)}


def require_features(df: DataFrame, columns: Sequence[str], what: str = "table") -> list[str]:
    """The columns, all present and numeric."""
    if gaps := schema_gaps(df, columns):
        raise MissingColumns(f"{what}: " + "; ".join(f"{c} is {r}" for c, r in gaps.items()))
    return list(columns)


def select_feature_set(df: DataFrame, name: str) -> DataFrame:
    """Metadata plus one named feature set; Catalyst prunes the scan to it."""
    features = require_features(df, FEATURE_SETS[name], name)
    return df.select(*[c for c in META if c in df.columns], *features)


def numeric_or_null(c: Column, kind: str) -> Column:
    """Text to number; empty or unreadable text becomes NULL."""
    return F.nullif(F.trim(c), F.lit("")).try_cast(kind)


# ---------------------------------------------------------------- validation
def not_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of NaN, infinite and NULL values per column, one row per column."""
    def bad(c: str) -> Column:
        value = F.col(c).cast("double")
        return F.count_if(F.isnan(value) | (F.abs(value) == float("inf")))

    wide = df.agg(*[x for i, c in enumerate(columns) for x in (
        bad(c).alias(f"b{i}"), F.count_if(F.col(c).isNull()).alias(f"z{i}"))])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"b{i}").alias("n_not_finite"), F.col(f"z{i}").alias("n_null"))
        for i, c in enumerate(columns)])))


def assert_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if not not_finite(df, columns).where((F.col("n_not_finite") > 0) | (F.col("n_null") > 0)).isEmpty():
        raise BrokenCorpus("feature values are not all finite")
    return df


def variant_sets(df: DataFrame, key: Sequence[str] = PHOTO) -> DataFrame:
    """The set of variants of each photo."""
    return df.groupBy(*key).agg(F.array_sort(F.collect_set("variant")).alias("variants"))


def grouping_violations(df: DataFrame, key: Sequence[str] = PHOTO) -> DataFrame:
    """Photos whose variant set is not the most common one (ties: the larger set).

    A photo that carries only part of the variants is the mark of a split leak.
    """
    sets = variant_sets(df, key)
    common = sets.groupBy("variants").agg(F.count(F.lit(1)).alias("n")).agg(
        F.max_by("variants", F.struct("n", F.size("variants"), "variants")).alias("_common"))
    return sets.crossJoin(F.broadcast(common)).where(F.col("variants") != F.col("_common")).drop("_common")


def check_grouping(df: DataFrame, key: Sequence[str] = PHOTO) -> DataFrame:
    bad = grouping_violations(df, key).take(5)
    if bad:
        raise BrokenCorpus(f"photos with a different variant set: {bad}")
    return df


def id_report(df: DataFrame, source: str = "source", photo: str = "photo_id") -> DataFrame:
    """Are the photo ids of each source contiguous? One row per source."""
    ids = df.select(source, photo).distinct()
    return ids.groupBy(source).agg(
        F.min(photo).alias("min_id"), F.max(photo).alias("max_id"), F.count(F.lit(1)).alias("n_ids")).withColumn(
        "contiguous", F.col("max_id") - F.col("min_id") + 1 == F.col("n_ids"))


def variant_delta(df: DataFrame, features: Sequence[str], a: str, b: str,
                  key: Sequence[str] = PHOTO) -> DataFrame:
    """Largest absolute feature difference between two variants of the same photo."""
    key = list(key)
    left = df.where(F.col("variant") == a).select(*key, *[F.col(f).alias(f"a_{f}") for f in features])
    right = df.where(F.col("variant") == b).select(*key, *[F.col(f).alias(f"b_{f}") for f in features])
    deltas = [F.abs(F.col(f"a_{f}") - F.col(f"b_{f}")) for f in features]
    return left.join(right, key).select(*key, (F.greatest(*deltas) if len(deltas) > 1 else deltas[0]).alias("max_delta"))


# ---------------------------------------------------------------- splits
def photo_digest(seed: int | str, key: Sequence[str] = PHOTO) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *key))


def holdout_split(df: DataFrame, fraction: float = 0.25, seed: int | str = 0,
                  key: Sequence[str] = PHOTO) -> DataFrame:
    """Side of each photo: the first round(n * fraction), halves to even, along a keyed hash are validation.

    One row per photo, so all variants of a photo land on one side.
    """
    key = list(key)
    photos = df.select(*key).distinct().withColumn("_h", photo_digest(seed, key))
    counted = hash_ranked(photos, "_h", "_rn").crossJoin(
        F.broadcast(photos.agg(F.count(F.lit(1)).alias("_n"))))
    return counted.select(*key, F.when(
        F.col("_rn") <= F.bround(F.col("_n") * fraction), "validation").otherwise("training").alias("side"))


def deal_sizes(sizes: Sequence[tuple[int, int]], folds: int) -> list[tuple[int, list[int], list[int]]]:
    """How photos of each size (size, number; largest first) go to the lightest fold: (size, cuts, turns).

    Photos up to cuts[i] of a size level fold i with the heaviest one; the others go round in ``turns``.
    """
    load = [0] * folds
    out = []
    for size, number in sizes:
        def needed(level: int, size: int = size) -> list[int]:
            return [max(0, (level - x) // size) for x in load]

        low, high = min(load), max(load)
        while low < high:                                  # the highest level that the photos of this size can fill
            middle = (low + high + 1) // 2
            low, high = (middle, high) if sum(needed(middle)) <= number else (low, middle - 1)
        filled = needed(low)
        load = [x + size * n for x, n in zip(load, filled)]
        turns = sorted(range(folds), key=lambda f: (load[f], f))
        rounds, more = divmod(number - sum(filled), folds)
        for place, fold in enumerate(turns):
            load[fold] += size * (rounds + (place < more))
        out.append((size, [sum(filled[:i + 1]) for i in range(folds)], turns))
    return out


def kfold(df: DataFrame, folds: int = 5, key: Sequence[str] = PHOTO, seed: int | str = 0) -> DataFrame:
    """Fold of each photo, folds balanced by rows: in order of size, largest first, and of hash within a size, photos
    go to the lightest fold.

    Only the number of photos of each size reaches the driver; a corpus has as many sizes as it has variants.
    """
    key = list(key)
    photos = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_h", photo_digest(seed, key))
    sizes = [(r["_rows"], r["count"]) for r in photos.groupBy("_rows").count().orderBy(F.desc("_rows")).collect()]
    plan = df.sparkSession.createDataFrame(deal_sizes(sizes, folds), "_rows long, _cuts array<long>, _turns array<int>")
    numbered = hash_ranked(photos, "_h", "_rn", ["_rows"]).join(plan, "_rows")
    at, level = F.col("_rn") - 1, F.element_at("_cuts", -1)
    return numbered.select(*key, F.when(at < level, F.size(F.filter("_cuts", lambda c: c <= at))).otherwise(
        F.get("_turns", F.pmod(at - level, F.lit(folds)).cast("int"))).cast("int").alias("fold"))


def rows_in(df: DataFrame, split: DataFrame, side: str, key: Sequence[str] = PHOTO) -> DataFrame:
    """Rows of photos on one side. No broadcast hint: AQE decides by the size it measures."""
    return df.join(split.where(F.col("side") == side).select(*key), list(key), "left_semi")


def rows_not_in(df: DataFrame, split: DataFrame, side: str, key: Sequence[str] = PHOTO) -> DataFrame:
    return df.join(split.where(F.col("side") == side).select(*key), list(key), "left_anti")


# ---------------------------------------------------------------- numbering
def dense_photo_ids(df: DataFrame, source: str, name: str, out: str = "photo_id") -> DataFrame:
    """Dense number of each distinct name within its source, starting at 0."""
    names = df.select(source, name).distinct()
    numbered = ranked(names, name, "_rn", [source]).select(source, name, (F.col("_rn") - 1).alias(out))
    return df.join(numbered, [source, name])


def number_photos(paths: DataFrame, offset: int = 0, source: str = "source", path: str = "path") -> DataFrame:
    """Photo ids along the path order of each source, from an offset."""
    return ranked(paths, path, "_rn", [source]).withColumn(
        "photo_id", F.col("_rn") - 1 + offset).drop("_rn")


def first_per_source(paths: DataFrame, limit: int, source: str = "source", path: str = "path") -> DataFrame:
    """At most ``limit`` photos per source, in path order (0 keeps all)."""
    if limit <= 0:
        return paths
    if limit <= LIMITED:
        # Spark keeps so many rows per source and task before it shuffles them
        rank = F.row_number().over(Window.partitionBy(source).orderBy(path))
        return paths.withColumn("_rn", rank).where(F.col("_rn") <= limit).drop("_rn")
    return ranked(paths, path, "_rn", [source]).where(F.col("_rn") <= limit).drop("_rn")


# ---------------------------------------------------------------- unions
def concat_datasets(*tables: DataFrame) -> DataFrame:
    """Stack labelled datasets; the feature columns must agree exactly."""
    want = set(feature_columns(tables[0]))
    for t in tables[1:]:
        if set(feature_columns(t)) != want:
            raise MissingColumns(f"datasets differ in {sorted(want ^ set(feature_columns(t)))[:6]}")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def class_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(F.col("label") == 0).alias("n_clean"),
                               F.count_if(F.col("label") == 1).alias("n_stego"),
                               F.count(F.lit(1)).alias("n_total"))


def distinct_photos(df: DataFrame, by: Sequence[str] = (), key: Sequence[str] = PHOTO) -> DataFrame:
    """Photos counted by their full identity; two-step, so a large group is combined first."""
    rest = [c for c in key if c not in by]
    return (df.select(*by, *rest).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_photos")))
