"""Remove repeated passages of lines: overlapping windows of consecutive lines, compared over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainscope.llm.columns import bind
from grainscope.session import save_and_reload, shared_dir

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_windows(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """One row per window of consecutive lines: (_id, _t, pos, h1, h2); two 64-bit hashes name its content."""
    def hashes(lines: Column, i: Column) -> Column:
        parts = [F.get(lines, i + k) for k in range(window)]
        return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(window), *parts[::-1]).alias("h2"))

    def all_windows(lines: Column) -> Column:
        return F.when(F.size(lines) >= window, F.transform(
            F.sequence(F.lit(0), F.size(lines) - window), lambda i: hashes(lines, i)))

    text = F.col(text_col)
    found = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_t"), F.posexplode(
        bind(_lines(text), all_windows)).alias("pos", "_h"))
    return found.select("_id", "_t", "pos", "_h.h1", "_h.h2")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the later occurrences of repeated windows removed from the text.

    Windows of ``window`` consecutive lines are compared everywhere, within a document too; the occurrence with the
    smallest (id, position) stays, and all lines covered by a later one go. All columns stay; ``text`` is replaced
    and ``n_lines``, ``n_removed`` and ``n_spans`` (maximal removed runs) are added, in place of columns of these
    names. A text with fewer lines than the window, an empty one and NULL are unchanged (NULL has no lines). Rows
    that repeat both id and text are one document: all of them lose the same lines. A NULL id comes first.

    The table of windows is written once and counted by partial aggregation, so that a very common window is one
    row per task; only the repeated windows are joined back, between two exchanges that AQE can split.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    windows = save_and_reload(line_windows(docs, id_col, text_col, window), f"{folder}/windows")
    place = F.struct("_id", "_t", "pos")
    repeated = save_and_reload(
        windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
        .select("h1", "h2", "first"), f"{folder}/repeated")
    later = windows.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy("_id", "_t").agg(F.array_sort(F.array_distinct(F.flatten(
        F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + (window - 1)))))).alias("_gone"))

    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_spans")]
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("_row"), F.col(id_col).alias("_id"),
                       F.xxhash64(text_col).alias("_t"), F.col(text_col).alias("_text"))
    joined = left.join(covered.withColumnsRenamed({"_id": "_id2", "_t": "_t2"}),
                       F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_t") == F.col("_t2")), "left")
    gone = F.col("_gone")

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    text = F.when(gone.isNull(), F.col("_text")).otherwise(bind(_lines(F.col("_text")), rest))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in kept_columns],
        F.when(F.col("_text").isNull(), 0).otherwise(F.size(_lines(F.col("_text")))).cast("long").alias("n_lines"),
        F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"),
        F.when(gone.isNull(), 0).otherwise(F.size(F.array_except(
            gone, F.transform(gone, lambda p: p + 1)))).cast("long").alias("n_spans"))
