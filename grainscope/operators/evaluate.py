"""Evaluation of scores against labels: ROC, thresholds, rates, intervals, bootstrap.

Scores are first aggregated to one row per distinct score; the cumulative counts along the
score order then come from ``running_totals``, which never sorts a group in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainscope.functions.columns import ratio, wilson
from grainscope.functions.ordering import hash_ranked, order_buckets, running_totals, with_order_bucket
from grainscope.session import save_and_reload, settle, shared_dir


def score_counts(scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label",
                 weight: Column | None = None) -> DataFrame:
    """Positives and negatives per distinct score; NULL scores take no part."""
    w = weight if weight is not None else F.lit(1).cast("long")
    return (scored.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("neg")))


def auc(scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label",
        weight: Column | None = None) -> DataFrame:
    """Area under the ROC curve with ties counted half; NULL with one class only."""
    by = list(by)
    counts = score_counts(scored, by, score, label, weight)
    ranked = running_totals(counts, "score", {"neg_upto": F.col("neg")}, by)
    # pairs of a positive above a negative, in halves: below = upto - own
    halves = F.col("pos").cast("double") * (2 * F.col("neg_upto") - F.col("neg"))
    sums = ranked.groupBy(*by).agg(F.sum(halves).alias("_h"), F.sum("pos").alias("n_pos"),
                                   F.sum("neg").alias("n_neg"))
    return sums.select(*by, "n_pos", "n_neg", ratio(
        F.col("_h"), 2.0 * F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"))


def roc(scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """One ROC point per distinct score: rates of rows with a score at or above it."""
    by = list(by)
    counts = settle(score_counts(scored, by, score, label))
    cumulated = running_totals(counts, "score", {"tp": F.col("pos"), "fp": F.col("neg")}, by, descending=True, stored=True)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    joined = cumulated.join(totals, by) if by else cumulated.crossJoin(F.broadcast(totals))
    return joined.select(*by, F.col("score").alias("threshold"), "tp", "fp",
                         ratio(F.col("tp"), F.col("n_pos")).alias("tpr"),
                         ratio(F.col("fp"), F.col("n_neg")).alias("fpr"))


def thresholds(scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label",
               max_fp: float = 0.10) -> DataFrame:
    """Youden and low-false-positive thresholds per group.

    Only finite thresholds exist here, so neither can become infinite. Youden ties go to
    the largest threshold. The low-FP threshold is the smallest one with FPR <= max_fp and
    TPR > 0. Both default to 0.5 when nothing qualifies.
    """
    points = roc(scored, by, score, label)
    gain = F.col("tpr") - F.col("fpr")
    low = (F.col("fpr") <= max_fp) & (F.col("tpr") > 0)
    return points.groupBy(*by).agg(
        F.coalesce(F.max_by("threshold", F.struct(gain.alias("j"), "threshold")), F.lit(0.5)).alias("youden"),
        F.coalesce(F.min(F.when(low, F.col("threshold"))), F.lit(0.5)).alias("low_fp"))


def confusion(scored: DataFrame, by: Sequence[str] = (), pred: str = "pred", label: str = "label") -> DataFrame:
    """Confusion counts and the rates derived from them, per group."""
    def n(l: int, p: int) -> Column:
        return F.count_if((F.col(label) == l) & (F.col(pred) == p))

    c = scored.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(0, 0).alias("tn"), n(1, 0).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    named = c.select("*", ratio(tp, tp + fn).alias("tpr"), ratio(fp, fp + tn).alias("fpr"),
                     ratio(tn, fp + tn).alias("tnr"), ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                     ratio(tp, tp + fp).alias("precision_1"), ratio(tn, tn + fn).alias("precision_0"))

    def f1(p: str, r: str) -> Column:
        return ratio(2.0 * F.col(p) * F.col(r), F.col(p) + F.col(r))

    return named.select("*", ((F.col("tpr") + F.col("tnr")) / 2.0).alias("balanced_accuracy"),
                        f1("precision_1", "tpr").alias("f1_1"), f1("precision_0", "tnr").alias("f1_0"))


def detection_rates(scored: DataFrame, by: Sequence[str], prob: str, threshold: Column) -> DataFrame:
    """Detected rows per group. NULL keys (clean rows have no method) stay a group."""
    hit = (F.col(prob) >= threshold).cast("int")
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("n_detected"),
                                   F.avg(hit).alias("detection_rate"))


def clean_false_positives(rates: DataFrame) -> DataFrame:
    """Worst false-positive rate over the clean variants."""
    clean = rates.where(F.col("variant").isin("clean", "clean_jpeg"))
    return clean.agg(F.coalesce(F.max("detection_rate"), F.lit(0.0)).alias("clean_fp"))


def exact_quantiles(values: DataFrame, by: Sequence[str], value: str, share: float, name: str, n: str | None = None) -> DataFrame:
    """Exact quantile per group, linear between the two neighbours like ``percentile``: rows (by, name).

    ``n`` is a column with the number of times a row counts (1 without it). Rows are reduced to counts per distinct value;
    two passes over order-preserving buckets of these follow: bucket totals show in which bucket the two places lie, and
    only rows of those buckets are ranked. No group is in one task. NULL values take no part.
    """
    by = list(by)
    counted = settle(values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(
        F.sum(F.col(n) if n else F.lit(1)).cast("long").alias("_n")))
    placed = settle(with_order_bucket(counted, "_v"))
    sizes = placed.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_rows"))
    group = Window.partitionBy(*by)
    upto = F.sum("_rows").over(group.orderBy("_bucket"))
    place = (F.sum("_rows").over(group) - 1) * share
    spans = sizes.withColumns({"_upto": upto, "_lo": F.floor(place), "_hi": F.ceil(place), "_part": place - F.floor(place)}).withColumn(
        "_before", F.col("_upto") - F.col("_rows"))

    def within(at: str) -> Column:
        return (F.col(at) >= F.col("_before")) & (F.col(at) < F.col("_upto"))

    near = placed.join(spans.where(within("_lo") | within("_hi")), [*by, "_bucket"])
    reach = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_bucket").orderBy("_v"))
    ranked = near.withColumn("_reach", reach)

    def pick(at: str) -> Column:
        return F.max(F.when((F.col(at) < F.col("_reach")) & (F.col(at) >= F.col("_reach") - F.col("_n")), F.col("_v")))

    found = ranked.groupBy(*by).agg(pick("_lo").alias("_a"), pick("_hi").alias("_b"), F.max("_part").alias("_part"))
    return found.select(*by, ((1 - F.col("_part")) * F.col("_a") + F.col("_part") * F.col("_b")).alias(name))


def false_positive_summary(scored: DataFrame) -> DataFrame:
    """False positives per model, setting and source, with an ALL row and Wilson bounds.

    The median comes from counts per distinct probability by ``exact_quantiles``; a source with most of the photos is
    combined map-side first and ranked by buckets.
    """
    # each photo counts for its source and for the row of all
    both = scored.select("model", "clip", "ml_prob", "pred_stego", F.explode(F.array(
        F.struct(F.lit(False).alias("all"), F.col("source")),
        F.struct(F.lit(True).alias("all"), F.lit("ALL").alias("source")))).alias("g")).select("model", "clip", "g.*", "ml_prob", "pred_stego")
    by = ["model", "clip", "all", "source"]
    counted = settle(both.groupBy(*by, "ml_prob").agg(F.count(F.lit(1)).alias("_n"), F.sum("pred_stego").alias("_k")))
    totals = counted.groupBy(*by).agg(F.sum("_n").alias("n_photos"), F.sum("_k").alias("n_false_positive"))
    medians = exact_quantiles(counted, by, "ml_prob", 0.5, "median_prob", "_n").withColumnsRenamed({c: f"m_{c}" for c in by})
    grouped = totals.join(medians, [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in by], "left")
    k, n = F.col("n_false_positive"), F.col("n_photos")
    lo, hi = wilson(k, n)
    return grouped.select(
        "model", F.col("clip").alias("clip_outliers"), "source", "n_photos", "n_false_positive", F.round(ratio(k, n), 4).alias("fp_rate"),
        F.round(lo, 4).alias("fp_ci_lo"), F.round(hi, 4).alias("fp_ci_hi"), F.round("median_prob", 6).alias("median_prob"))


SLOTS = 4096            # photos whose draws one task counts
DRAWS = 1024            # draws made at once
SCORES = 256            # distinct scores summed up at once
HELD = 2048             # vectors of distinct scores and classes that a task adds to before it passes them on


def numbered_photos(photos: DataFrame, key: Sequence[str], seed: str = "0") -> DataFrame:
    """Photos (key, slot), numbered 0..n-1 along a hash."""
    key = list(key)
    hashed = photos.select(*key).distinct().withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), *key)))
    return settle(hash_ranked(hashed, "_h", "slot").select(*key, (F.col("slot") - 1).alias("slot")))


def multiplicities(spark: SparkSession, n: int, replicates: int, seed: str = "0") -> DataFrame:
    """How often a bootstrap with replacement takes each of ``n`` photos: rows (slot, times array<smallint>), one entry
    per replicate.

    Draw d of replicate b takes the photo numbered md5(seed:b:d) mod n. Tasks draw for all replicates at once and deal
    packed arrays of (slot, replicate) to the tasks that count them, SLOTS photos each; so rows are as many as photos, and
    the entries of all draws move once.
    """
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = [f"{seed}:{b}:".encode() for b in range(replicates)]
        for batch in batches:
            for a in range(0, len(batch), DRAWS):
                tails = [str(d).encode() for d in batch.column(0).slice(a, DRAWS).to_pylist()]
                slot = np.fromiter((int.from_bytes(hashlib.md5(h + t).digest()[:6], "big") % n for t in tails for h in heads),
                                   np.int64, len(tails) * replicates)
                replicate = np.tile(np.arange(replicates, dtype=np.int32), len(tails))
                order = np.argsort(slot // SLOTS, kind="stable")
                block, counts = np.unique(slot // SLOTS, return_counts=True)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block), pa.ListArray.from_arrays(offsets, pa.array((slot[order] % SLOTS).astype(np.int32))),
                     pa.ListArray.from_arrays(offsets, pa.array(replicate[order]))], ["block", "slot", "replicate"])

    def count(t: pa.Table) -> pa.Table:
        block = t["block"][0].as_py()
        slots = min(SLOTS, n - block * SLOTS)
        times = np.zeros(slots * replicates, np.int64)
        for s, r in zip(t["slot"].chunks, t["replicate"].chunks):
            times += np.bincount(s.flatten().to_numpy().astype(np.int64) * replicates + r.flatten().to_numpy(), minlength=len(times))
        offsets = pa.array(np.arange(slots + 1, dtype=np.int32) * replicates)
        return pa.table({"slot": pa.array(block * SLOTS + np.arange(slots)),
                         "times": pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int16)))})

    drawn = spark.range(n).mapInArrow(draw, "block long, slot array<int>, replicate array<int>")
    return drawn.groupBy("block").applyInArrow(count, "slot long, times array<smallint>")


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return chunk.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def bootstrap_aucs(scored: DataFrame, key: Sequence[str], replicates: int = 1000, score: str = "score",
                   label: str = "label", seed: str = "0") -> DataFrame:
    """AUC of each replicate when whole photos are resampled: rows (replicate, auc); NULL with one class only.

    A photo brings its vector of multiplicities. Vectors are added up per score and class, first within the tasks that join
    them, then in order-preserving buckets of scores, where one running sum over vectors gives all replicates' partial
    areas; the buckets' totals, one row each, finish them.
    """
    key = list(key)
    spark = scored.sparkSession
    slots = numbered_photos(scored, key, seed)
    n = slots.count()
    if n == 0:
        return spark.createDataFrame([], "replicate int, auc double")
    counts = score_counts(scored, key, score, label).join(slots, key).select("slot", "score", "pos", "neg")
    # vectors are many times wider than Spark estimates: never a broadcast side
    vectors = multiplicities(spark, n, replicates, seed).hint("merge")
    joined = counts.join(vectors, "slot").select("score", "pos", "neg", "times")

    def added(value: np.ndarray, positive: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((positive, value))
        value, positive, vectors = value[order], positive[order], vectors[order]
        first = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (positive[1:] != positive[:-1])])[:len(value)])
        return value[first], positive[first], np.add.reduceat(vectors, first, axis=0) if len(first) else vectors

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def rows() -> pa.RecordBatch:
            value, positive, vectors = held[0]
            return pa.RecordBatch.from_arrays([pa.array(value), pa.array(positive), pa.ListArray.from_arrays(
                pa.array(np.arange(len(value) + 1, dtype=np.int32) * replicates), pa.array(vectors.ravel()))], ["score", "positive", "times"])

        for batch in batches:
            for a in range(0, len(batch), DRAWS):
                part = batch.slice(a, DRAWS)
                value, pos, neg = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                times = _matrix(part.column(3), replicates)
                which = np.concatenate([np.flatnonzero(pos), np.flatnonzero(neg)])
                positive = np.repeat([True, False], [np.count_nonzero(pos), np.count_nonzero(neg)])
                weight = np.where(positive, pos[which], neg[which])
                held.append(added(value[which].astype(np.float64), positive, times[which] * weight[:, None]))
                held = [added(*(np.concatenate(x) for x in zip(*held)))]
                if len(held[0][0]) > HELD:
                    yield rows()
                    held = []
        if held:
            yield rows()

    def bucket(t: pa.Table) -> pa.Table:
        value, positive = t["score"].to_numpy(), t["positive"].to_numpy(zero_copy_only=False)
        order = np.argsort(value, kind="stable")
        ends = np.concatenate([np.flatnonzero(np.diff(value[order])) + 1, [len(value)]])
        pos, neg, halves = (np.zeros(replicates, np.int64) for _ in range(3))
        first = 0
        while first < len(value):           # whole scores, a few hundred rows at a time or one score
            last = int(ends[max(np.searchsorted(ends, first + SCORES, "right") - 1, np.searchsorted(ends, first, "right"))])
            rows = order[first:last]
            times = _matrix(t["times"].combine_chunks().take(pa.array(rows)), replicates)
            _, scores = np.unique(value[rows], return_inverse=True)
            p, q = (np.zeros((scores[-1] + 1, replicates), np.int64) for _ in range(2))
            np.add.at(p, scores[positive[rows]], times[positive[rows]])
            np.add.at(q, scores[~positive[rows]], times[~positive[rows]])
            below = neg + np.cumsum(q, axis=0) - q
            halves += (p * (2 * below + q)).sum(axis=0)
            pos, neg, first = pos + p.sum(axis=0), neg + q.sum(axis=0), last
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (pos, neg, halves)]
        return pa.table([pa.array([t["_bucket"][0].as_py()], pa.int32()), *lists], names=["bucket", "pos", "neg", "halves"])

    partial = save_and_reload(joined.mapInArrow(combine, "score double, positive boolean, times array<bigint>"), shared_dir(spark))
    buckets = max(order_buckets(scored), partial.count() // SLOTS)
    placed = with_order_bucket(partial, "score", buckets)
    totals = placed.groupBy("_bucket").applyInArrow(
        bucket, "bucket int, pos array<bigint>, neg array<bigint>, halves array<bigint>")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        order = np.argsort(t["bucket"].to_numpy())
        pos, neg, halves = (_matrix(t[c], replicates)[order] for c in ("pos", "neg", "halves"))
        area = (halves + 2 * pos * (np.cumsum(neg, axis=0) - neg)).sum(axis=0).astype(np.float64)
        pairs = 2.0 * pos.sum(axis=0) * neg.sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            aucs = area / pairs
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates), pa.int32()), pa.array(aucs, pa.float64(), mask=pairs == 0)],
                                         ["replicate", "auc"])

    # one row per bucket is left
    return totals.repartition(1).mapInArrow(finish, "replicate int, auc double")


def bootstrap_auc_interval(scored: DataFrame, key: Sequence[str], replicates: int = 1000,
                           alpha: float = 0.05, score: str = "score", label: str = "label",
                           seed: str = "0") -> DataFrame:
    """Percentile interval of the AUC when whole photos are resampled. A replicate with one class is left out."""
    each = bootstrap_aucs(scored, key, replicates, score, label, seed)
    return each.where(F.col("auc").isNotNull()).agg(
        F.count(F.lit(1)).alias("n_replicates"),
        F.percentile("auc", F.lit(alpha / 2)).alias("auc_lo"),
        F.percentile("auc", F.lit(1 - alpha / 2)).alias("auc_hi"))


def score_histogram(scored: DataFrame, prob: str = "ml_prob", bins: int = 30,
                    by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram between the smallest and largest probability of a group."""
    by = list(by)
    ends = scored.groupBy(*by).agg(F.min(prob).alias("_lo"), F.max(prob).alias("_hi"))
    joined = scored.join(ends, by) if by else scored.crossJoin(F.broadcast(ends))
    place = F.least(F.floor((F.col(prob) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins),
                    F.lit(bins - 1))
    return (joined.withColumn("bin", F.when(F.col("_hi") > F.col("_lo"), place).otherwise(0).cast("int"))
            .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"),
                                     F.count_if(F.col("pred_stego") == 1).alias("n_false_positive")))


def wins(folds: DataFrame, key: Sequence[str], a: str, b: str) -> DataFrame:
    """Paired comparison of two models over splits: means, sample deviations and wins."""
    wide = folds.groupBy(*key).agg(F.max(F.when(F.col("model") == a, F.col("auc"))).alias("a"),
                                   F.max(F.when(F.col("model") == b, F.col("auc"))).alias("b"))
    return wide.agg(F.avg("a").alias("mean_a"), F.stddev_samp("a").alias("std_a"),
                    F.avg("b").alias("mean_b"), F.stddev_samp("b").alias("std_b"),
                    F.count_if(F.col("a") > F.col("b")).alias("wins_a"),
                    F.count_if(F.col("b") > F.col("a")).alias("wins_b"))


def spread_over_seeds(aucs: DataFrame, by: Sequence[str], value: str = "auc") -> DataFrame:
    """Mean, population and sample deviation, extremes and count per group of runs."""
    return aucs.groupBy(*by).agg(
        F.avg(value).alias("auc_mean"), F.stddev_pop(value).alias("auc_std_pop"),
        F.stddev_samp(value).alias("auc_std"), F.min(value).alias("auc_min"),
        F.max(value).alias("auc_max"), F.count(value).alias("n_seeds"))


def correlation_pairs(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns.

    MLlib folds the rows into one matrix of columns x columns (30 x 30 at most here), which
    is then unfolded to rows.
    """
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="skip").transform(
        table.select(*[F.col(c).cast("double") for c in columns])).select("_x")
    matrix = Correlation.corr(vectors, "_x").first()[0].toArray()
    rows = [(a, b, float(matrix[i, j])) for i, a in enumerate(columns)
            for j, b in enumerate(columns) if i < j]
    return table.sparkSession.createDataFrame(rows, "a string, b string, r double")


def correlation_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.avg("r").alias("corr_mean"), F.stddev_pop("r").alias("corr_std"), F.min("r").alias("corr_min"),
        F.max("r").alias("corr_max"),
        *[F.percentile("r", F.lit(q / 100)).alias(f"corr_p{q}") for q in (5, 25, 50, 75, 95)])


def outlier_bounds(table: DataFrame, columns: Sequence[str], sigmas: float = 5.0) -> DataFrame:
    """Mean -+ k population deviations per column, one row per feature."""
    stats = table.agg(*[agg(c).alias(f"{tag}{i}") for i, c in enumerate(columns)
                        for tag, agg in (("m", F.avg), ("s", F.stddev_pop))])
    rows = stats.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"),
                 F.greatest(F.col(f"s{i}"), F.lit(1e-9)).alias("sd")) for i, c in enumerate(columns)])))
    return rows.select("feature", "mean", "sd", (F.col("mean") - sigmas * F.col("sd")).alias("lo"),
                       (F.col("mean") + sigmas * F.col("sd")).alias("hi"))


def importance_ranked(gains: DataFrame) -> DataFrame:
    """Rank, share and cumulative share of feature gains per model; ties keep feature order.

    A model has as many rows as features (143 at most).
    """
    w = Window.partitionBy("model").orderBy(F.desc("gain"), F.asc("position"))
    total = F.sum("gain").over(Window.partitionBy("model"))
    return (gains.withColumn("rank", F.row_number().over(w))
            .withColumn("gain_pct", F.when(total > 0, F.col("gain") / total).otherwise(0.0))
            .withColumn("gain_cum", F.sum("gain_pct").over(w.rowsBetween(Window.unboundedPreceding, 0))))


def importance_groups(gains: DataFrame, group: Column) -> DataFrame:
    """Sum, share, mean, deviation and extremes of gain per feature family and model."""
    grouped = gains.withColumn("group", group).groupBy("model", "group").agg(
        F.count(F.lit(1)).alias("n_feat"), F.sum("gain").alias("gain_sum"), F.avg("gain").alias("gain_mean"),
        F.stddev_pop("gain").alias("gain_std"), F.max("gain").alias("gain_max"), F.min("gain").alias("gain_min"))
    total = F.sum("gain_sum").over(Window.partitionBy("model"))
    return grouped.withColumn("gain_pct", F.when(total > 0, F.col("gain_sum") / total).otherwise(0.0))


def single_feature_auc(table: DataFrame, features: Sequence[str], fold: str = "fold",
                       label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Mean and deviation over folds of the AUC each feature reaches alone.

    A one-feature logistic model is monotone, so its AUC on a fold is the rank AUC of the
    feature, turned over when the feature correlates negatively with the label on the other
    folds. Those correlations come from per-fold sums.
    """
    long = table.select(fold, F.col(label).alias("label"), F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("score")) for f in features])))
    y, x = F.col("label").cast("double"), F.col("score")
    sums = settle(long.groupBy("feature", fold).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("x"),
                                                    F.sum(y).alias("y"), F.sum(x * y).alias("xy")))
    names = ["n", "x", "y", "xy"]
    whole = sums.groupBy("feature").agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    rest = sums.join(whole, "feature").select("feature", fold, *[
        (F.col(f"t_{c}") - F.col(c)).alias(c) for c in names])
    sign = rest.select("feature", fold, (F.col("n") * F.col("xy") - F.col("x") * F.col("y") >= 0).alias("_up"))
    each = auc(long, ["feature", fold]).join(sign, ["feature", fold]).where(F.col("auc").isNotNull())
    return (each.withColumn("auc", F.when(F.col("_up"), F.col("auc")).otherwise(1.0 - F.col("auc")))
            .groupBy("feature").agg(F.avg("auc").alias("single_auc_mean"),
                                    F.stddev_pop("auc").alias("single_auc_std")))
