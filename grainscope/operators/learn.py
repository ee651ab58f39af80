"""Training and scoring with MLlib and its boosting in tasks: grouped folds, stacking, calibration, batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainscope.operators.boosting import Fit, boosted_scores, fits_in_tasks, forest_scores
from grainscope.operators.corpus import kfold
from grainscope.operators.evaluate import auc, outlier_bounds
from grainscope.schemas import KEY, PHOTO
from grainscope.session import save_and_reload, shared_dir

T = TypeVar("T")
VECTOR = "feature_vector"

# Training parameters per classifier name. LGB and XGB are boosted trees in
# MLlib; a depth of 5 stands for 31 leaves.
PARAMETERS = {
    "LR": {"C": 0.1, "maxIter": 2000},
    "RF": {"numTrees": 500, "maxDepth": 20},
    "GB": {"maxIter": 300, "stepSize": 0.05, "maxDepth": 3},
    "XGB": {"maxIter": 400, "stepSize": 0.05, "maxDepth": 4, "subsamplingRate": 0.9,
            "featureSubsetStrategy": "0.8"},
    "LGB": {"maxIter": 800, "stepSize": 0.03, "maxDepth": 5, "minInstancesPerNode": 10,
            "subsamplingRate": 0.9, "featureSubsetStrategy": "0.8"},
}
# What the comparison of feature sets changes in them.
GRID_PARAMETERS = {
    "LR": {"C": 1.0},
    "XGB": {"maxIter": 500, "maxDepth": 5},
    "LGB": {"featureSubsetStrategy": "0.9"},
}
IN_TASK = {"RF": forest_scores, "GB": boosted_scores, "XGB": boosted_scores, "LGB": boosted_scores}
IN_TASK_BYTES = 64 << 20    # trees of tables up to this size take one task a fit


def pipeline(name: str, features: Sequence[str], n_rows: int, seed: int = 0, weight: str | None = None,
             stored: Sequence[str] | None = None, **override) -> Pipeline:
    """Untrained pipeline by classifier name. Scaling is fitted inside the pipeline, hence
    inside each fold. MLlib's penalty of a mean loss is 1 / (C n).

    ``stored`` names the columns that the vector column VECTOR already holds; it is then sliced in place of assembling
    ``features`` from columns, which spares every fit a plan over all of them."""
    p = {**PARAMETERS[name], **override}
    if stored is None:
        assemble = VectorAssembler(inputCols=list(features), outputCol="raw_features")
    else:
        place = {c: i for i, c in enumerate(stored)}
        assemble = VectorSlicer(inputCol=VECTOR, outputCol="raw_features", indices=[place[f] for f in features])
    common = {"featuresCol": "features", "labelCol": "label", **({"weightCol": weight} if weight else {})}
    if name == "LR":
        scale = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)
        clf: Estimator = LogisticRegression(maxIter=p["maxIter"], regParam=1.0 / (p["C"] * max(n_rows, 1)),
                                            standardization=False, **common)
        return Pipeline(stages=[assemble, scale, clf])
    assemble.setOutputCol("features")
    kind = RandomForestClassifier if name == "RF" else GBTClassifier
    return Pipeline(stages=[assemble, kind(seed=seed, **p, **common)])


def scored(model: PipelineModel, df: DataFrame, out: str = "prob") -> DataFrame:
    """Add the probability of label 1 and drop MLlib's working columns."""
    extra = ["raw_features", "features", "rawPrediction", "probability", "prediction"]
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop(*extra)


def weak_variant_weight(factor: float) -> Column:
    """Weight of rows coded by the hardest method; 1 for all others, clean rows included."""
    return F.when(F.col("method") == "nsF5", factor).otherwise(1.0)


# ---------------------------------------------------------------- many fits
def fit_all(fits: Sequence[Callable[[], T]], parallelism: int = 8) -> list[T]:
    """Results of independent fits, in their order, with so many jobs at once. A fit of a small table leaves most of a
    cluster idle, and a boosted model is a long chain of small jobs; other fits fill the gaps."""
    spark = SparkSession.getActiveSession()
    with ThreadPool(max(1, min(parallelism, len(fits)))) as pool:
        # wrapped one by one: threads that share one set of local properties clear each other's execution ids
        return pool.map(lambda fit: fit(), [inheritable_thread_target(spark)(fit) for fit in fits], chunksize=1)


def _in_task(name: str, n_rows: int, n_columns: int) -> bool:
    return name in IN_TASK and n_rows * n_columns * 8 <= IN_TASK_BYTES


def _folded(df: DataFrame, folds: int, photo: Sequence[str], seed: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows with their fold, written once, and the rows of each fold: the penalty counts the rows of a fit."""
    with_fold = save_and_reload(df.join(kfold(df, folds, photo, seed), list(photo)), shared_dir(df.sparkSession))
    return with_fold, {r["fold"]: r["count"] for r in with_fold.groupBy("fold").count().collect()}


def run_grid(df: DataFrame, sets: dict[str, Sequence[str]], names: Sequence[str], seeds: Sequence[int] = (0,), folds: int = 5,
             key: Sequence[str] = KEY, photo: Sequence[str] = PHOTO, weight: str | None = None,
             override: dict[str, dict] | None = None, parallelism: int = 8, models: str | None = None) -> DataFrame:
    """Out-of-fold scores of every feature set, classifier and seed: rows (stage, model, seed, fold, key, label, prob).

    Folds are dealt by photo, once per seed. A fit sees the rows of all other folds, scores its own fold and writes the
    scores at once, as a partition of one table; so the plan of the result is one scan however many fits there were, and
    a photo is scored only by models that never saw it. Fitted models are kept below the folder ``models`` if it is given.
    Folds without photos have no fit.

    Boosted fits and forests of tables up to IN_TASK_BYTES take a task each, all in one job, whose scores are a second scan;
    those that have weights or whose models are kept are MLlib's, as are all of larger tables.
    """
    spark = df.sparkSession
    out = shared_dir(spark)
    fits, in_tasks = [], []
    columns = list(dict.fromkeys(f for features in sets.values() for f in features))
    vectors = save_and_reload(VectorAssembler(inputCols=columns, outputCol=VECTOR).transform(df).select(
        *dict.fromkeys([*key, *photo, "label", *([weight] if weight else []), VECTOR])), shared_dir(spark))
    parts = vectors
    for seed in seeds:
        table, sizes = _folded(vectors, folds, photo, seed)
        parts = parts.join(table.select(*photo, F.col("fold").alias(f"fold_{seed}")).distinct(), list(photo))
        for fold in sorted(sizes):
            n_rows = sum(n for f, n in sizes.items() if f != fold)
            for stage, features in sets.items():
                for name in names:
                    if not weight and not models and _in_task(name, sum(sizes.values()), len(columns)):
                        in_tasks.append(Fit(IN_TASK[name], {"stage": stage, "model": name, "seed": seed, "fold": fold}, f"fold_{seed}", fold,
                                            [columns.index(f) for f in features], {**PARAMETERS[name], **(override or {}).get(name, {}), "seed": seed}))
                        continue

                    def fit(table=table, fold=fold, n_rows=n_rows, stage=stage, features=features, name=name, seed=seed):
                        place = f"stage={stage}/model={name}/seed={seed}/fold={fold}"
                        train, test = table.where(F.col("fold") != fold), table.where(F.col("fold") == fold)
                        model = pipeline(name, features, n_rows, seed, weight, columns, **(override or {}).get(name, {})).fit(train)
                        scored(model, test).select(*key, "label", "prob").write.mode("overwrite").parquet(f"{out}/{place}")
                        if models:
                            model.write().overwrite().save(f"{models}/{place}")
                    fits.append(fit)
    apart = shared_dir(spark)
    whole = [lambda: fits_in_tasks(parts, VECTOR, key, in_tasks).write.parquet(apart)] if in_tasks else []
    fit_all(whole + fits, parallelism)
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (*key, "label")] + ["prob double, stage string, model string, seed int, fold int"])
    tables = [spark.read.schema(schema).parquet(path) for path, made in ((out, fits), (apart, whole)) if made]
    return tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])


def out_of_fold(df: DataFrame, features: Sequence[str], names: Sequence[str], folds: int = 5,
                seed: int = 0, key: Sequence[str] = KEY, photo: Sequence[str] = PHOTO,
                weight: str | None = None, override: dict[str, dict] | None = None) -> DataFrame:
    """Every row scored once per classifier by a model that never saw its photo: rows (key, label, fold, model, prob)."""
    grid = run_grid(df, {"all": features}, names, [seed], folds, key, photo, weight, override)
    return grid.select(*key, "label", "fold", "model", "prob")


def stack(oof: DataFrame, names: Sequence[str], key: Sequence[str] = KEY) -> tuple[PipelineModel, DataFrame]:
    """Logistic model over out-of-fold probabilities, joined by row key, and its scores."""
    wide = oof.groupBy(*key, "label").agg(*[
        F.max(F.when(F.col("model") == n, F.col("prob"))).alias(f"p_{n}") for n in names]).dropna()
    columns = [f"p_{n}" for n in names]
    model = pipeline("LR", columns, wide.count(), C=1.0).fit(wide)
    return model, scored(model, wide).select(*key, "label", F.lit("STACK").alias("model"), "prob")


def candidate_aucs(scores: DataFrame) -> DataFrame:
    return auc(scores, ["model"], "prob")


def pick_model(aucs: DataFrame, force: str | None = None) -> DataFrame:
    """Best candidate by AUC; a forced name wins when it is among the candidates."""
    preferred = F.struct((F.col("model") == force).alias("f") if force else F.lit(False).alias("f"), "auc", "model")
    return aucs.agg(F.max_by("model", preferred).alias("model"), F.max_by("auc", preferred).alias("auc"))


def calibrated_models(df: DataFrame, features: Sequence[str], name: str, folds: int = 3, seed: int = 0,
                      photo: Sequence[str] = PHOTO, **override) -> list[tuple[PipelineModel, PipelineModel]]:
    """Sigmoid calibration: per fold a model of the other folds and a logistic map of its
    score fitted on the held-out fold."""
    with_fold, sizes = _folded(df, folds, photo, seed)

    def fit(fold: int) -> tuple[PipelineModel, PipelineModel]:
        n_rows = sum(n for f, n in sizes.items() if f != fold)
        base = pipeline(name, features, n_rows, seed, **override).fit(with_fold.where(F.col("fold") != fold))
        held = scored(base, with_fold.where(F.col("fold") == fold), "base_prob")
        return base, pipeline("LR", ["base_prob"], sizes[fold], C=1e6).fit(held)

    return fit_all([lambda fold=fold: fit(fold) for fold in sorted(sizes)])


def calibrated_score(pairs: list[tuple[PipelineModel, PipelineModel]], df: DataFrame, out: str = "prob") -> DataFrame:
    """Mean of the calibrated probabilities: a chain of narrow transforms over one table."""
    parts = []
    for i, (base, sigmoid) in enumerate(pairs):
        df = scored(sigmoid, scored(base, df, "base_prob"), f"_c{i}").drop("base_prob")
        parts.append(F.col(f"_c{i}"))
    return df.withColumn(out, sum(parts[1:], parts[0]) / len(parts)).drop(*[f"_c{i}" for i in range(len(pairs))])


def train_holdout(df: DataFrame, features: Sequence[str], name: str, split: DataFrame, seed: int = 0, photo: Sequence[str] = PHOTO,
                  key: Sequence[str] = KEY, out: str | None = None, **override) -> tuple[PipelineModel, DataFrame]:
    """A model of the training photos and its scores of the others: (model, rows (key, label, prob)), scores written to ``out``."""
    spark = df.sparkSession
    out = out or shared_dir(spark)
    side = save_and_reload(df.join(split, list(photo)), shared_dir(spark))      # the model takes the columns by name
    train, test = side.where(F.col("side") == "training"), side.where(F.col("side") == "validation")
    model = pipeline(name, features, train.count(), seed, **override).fit(train)
    return model, save_and_reload(scored(model, test).select(*key, "label", "prob"), out)


def seed_sweep(df: DataFrame, features: Sequence[str], name: str, seeds: Sequence[int],
               split: Callable[[DataFrame, int], DataFrame], photo: Sequence[str] = PHOTO, key: Sequence[str] = KEY,
               **override) -> DataFrame:
    """Held-out scores per seed: rows (seed, key, label, prob). One split by photo and one fit per seed."""
    spark = df.sparkSession
    out = shared_dir(spark)
    if _in_task(name, df.count(), len(features)):
        parts = VectorAssembler(inputCols=list(features), outputCol=VECTOR).transform(df).select(*dict.fromkeys([*key, *photo, "label", VECTOR]))
        fits = []
        for seed in seeds:
            side = split(df, seed).select(*photo, (F.col("side") == "validation").cast("int").alias(f"held_{seed}"))
            parts = parts.join(side, list(photo))
            fits.append(Fit(IN_TASK[name], {"seed": seed}, f"held_{seed}", 1, range(len(features)), {**PARAMETERS[name], **override, "seed": seed}))
        fits_in_tasks(parts, VECTOR, key, fits).write.parquet(out)
    else:
        fit_all([lambda seed=seed: train_holdout(df, features, name, split(df, seed), seed, photo, key, f"{out}/seed={seed}", **override)
                 for seed in seeds])
    kinds = dict(df.dtypes)
    return spark.read.schema(", ".join([f"`{c}` {kinds[c]}" for c in (*key, "label")] + ["prob double, seed int"])).parquet(out)


def feature_grid(df: DataFrame, sets: dict[str, Sequence[str]], names: Sequence[str], seeds: Sequence[int],
                 folds: int = 5, override: dict[str, dict] | None = None) -> DataFrame:
    """Out-of-fold AUC for every feature set, classifier and seed: rows (stage, n_feat, model, seed, auc)."""
    aucs = auc(run_grid(df, sets, names, seeds, folds, override=override), ["stage", "model", "seed"], "prob")
    sizes = F.create_map(*[F.lit(x) for name, features in sets.items() for x in (name, len(features))])
    return aucs.select("stage", sizes[F.col("stage")].alias("n_feat"), "model", "seed", "auc")


def importances(model: PipelineModel, features: Sequence[str], name: str) -> list[tuple[str, int, str, float]]:
    """(model, position, feature, gain) of a tree model; one value per feature."""
    gains = model.stages[-1].featureImportances.toArray()
    return [(name, i, f, float(g)) for i, (f, g) in enumerate(zip(features, gains))]


# ---------------------------------------------------------------- scoring
def clip_outliers(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Clip feature columns to the bounds of ``outlier_bounds`` (one row per feature)."""
    limits = {r["feature"]: (r["lo"], r["hi"]) for r in bounds.collect()}   # as many rows as features
    return df.withColumns({c: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))
                           for c, (lo, hi) in limits.items() if c in df.columns})


def threshold_for(youden: Column, low_fp: Column, sensitivity: Column) -> Column:
    """Decision threshold by sensitivity: strict takes the low-FP point, loose goes below Youden."""
    return (F.when(sensitivity == "strict", F.coalesce(low_fp, youden))
            .when(sensitivity == "loose", F.greatest(F.lit(0.05), 0.75 * youden)).otherwise(youden))


def verdict(prob: Column, threshold: Column) -> Column:
    return (F.when(prob >= threshold, "stego").when(prob < 0.9 * threshold, "clean").otherwise("unclear"))


def score_batch(features: DataFrame, models: dict[str, tuple[PipelineModel, float]], bounds: DataFrame | None = None,
                keep: Sequence[str] = KEY) -> DataFrame:
    """Rows scored by several models, with and without outlier clipping.

    The feature table is read once per setting and passed through all models as narrow
    transforms; the result is unfolded to rows (keep, model, clip, ml_prob, threshold, pred).
    """
    out = None
    for clip, table in [(False, features)] + ([(True, clip_outliers(features, bounds))] if bounds is not None else []):
        for name, (model, _) in models.items():
            table = scored(model, table, f"prob_{name}")
        rows = table.select(*keep, F.lit(clip).alias("clip"), F.inline(F.array(*[
            F.struct(F.lit(n).alias("model"), F.round(f"prob_{n}", 6).alias("ml_prob"),
                     F.lit(round(t, 6)).alias("threshold")) for n, (_, t) in models.items()])))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("pred_stego", (F.col("ml_prob") >= F.col("threshold")).cast("int"))


def training_bounds(df: DataFrame, features: Sequence[str], sigmas: float = 5.0) -> DataFrame:
    return outlier_bounds(df, features, sigmas)
