"""What the findings of the fourth round named: fits with all their rounds, trees, folds and splits."""

from threading import Barrier

import numpy as np
import pytest

from grainscope.operators import corpus as C
from grainscope.operators import learn as L
from grainscope.operators.boosting import borders, boosted_scores
from grainscope.plans import learning as P


class Enough(Exception):
    """Raised when a query has said what it will fit."""


def asked(monkeypatch, spark, sf_dir, operator, query):
    """What a query asks the operator to do: (positional, keyword arguments)."""
    calls = []

    def spy(*args, **kw):
        calls.append((args, kw))
        raise Enough

    monkeypatch.setattr(L, operator, spy)
    monkeypatch.setattr(P, "corpus_table", lambda *a: None)
    with pytest.raises(Enough):
        query(spark, sf_dir)
    return calls[0]


def table(spark, n=240, width=8):
    """Rows with columns without ties, four to a photo, and labels that some columns bear on."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, width))
    y = (x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(size=n) > 0).astype(int)
    columns = [f"c{i}" for i in range(width)]
    rows = [("t", i // 4, f"v{i % 4}", *map(float, r), int(label)) for i, (r, label) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "source string, photo_id long, variant string, " + ", ".join(f"{c} double" for c in columns) + ", label int")
    return df, columns, x, y


def scores_of(df):
    return {(r.photo_id, r.variant, r.model, r.fold): r.prob for r in df.collect()}


def test_out_of_fold_fits_are_not_cut(monkeypatch, spark, sf_dir):
    _, kw = asked(monkeypatch, spark, sf_dir, "out_of_fold", P.out_of_fold)
    assert not kw.get("override") and kw.get("folds", 5) == 5


def test_seed_sweep_fits_are_not_cut(monkeypatch, spark, sf_dir):
    args, kw = asked(monkeypatch, spark, sf_dir, "seed_sweep", P.seed_sweep)
    assert args[2] == "LGB" and list(args[3]) == list(range(8)) and not kw


def test_grid_fits_are_not_cut(monkeypatch, spark, sf_dir):
    args, kw = asked(monkeypatch, spark, sf_dir, "run_grid", P.feature_set_grid)
    assert args[1] == P.FEATURE_SETS and list(args[2]) == P.GRID and list(args[3]) == [0, 1, 2]
    assert kw.get("folds", 5) == 5 and kw["override"] == L.GRID_PARAMETERS


def test_fits_do_not_share_local_properties(spark):
    """Spark keeps the id of a running write among them; a fit that ended cleared it for the others."""
    together = Barrier(4, timeout=60)

    def fit(i):
        spark.sparkContext.setLocalProperty("grainscope.fit", str(i))
        together.wait()
        return spark.sparkContext.getLocalProperty("grainscope.fit")

    assert L.fit_all([lambda i=i: fit(i) for i in range(4)]) == ["0", "1", "2", "3"]


def test_seeds_in_tasks_are_those_of_mllib(monkeypatch, spark):
    df, columns, _, _ = table(spark)
    parameters = {"maxIter": 4, "maxDepth": 3, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}

    def sweep():
        scores = L.seed_sweep(df, columns, "LGB", range(2), lambda d, seed: C.holdout_split(d, 0.25, seed), **parameters)
        return {(r.seed, r.photo_id, r.variant): r.prob for r in scores.collect()}

    got = sweep()
    monkeypatch.setattr(L, "IN_TASK_BYTES", 0)
    assert sweep() == pytest.approx(got, abs=1e-9)
    assert len(got) == 2 * 15 * 4


@pytest.mark.parametrize("parameters", [{"maxIter": 5, "maxDepth": 3, "stepSize": 0.05},
                                        {"maxIter": 5, "maxDepth": 5, "stepSize": 0.3, "minInstancesPerNode": 10}])
def test_boosted_fits_in_tasks_are_those_of_mllib(monkeypatch, spark, parameters):
    df, columns, _, _ = table(spark)
    override = {"GB": {"subsamplingRate": 1.0, "featureSubsetStrategy": "all", "minInstancesPerNode": 4, **parameters}}
    got = scores_of(L.out_of_fold(df, columns, ["GB"], folds=2, override=override))
    monkeypatch.setattr(L, "IN_TASK_BYTES", 0)
    assert scores_of(L.out_of_fold(df, columns, ["GB"], folds=2, override=override)) == pytest.approx(got, abs=1e-9)
    assert len(got) == 240


def test_borders_deal_rows_evenly():
    assert borders(np.array([3.0, 1.0, 1.0, 2.0])).tolist() == [1.5, 2.5]
    assert borders(np.zeros(9)).tolist() == []
    values = np.random.default_rng(1).normal(size=3200)
    codes = np.searchsorted(borders(values), values)
    assert np.bincount(codes).tolist() == [100] * 32


def test_draws_do_not_depend_on_partitions(spark):
    df, columns, _, _ = table(spark)
    override = {"XGB": {"maxIter": 4}}
    one, many = (scores_of(L.out_of_fold(t, columns, ["XGB"], folds=2, override=override)) for t in (df.coalesce(1), df.repartition(5, "variant")))
    assert one == many


def test_boosting_learns():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    few, many = (boosted_scores(x[:400], y[:400], x[400:], **{**L.PARAMETERS["LGB"], "maxIter": n}) for n in (3, 150))
    assert np.mean((many > 0.5) == y[400:]) > 0.9
    assert np.abs(many - y[400:]).mean() < 0.5 * np.abs(few - y[400:]).mean()
