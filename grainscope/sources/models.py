"""Registry of model artefacts: fitted pipeline, feature list, thresholds, clipping bounds, provenance and a fingerprint.

An artefact is a folder. It is refused, with the reason in ``status``, when it cannot be read, when the model's content does not
give the stored fingerprint, when feature list and model do not fit together, or when a threshold is no probability.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from grainscope.schemas import ALL_FEATURES


@dataclass(frozen=True)
class Artefact:
    """A model as it is used for scoring; ``model`` is None when ``status`` is not ``ok``."""

    name: str
    model: PipelineModel | None = None
    features: tuple[str, ...] = ()
    threshold: float = 0.5
    threshold_low_fp: float | None = None
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    provenance: dict = field(default_factory=dict)
    fingerprint: str = ""
    status: str = "ok"

    @property
    def available(self) -> bool:
        return self.model is not None


def fingerprint(model: PipelineModel, features: Sequence[str]) -> str:
    """SHA-256 of the feature names and of what the stages have learnt; equal for a model and its reloaded copy."""
    digest = hashlib.sha256("\n".join(features).encode())
    for stage in model.stages:
        digest.update(type(stage).__name__.encode())
        for learnt in ("mean", "std", "coefficients", "intercept", "treeWeights", "toDebugString"):
            value = getattr(stage, learnt, None)
            if value is not None:
                if learnt == "toDebugString":       # the first line holds a run's identifier
                    text = str(value).split("\n", 1)[-1]
                else:
                    text = value if isinstance(value, str) else repr([float(x) for x in (value if hasattr(value, "__len__") else [value])])
                digest.update(f"{learnt}={text}".encode())
    return digest.hexdigest()


def save_artefact(spark: SparkSession, artefact: Artefact, path: str) -> str:
    """Write an artefact, fingerprint included; returns the fingerprint."""
    assert artefact.model is not None
    mark = fingerprint(artefact.model, artefact.features)
    meta = {"name": artefact.name, "features": list(artefact.features), "threshold": artefact.threshold,
            "threshold_low_fp": artefact.threshold_low_fp, "bounds": artefact.bounds, "provenance": artefact.provenance,
            "fingerprint": mark}
    artefact.model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode(
        "overwrite").text(f"{path}/meta")
    return mark


def _fault(meta: dict, model: PipelineModel) -> str | None:
    """Why an artefact must not be used, if so."""
    if fingerprint(model, meta["features"]) != meta["fingerprint"]:
        return "fingerprint differs from the model's content"
    size = getattr(model.stages[-1], "numFeatures", None)
    if size is not None and size != len(meta["features"]):
        return f"model takes {size} features, the list has {len(meta['features'])}"
    unknown = [f for f in meta["features"] if f not in ALL_FEATURES]
    if unknown:
        return f"unknown features: {', '.join(unknown[:5])}"
    for key in ("threshold", "threshold_low_fp"):
        value = meta[key]
        if value is not None and not (math.isfinite(value) and 0.0 <= value <= 1.0):
            return f"{key} is {value}"
    return None


def load_artefact(spark: SparkSession, path: str) -> Artefact:
    """Read an artefact and check it; never raises."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        name = meta["name"]
        model = PipelineModel.load(f"{path}/model")
        why = _fault(meta, model)
    except Exception as exc:  # noqa: BLE001 - the reason is part of the result
        why = f"{type(exc).__name__}: {str(exc).splitlines()[0] if str(exc) else ''}"
    if why:
        return Artefact(name, status=f"refused: {why}")
    return Artefact(name, model, tuple(meta["features"]), meta["threshold"], meta["threshold_low_fp"],
                    {f: tuple(b) for f, b in meta["bounds"].items()}, meta["provenance"], meta["fingerprint"])


def registry_table(spark: SparkSession, artefacts: Iterable[Artefact]) -> DataFrame:
    """One row per artefact: what was loaded and what was refused."""
    return spark.createDataFrame(
        [(a.name, a.status, len(a.features), float(a.threshold), a.threshold_low_fp, a.fingerprint) for a in artefacts],
        "name string, status string, n_features int, threshold double, threshold_low_fp double, fingerprint string")
