"""Fingerprints, strict JSON and model archives (a JSON manifest and Parquet arrays; nothing is pickled)."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
import os
import platform
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrabag.operators.classifier import DistributionClassifier, ModelSpec
from terrabag.operators.solvers import FitResult

VERSION = 1


def json_safe(value: Any) -> Any:
    """value with arrays as lists and numbers that aren't finite as null."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        value = dataclasses.asdict(value)
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, np.ndarray)):
        return [json_safe(v) for v in value]
    if isinstance(value, np.generic):
        value = value.item()
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_strict_json(path: str, payload: Any) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(json_safe(payload), f, sort_keys=True, indent=2, allow_nan=False)
        f.write("\n")


def configuration_fingerprint(config: Any) -> str:
    """SHA-256 of the canonical JSON of a configuration."""
    return hashlib.sha256(json.dumps(json_safe(config), sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def bag_fingerprints(cells: DataFrame) -> DataFrame:
    """(bag_id, hash) over a bag's cells in the order of cell_id; every bag's hash is made in one task."""
    cell = F.to_json(F.struct("cell_id", "label", "features"))
    return cells.groupBy("bag_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell_id", F.sha2(cell, 256).alias("h")))), lambda c: c["h"]), ""), 256).alias("hash"))


def dataset_fingerprint(cells: DataFrame) -> str:
    """SHA-256 over the bags' hashes in the order of bag_id; it depends on order within bags and on labels, not on partitioning."""
    total = hashlib.sha256()
    for r in bag_fingerprints(cells).orderBy("bag_id").toLocalIterator():
        total.update(f"{r.bag_id}:{r.hash};".encode())
    return total.hexdigest()


def serialize_plan(plan: DataFrame) -> DataFrame:
    """repeat, fold and the sorted bags of its test part."""
    return plan.groupBy("repeat", "fold").agg(F.array_sort(F.collect_list("bag_id")).alias("test_bags"))


def environment_manifest(spark: SparkSession) -> dict[str, str]:
    return {"python": platform.python_version(), "numpy": np.__version__, "spark": spark.version, "system": platform.system()}


def save_model(model: DistributionClassifier, path: str) -> None:
    """Manifest and arrays of a fitted model under a folder that driver and executors share."""
    if model.result is None:
        raise ValueError("the model isn't fitted")
    if not np.all(np.isfinite(model.result.coefficients)):
        raise ValueError("the model's arrays must be finite")
    settings = {f.name: getattr(model, f.name) for f in dataclasses.fields(model) if f.name not in ("spec", "result")}
    fitted = {k: getattr(model, k) for k in ("width", "sigma_", "decision_sigma_") if hasattr(model, k)}
    arrays = {k: getattr(model, k).tolist() for k in ("weights", "directions") if hasattr(model, k)}
    stats = model.stats.first().asDict() if hasattr(model, "stats") else None
    result = dataclasses.asdict(model.result)
    result["coefficients"] = model.result.coefficients.tolist()
    manifest = {"version": VERSION, "spec": dataclasses.asdict(model.spec), "settings": settings, "fitted": fitted, "arrays": arrays, "stats": stats, "result": result, "bag_ids": getattr(model, "bag_ids", None)}
    os.makedirs(path, exist_ok=True)
    write_strict_json(f"{path}/manifest.json", manifest)
    if hasattr(model, "train"):
        model.train.write.mode("overwrite").parquet(f"{path}/train.parquet")


def load_model(spark: SparkSession, path: str) -> DistributionClassifier:
    """The model that save_model() wrote; raises on an unknown version or missing parts."""
    with open(f"{path}/manifest.json", encoding="utf-8") as f:
        m = json.load(f)
    if m.get("version") != VERSION:
        raise ValueError(f"unknown archive version {m.get('version')!r}")
    wanted = {"version", "spec", "settings", "fitted", "arrays", "stats", "result", "bag_ids"}
    if set(m) != wanted:
        raise ValueError("the archive has other members than it should")
    model = DistributionClassifier(ModelSpec(**m["spec"]), **m["settings"])
    for k, v in m["fitted"].items():
        setattr(model, k, v)
    for k, v in m["arrays"].items():
        setattr(model, k, np.array(v))
    if m["stats"] is not None:
        model.stats = spark.createDataFrame([m["stats"]])
    model.result = FitResult(**{**m["result"], "coefficients": np.array(m["result"]["coefficients"])})
    if m["bag_ids"] is not None:
        model.bag_ids, model.train = m["bag_ids"], spark.read.parquet(f"{path}/train.parquet")
    return model
