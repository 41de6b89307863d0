"""Models stored with a record of what they were trained on, and a reload
that refuses data or a record that doesn't fit."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import ImputerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import NumericType

#: Version of the record's layout.
VERSION = "v1"
_FIELDS = ("model_name", "version", "target", "feature_order", "numeric_features", "categorical_features", "threshold", "medians")


class RecordMismatch(ValueError):
    """The stored model can't be used as asked; the message lists every reason."""


def _medians(model: PipelineModel) -> dict[str, float]:
    out: dict[str, float] = {}
    for stage in model.stages:
        if isinstance(stage, ImputerModel):
            row = stage.surrogateDF.first()  # one row
            out.update({c: float(row[c]) for c in stage.surrogateDF.columns})
    return out


def save_model(
    model: PipelineModel,
    path: str,
    model_name: str,
    features: Sequence[str],
    target: str,
    train: DataFrame,
    threshold: float | None = None,
) -> dict:
    """Store the pipeline under ``path/model`` and its record, one JSON line,
    under ``path/record``; the record.  The folders are written by Spark, so any
    file system of the cluster will do."""
    missing = [f for f in [*features, target] if f not in train.columns]
    if missing:
        raise ValueError(f"not in the training frame: {missing}")
    numeric = [f for f in features if isinstance(train.schema[f].dataType, NumericType)]
    record = {
        "model_name": model_name,
        "version": VERSION,
        "target": target,
        "feature_order": list(features),
        "numeric_features": numeric,
        "categorical_features": [f for f in features if f not in numeric],
        "threshold": threshold,
        "medians": _medians(model),
    }
    model.write().overwrite().save(f"{path}/model")
    spark = train.sparkSession
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/record")
    return record


def read_record(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(f"{path}/record").collect()  # one line
    if len(rows) != 1:
        raise RecordMismatch(f"{path}/record holds {len(rows)} records")
    record = json.loads(rows[0][0])
    missing = [f for f in _FIELDS if f not in record]
    if missing or record["version"] != VERSION:
        raise RecordMismatch(f"record of version {record.get('version')!r} without {missing}; this is {VERSION}")
    return record


def load_model(path: str, df: DataFrame, target: str | None = None, features: Sequence[str] | None = None) -> tuple[PipelineModel, dict]:
    """The model and its record, if they fit ``df``: every feature is there, those
    that were numeric still are, and the target and the feature order are the
    expected ones (where given).  Raises ``RecordMismatch`` otherwise."""
    record = read_record(df.sparkSession, path)
    reasons = []
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f for f in record["feature_order"] if f not in have]
    if missing:
        reasons.append(f"features missing: {missing}")
    changed = [f for f in record["numeric_features"] if f in have and not isinstance(have[f], NumericType)]
    if changed:
        reasons.append(f"features no longer numeric: {changed}")
    if target is not None and target != record["target"]:
        reasons.append(f"trained for {record['target']!r}, not {target!r}")
    if features is not None and list(features) != record["feature_order"]:
        reasons.append(f"feature order is {record['feature_order']}, not {list(features)}")
    if reasons:
        raise RecordMismatch("; ".join(reasons))
    return PipelineModel.load(f"{path}/model"), record


def predict(path: str, df: DataFrame, target: str | None = None) -> DataFrame:
    """``df`` with the stored model's prediction, after the checks of ``load_model``."""
    model, _ = load_model(path, df, target)
    return model.transform(df)
