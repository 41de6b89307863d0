"""Streaming batch scoring: ``readStream`` -> the rule / score expressions ->
``writeStream`` (parquet or memory), checkpointed under the cluster's
``spark.checkpoint.dir``."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cohortlens.operators import numeric, rules
from cohortlens.session import ensure_checkpoint_dir


def scored_columns(roles: Mapping[str, str], threshold: float = 0.5) -> list:
    """Score (fallback formula), risk, status, causes and recommendations."""
    score, risk = numeric.fallback_score(roles)
    is_risk = risk >= threshold
    return [
        score.alias("predicted_score"),
        risk.alias("risk_probability"),
        F.when(is_risk, "At Risk").otherwise("Not At Risk").alias("status"),
        F.concat_ws(" | ", rules.risk_causes(roles, is_risk)).alias("causes"),
        F.concat_ws(" | ", rules.recommendations(roles, score, risk)).alias("recommendations"),
    ]


def score_stream(
    spark: SparkSession,
    source_dir: str,
    schema: StructType | str,
    id_col: str,
    roles: Mapping[str, str],
    sink: str = "parquet",
    sink_path: str | None = None,
    query_name: str = "scored_students",
    max_files_per_trigger: int = 64,
) -> StreamingQuery:
    """Start the scoring stream.  ``sink='memory'`` is for tests (query name =
    table name); otherwise rows are appended as parquet to ``sink_path``."""
    base = ensure_checkpoint_dir(spark)
    src = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(source_dir)
    )
    out = src.select(F.col(id_col), *scored_columns(roles))
    w = out.writeStream.outputMode("append").option("checkpointLocation", os.path.join(base, "streams", query_name))
    if sink == "memory":
        return w.format("memory").queryName(query_name).start()
    return w.format("parquet").option("path", sink_path).start()
