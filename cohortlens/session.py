"""Spark session helpers.

On a cluster the session is created by the platform; these helpers only fill in
settings that are *unset* (tests, local runs) and never override cluster config.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    "spark.sql.constraintPropagation.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "cohortlens", **conf: str) -> SparkSession:
    """Return the active session or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  Where it is unset, a local session
    gets a temporary folder; on a cluster that would be another folder on every
    machine, so it is an error there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder all executors share (master {master})")
        path = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def materialize(df):
    """Cut the lineage of a frame reused by iterative work (ML fits, many
    branches): a reliable ``checkpoint`` into ``spark.checkpoint.dir``, which
    survives lost executors (unlike a local checkpoint or a cache)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def wide_plan_guard(spark: SparkSession) -> None:
    """Plans over hundreds of derived columns make Catalyst's constraint
    propagation (``InferFiltersFromConstraints``) grow combinatorially -- the
    optimizer, not the job, then takes minutes.  The wide-table builders turn
    it off for the session (a runtime SQL setting; filters the queries state
    explicitly are still pushed down)."""
    if spark.conf.get("spark.sql.constraintPropagation.enabled", "true") != "false":
        spark.conf.set("spark.sql.constraintPropagation.enabled", "false")


#: Bytes of an input's files for which a shuffle has one partition more.
BYTES_A_PARTITION = 2 * 1024 * 1024


def size_shuffles(spark: SparkSession, input_bytes: int | None) -> int | None:
    """Raise ``spark.sql.shuffle.partitions`` with the input, so that the rows of one
    task do not grow with it: a number fixed for a session puts a fixed share of any
    input into every task.  AQE merges what turns out small.  The setting is never
    lowered.  Returns the number, for shuffles that AQE must not merge (it goes by
    compressed bytes, which says little of rows that are widened after the shuffle),
    or None where the input needs no more than the session's."""
    wanted = -(-(input_bytes or 0) // BYTES_A_PARTITION)
    set_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if wanted > set_:
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return wanted if wanted >= set_ else None
