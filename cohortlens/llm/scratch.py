"""Lineage cuts: tables written under the cluster's ``spark.checkpoint.dir``.

``stored`` writes a frame as Parquet below the shared checkpoint folder and
reads it back, so a step survives lost executors and later steps see one fixed
set of rows.  The shuffle files of a stored step are freed as soon as it is
written (the step can always be read again from its table).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import cohortlens
from cohortlens.session import ensure_checkpoint_dir

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.
    The archive is served by the driver; no executor reads the driver's folder."""
    sc = spark.sparkContext
    if getattr(sc, "_cohortlens_shipped", False):
        return
    root = Path(cohortlens.__file__).parent
    folder = tempfile.mkdtemp(prefix="cohortlens-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/cohortlens-code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(Path(root.name) / f.relative_to(root)))
    sc.addPyFile(archive)
    sc._cohortlens_shipped = True


def scratch_table(spark: SparkSession) -> str:
    """A fresh path in the shared checkpoint folder, one folder per application."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/llm-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once and read back (see the module docstring)."""
    spark = df.sparkSession
    path = scratch_table(spark)
    with _setting(spark, _FREE_SHUFFLES, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
