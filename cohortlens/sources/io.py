"""Scans and sinks."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, header: bool = True) -> DataFrame:
    """CSV with a header.  Pass an explicit schema for production reads
    (inference is an extra pass over the data)."""
    r = spark.read.option("header", header)
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", True).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> int:
    """S3: write and return the stored row count.  For Parquet the count is
    read back from the file footers (row-group metadata, no data scan); a text
    format has none, so its lines are counted.

    (``observe()`` would count during the write, but a registered
    ``Observation`` stays attached to the session and later breaks the
    serialisation of RDD-based ML tasks in the same session.)"""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)
    return _stored(df.sparkSession, path, fmt, df.schema).count()


MANIFEST = "table string, status string, rows bigint, content_hash string, path string"


def _stored(spark: SparkSession, path: str, fmt: str, schema: StructType) -> DataFrame:
    reader = spark.read.format(fmt).schema(schema)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def content_hash(df: DataFrame) -> Column:
    """Aggregate: a checksum of the rows that doesn't depend on their order."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")


def write_tables(spark: SparkSession, tables: Mapping[str, DataFrame], base: str, fmt: str = "parquet") -> DataFrame:
    """Write every table of a schema under ``base/<name>`` and one manifest
    under ``base/_manifest``: ``table, status, rows, content_hash, path``.

    Rows and hash are those of the stored copy, taken in one read of it, so the
    manifest says what a reader will find.  An empty table is not delivered
    (S3): its folder is removed again and its status is ``empty``."""
    found = []
    for name, df in tables.items():
        path = os.path.join(base, name)
        w = df.write.mode("overwrite")
        (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)
        back = _stored(spark, path, fmt, df.schema)
        r = back.agg(F.count(F.lit(1)).alias("n"), content_hash(back).alias("h")).first()
        if not r["n"]:
            _remove(spark, path)
        found.append((name, "saved" if r["n"] else "empty", r["n"], r["h"] if r["n"] else None, path if r["n"] else None))
    manifest = spark.createDataFrame(found, MANIFEST)  # one row a table
    manifest.coalesce(1).write.mode("overwrite").parquet(os.path.join(base, "_manifest"))
    return spark.read.schema(MANIFEST).parquet(os.path.join(base, "_manifest"))


def check_tables(spark: SparkSession, manifest: DataFrame, schemas: Mapping[str, StructType], fmt: str = "parquet") -> DataFrame:
    """The manifest's tables read again: ``table, rows, intact`` (rows and content
    hash are as recorded)."""
    found = []
    for r in manifest.where("status = 'saved'").collect():  # one row a table
        back = _stored(spark, r["path"], fmt, schemas[r["table"]])
        now = back.agg(F.count(F.lit(1)).alias("n"), content_hash(back).alias("h")).first()
        found.append((r["table"], now["n"], (now["n"], now["h"]) == (r["rows"], r["content_hash"])))
    return spark.createDataFrame(found, "table string, rows bigint, intact boolean")


def column_contents(df: DataFrame) -> DataFrame:
    """``column, rows, non_null, checksum`` of a table in one pass: the mean of a
    numeric column, the mean of the first 32 bits of the MD5 of any other, and as
    ``(row)`` the same of the columns that are not fractional, joined."""

    def bits(c: Column) -> Column:
        return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("double")

    exact = [F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("~")) for f in df.schema.fields if f.dataType.typeName() not in ("double", "float")]
    parts = [F.struct(F.lit("(row)").alias("column"), F.count(F.lit(1)).alias("non_null"), F.avg(bits(F.concat_ws("|", *exact))).alias("checksum"))]
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        number = c.cast("double") if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte") else bits(c.cast("string"))
        parts.append(F.struct(F.lit(f.name).alias("column"), F.count(c).alias("non_null"), F.avg(number).alias("checksum")))
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*parts).alias("parts"))
    return row.select("rows", F.explode("parts").alias("p")).select("p.column", "rows", "p.non_null", "p.checksum")


def export_selected(df: DataFrame, columns: Sequence[str], path: str, fmt: str = "csv") -> int:
    """The chosen columns (those present) of the full dataset."""
    keep = [c for c in columns if c in df.columns]
    return write_table(df.select(*keep), path, fmt)
