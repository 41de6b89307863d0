"""Exports: manifest, skipped empty tables, content hashes, both formats."""

import os

import pytest
from pyspark.sql import functions as F

from cohortlens.sources import io


@pytest.fixture
def tables(spark):
    a = spark.createDataFrame([(1, "x, \"y\"", 1.5), (2, None, None), (3, "é", -0.25)], "k int, t string, v double")
    return {"a": a, "none": a.where("k > 9"), "b": a.select("k").repartition(3)}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_manifest(spark, tables, tmp_path, fmt):
    base = str(tmp_path / fmt)
    m = {r["table"]: r for r in io.write_tables(spark, tables, base, fmt).collect()}
    assert {n: (r["status"], r["rows"]) for n, r in m.items()} == {"a": ("saved", 3), "none": ("empty", 0), "b": ("saved", 3)}
    assert sorted(os.listdir(base)) == ["_manifest", "a", "b"] and m["none"]["path"] is None
    assert m["a"]["content_hash"] == tables["a"].agg(io.content_hash(tables["a"])).first()[0]


def test_hash_of_rows_in_any_order(spark, tables):
    a = tables["a"]
    h = [d.agg(io.content_hash(d)).first()[0] for d in (a, a.orderBy(F.desc("k")).repartition(4), a.withColumn("v", F.col("v") + 1))]
    assert h[0] == h[1] != h[2]


def test_changed_copies_are_found(spark, tables, tmp_path):
    manifest = io.write_tables(spark, tables, str(tmp_path / "x"))
    schemas = {n: d.schema for n, d in tables.items()}
    assert all(r["intact"] for r in io.check_tables(spark, manifest, schemas).collect())
    tables["b"].withColumn("k", F.col("k") + 1).write.mode("overwrite").parquet(str(tmp_path / "x" / "b"))
    assert {r["table"]: r["intact"] for r in io.check_tables(spark, manifest, schemas).collect()} == {"a": True, "b": False}


def test_column_contents(spark, tables):
    got = {r["column"]: r for r in io.column_contents(tables["a"]).collect()}
    assert set(got) == {"(row)", "k", "t", "v"}
    assert (got["v"]["rows"], got["v"]["non_null"], got["v"]["checksum"]) == (3, 2, 0.625)
    swapped = tables["a"].withColumn("k", 4 - F.col("k"))
    again = {r["column"]: r["checksum"] for r in io.column_contents(swapped).collect()}
    assert again["k"] == got["k"]["checksum"] and again["(row)"] != got["(row)"]["checksum"]


def test_star_schema_is_delivered_alone(spark, sf_small, tmp_path):
    from cohortlens.plans.star_schema import write_star_schema

    manifest, tables = write_star_schema(spark, sf_small, str(tmp_path / "star"), "csv")
    assert set(os.listdir(tmp_path / "star")) == {"_manifest", *tables} and len(tables) == 13
    schemas = {n: d.schema for n, d in tables.items()}
    assert all(r["intact"] for r in io.check_tables(spark, manifest, schemas, "csv").collect())
