"""Contract checks: every query has an oracle unless it is a model/ML query,
and a sample of queries match DuckDB on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from cohortlens.plans.registry import ORACLE, QUERIES
from cohortlens.sources.tables import TABLES

ROWS_ONLY = {
    "yeo_johnson_fit", "regularised_cv", "cv_scores", "rf_gbt_compare", "classifier_compare", "smote",
    "importance", "permutation_importance", "linear_attribution", "kmeans_profile", "pca_projection",
    "engagement_pca", "blend", "save_reload_check", "batch_score",
}


def test_every_query_has_oracle_or_is_rows_only():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) <= set(q)
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0


FAST = ["region_exam_table", "kpi_overview", "band_report", "dedupe_first", "lookup_join", "histogram",
        "box_stats", "roc_auc", "kfold_target_encode", "stratified_split", "cluster_share", "describe"]


@pytest.mark.parametrize("name", FAST)
def test_matches_duckdb(spark, sf_small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    sdf = entry.queries()[name](spark, sf_small)
    cols = sorted(sdf.columns)
    srows = sorted(tuple(r[c] for c in cols) for r in sdf.collect())
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    orows = sorted(tuple(r[names.index(c)] for c in cols) for r in rel.fetchall())
    assert sorted(names) == cols
    assert srows == orows
