"""What a task holds does not grow with the input: shuffles and stored tables sized by it."""

import pytest

from cohortlens import session
from cohortlens.operators import models as ml
from cohortlens.plans import fixtures as fx

PARTITIONS = "spark.sql.shuffle.partitions"


@pytest.fixture
def small_parts(spark, monkeypatch):
    monkeypatch.setattr(session, "BYTES_A_PARTITION", 2_000)
    held = spark.conf.get(PARTITIONS)
    yield held
    spark.conf.set(PARTITIONS, held)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_rows_are_made_where_their_customer_is(spark, sf_small):
    """A map-side half of the pivot on cells dealt by cell holds nearly every customer in every task."""
    lines = [x for x in _plan(fx.customer_wide(spark, sf_small)).splitlines() if "Exchange" in x or "pivotfirst(" in x]
    half = [i for i, x in enumerate(lines) if "partial_pivotfirst(" in x]
    assert half and all("Exchange" not in lines[i - 1] for i in half)


def test_shuffles_grow_with_the_input(spark, sf_small, small_parts):
    before = fx.customer_wide(spark, sf_small, ["Attendance"])
    plan = _plan(before)
    wanted = int(spark.conf.get(PARTITIONS))
    assert wanted > 4 * int(small_parts)
    assert plan.count(f", {wanted}), REPARTITION_BY_NUM") == 3  # lines, orders, cells
    assert before.count() == before.select("c_custkey").distinct().count()
    session.size_shuffles(spark, 1)
    assert int(spark.conf.get(PARTITIONS)) == wanted  # never lowered


def test_null_keys_and_repeated_orders_keep_their_meaning(spark, tmp_path, small_parts, monkeypatch):
    ts = "timestamp'1996-05-01'"
    lines = spark.sql(
        f"""SELECT * FROM VALUES (1L, 10D, 0.1D, 0.0D, 1, 'A', 'F', {ts}), (1L, 20D, 0.0D, 0.0D, 2, 'A', 'F', {ts}), (NULL, 30D, 0.0D, 0.0D, 1, 'A', 'F', {ts}),
        (2L, 40D, 0.0D, 0.0D, 1, 'N', 'O', {ts}) AS t(l_orderkey, l_quantity, l_discount, l_tax, l_linenumber, l_returnflag, l_linestatus, l_shipdate)"""
    )
    orders = spark.createDataFrame([(1, 7), (2, 7), (2, 8), (None, 7)], "o_orderkey long, o_custkey long")
    people = spark.createDataFrame([(7,), (8,), (9,), (None,)], "c_custkey long")
    for name, df in {"lineitem": lines, "orders": orders, "customer": people}.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    for size in (1 << 30, 200):  # the session's number, and one by the input
        monkeypatch.setattr(session, "BYTES_A_PARTITION", size)
        got = {r.c_custkey: (r.Grade_5_A_F_Test_Score, r.Grade_5_N_O_Test_Score) for r in fx.customer_wide(spark, str(tmp_path)).collect()}
        assert got == {7: (30.0, 80.0), 8: (None, 80.0), 9: (None, None), None: (None, None)}


def test_fits_run_side_by_side(spark):
    from threading import Barrier

    meet = Barrier(3)  # passes only if all three are under way at once
    assert ml.side_by_side(spark, [lambda i=i: (meet.wait(60), i)[1] for i in range(3)]) == [0, 1, 2]
