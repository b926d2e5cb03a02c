"""Feature-frame equivalence and edge tests."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from churnscope.operators import asof as A
from churnscope.operators import features as FE
from churnscope.operators.model import rule_score
from churnscope.sources import duplicate_keys
from churnscope.sources import fixtures as X

TRAIN = X.TRAINING_END


def _rows(df, order=("loop_day", "customer_level", "CUSTNO")):
    cols = sorted(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_flagship_counts_on_smallest_tables(spark, small):
    led, reg = small
    ff = FE.feature_frame(led, reg, A.training_day(spark, TRAIN))
    scored = rule_score(ff)
    cells = {(int(r.indexedLabel), int(r.prediction)): r["count"]
             for r in scored.groupBy("indexedLabel", "prediction").count().collect()}
    # Rule-score confusion on the training date (label, prediction) -> rows.
    assert sum(cells.values()) == 43
    assert cells == {(0, 0): 18, (0, 1): 13, (1, 0): 4, (1, 1): 8}


def test_flag_form_equals_distinct_form(spark, small):
    led, reg = small
    days = A.backtest_days(spark, TRAIN)
    a = FE.feature_frame(led, reg, days, strategy="flags")
    b = FE.feature_frame(led, reg, days, strategy="distinct")
    assert _rows(a) == _rows(b)


def test_multi_day_plan_equals_union_of_single_days(spark, small):
    led, reg = small
    days = A.backtest_days(spark, TRAIN)
    together = FE.feature_frame(led, reg, days)
    parts = None
    for i in range(1, 5):
        one = A.asof_days(spark, [TRAIN + dt.timedelta(days=i + 365)], [i])
        f = FE.feature_frame(led, reg, one)
        parts = f if parts is None else parts.unionByName(f)
    assert together.count() > 0
    assert _rows(together) == _rows(parts)


def _tiny(spark):
    e = dt.date(2000, 6, 30)
    led = spark.createDataFrame([
        (1, e, 100, 10.0), (1, e, 100, 5.0),                  # two lines, one transaction
        (1, e - dt.timedelta(days=8), None, 7.0),             # no reference: sales only
        (1, e - dt.timedelta(days=40), 101, 1.0),
        (2, e - dt.timedelta(days=200), 200, 3.0),            # active window misses it
        (3, e - dt.timedelta(days=3), 300, 2.0),              # customer closes on e
        (4, e + dt.timedelta(days=30), 400, 9.0),             # only a target purchase
        (1, e + dt.timedelta(days=365), 102, 4.0),            # last day of target window
    ], "CUSTNO long, POSTDATE date, TRANSREFNO long, SALES double").withColumn(
        "SALES", F.col("SALES").cast("decimal(18,2)"))
    reg = spark.createDataFrame([
        (1, 10, dt.date(1999, 1, 1), None, "A", 1),
        (2, 10, dt.date(1999, 1, 1), None, "B", 1),
        (3, 11, dt.date(1999, 1, 1), e, "A", 2),
        (4, 11, dt.date(1999, 1, 1), None, "B", 2),
    ], "CUSTNO long, COMPID long, CREDATE date, KILLDATE date, CUSTCLASS string, REGION int")
    return e, led, reg


def test_edge_cases_on_tiny_ledger(spark):
    e, led, reg = _tiny(spark)
    ff = FE.feature_frame(led, reg, A.training_day(spark, e))
    rows = {r.customer_level: r for r in ff.collect()}
    # 2: no purchase in the active window; 3: closed on the end day; 4: no features.
    assert set(rows) == {1}
    r = rows[1]
    assert r.Week_1 == 1 and r.Week_2 == 0 and r.Week_6 == 1
    assert r.UNIQUE_TRANSREFNO_ACTIVE == 2
    assert r.total_sales == pytest.approx(23.0)          # includes the line without reference
    assert r.UNIQUE_TRANSREFNO_TARGET == 1 and r.target_churn == 0
    assert r.killed == 0 and r.feature_days_customer == (e - dt.date(1999, 1, 1)).days + 1


def test_company_level_keeps_register_rows(spark):
    e, led, reg = _tiny(spark)
    ff = FE.feature_frame(led, reg, A.training_day(spark, e), level="compid")
    got = sorted((r.customer_level, r.CUSTNO) for r in ff.collect())
    # Companies 10 (through customer 1) and 11 (through customer 3, who is
    # closed) are active: one row per live register row of each company.
    assert got == [(10, 1), (10, 2), (11, 4)]


def test_churn_label_when_no_purchase(spark):
    e, led, reg = _tiny(spark)
    lab = {r.customer_level: r for r in FE.churn_labels(led, reg, A.training_day(spark, e)).collect()}
    assert lab[1].target_churn == 0
    assert lab[2].target_churn == 1 and lab[2].UNIQUE_TRANSREFNO_TARGET is None
    assert lab[4].target_churn == 0


def test_duplicate_register_keys_are_reported(spark):
    e, led, reg = _tiny(spark)
    dup = reg.unionByName(reg.where(F.col("CUSTNO") == 1))
    assert [r.CUSTNO for r in duplicate_keys(dup).collect()] == [1]


def test_rolling_month_mode_sums_to_year(spark, small):
    led, reg = small
    ao = A.training_day(spark, TRAIN)
    cal = FE.features_month(led, ao)
    rol = FE.features_month(led, ao, month_mode="rolling")
    total = " + ".join(f"Month_{k}" for k in range(12))
    # Both partitions of the trailing year count each transaction once per
    # bucket it touches; with one date per transaction the totals agree.
    a = sorted((r[0], r[1]) for r in cal.selectExpr("customer_level", total).collect())
    b = sorted((r[0], r[1]) for r in rol.selectExpr("customer_level", total).collect())
    assert a == b


def test_label_mature_marks_incomplete_target_windows(spark, small):
    led, reg = small
    latest = dt.date(2001, 7, 2)
    days = A.backtest_days(spark, TRAIN)  # target ends 2001-06-30 .. 2001-07-03
    ff = FE.feature_frame(led, reg, days, latest=latest)
    got = {r.loop_day: r.m for r in ff.groupBy("loop_day").agg(F.min("label_mature").alias("m")).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False}


def test_one_backtest_day_equals_first_day_of_four(spark, small):
    led, reg = small
    one = FE.feature_frame(led, reg, A.backtest_days(spark, TRAIN, periods=2))
    four = FE.feature_frame(led, reg, A.backtest_days(spark, TRAIN)).where(F.col("loop_day") == 1)
    assert one.count() > 0
    assert _rows(one) == _rows(four)
