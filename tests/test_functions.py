"""Definition tests for the date expressions, written from their definitions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from churnscope.functions import (
    customer_age_days,
    is_live,
    killed_flag,
    relative_month,
    rolling_month,
    week_bucket,
)


def _month_table(end_month: int) -> dict[int, int]:
    # Written from the definition: the end month is 0, earlier months count
    # up, months after the end month (in the calendar) wrap to 11, 10, ...
    out = {}
    for m in range(1, 13):
        out[m] = end_month - m if m <= end_month else 12 - (m - end_month)
    return out


def test_relative_month_all_end_months(spark):
    rows = []
    for em in range(1, 13):
        end = dt.date(2001, em, 15)
        for m in range(1, 13):
            rows.append((end, dt.date(2000, m, 10), _month_table(em)[m]))
    df = spark.createDataFrame(rows, "e date, d date, want int")
    got = df.select(relative_month("d", "e").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_week_bucket_every_age(spark):
    end = dt.date(2000, 3, 1)  # leap year: the window crosses Feb 29
    rows = [(end, end - dt.timedelta(days=a), a) for a in range(-3, 60)]
    df = spark.createDataFrame(rows, "e date, d date, age int")
    got = df.select("age", week_bucket("d", "e", 6).alias("w")).collect()
    for r in got:
        want = r.age // 7 + 1 if 0 <= r.age <= 41 else None
        assert r.w == want, r


def test_rolling_month_caps_at_eleven(spark):
    end = dt.date(2000, 12, 31)
    rows = [(end, end - dt.timedelta(days=a), a) for a in range(0, 365)]
    df = spark.createDataFrame(rows, "e date, d date, age int")
    for r in df.select("age", rolling_month("d", "e").alias("m")).collect():
        assert r.m == min(r.age // 30, 11)


def test_customer_age_live_killed(spark):
    e = dt.date(2000, 6, 30)
    t_end = e + dt.timedelta(days=365)
    rows = [
        (e, None, True, 1, 0),                                  # opened on the end day
        (e + dt.timedelta(days=1), None, False, 0, 0),          # opened after
        (dt.date(2000, 1, 1), e, False, 182, 1),                # closed on the end day: not live
        (dt.date(2000, 1, 1), e + dt.timedelta(days=1), True, 182, 1),
        (dt.date(2000, 1, 1), t_end, True, 182, 0),             # closes on target end: not killed
    ]
    df = spark.createDataFrame(rows, "c date, k date, live boolean, age int, killed int")
    got = df.select(
        is_live("c", "k", F.lit(e)).alias("l"),
        customer_age_days(F.lit(e), "c").alias("a"),
        killed_flag("k", F.lit(t_end)).alias("kf"),
        "live", "age", "killed",
    ).collect()
    for r in got:
        assert r.l == r.live
        if r.live:
            assert r.a == r.age
        assert r.kf == r.killed
