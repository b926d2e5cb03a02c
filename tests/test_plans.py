"""Plan-shape tests: no Python in the feature plan, filters reach the scan,
builders run no jobs, broadcast sides are the bounded tables."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout

import pytest

from churnscope.operators import asof as A
from churnscope.operators import features as FE
from churnscope.sources import fixtures as X
from churnscope.sources import read_bucketed, read_ledger, write_bucketed
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_several_days_plan_has_no_python_and_carries_no_day_into_its_first_shuffle(spark, small):
    led, reg = small
    plan = _plan(FE.feature_frame(led, reg, A.backtest_days(spark, X.TRAINING_END)))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "Expand", "BroadcastNestedLoopJoin",
                 "ObjectHashAggregate", "SortAggregate"):
        assert node not in plan
    # Transactions and posting dates are combined once, without the days; the
    # only exchange with a day is the one of (day, entity) sums.
    assert plan.count("hashpartitioning(customer_level") >= 1
    assert plan.count("hashpartitioning(loop_day") == 1
    exchanges = re.findall(r"Arguments: hashpartitioning\((.*?), 8\)", plan)
    assert any(x.startswith("customer_level") and "key" in x and "on#" in x for x in exchanges)


def test_first_shuffle_does_not_grow_with_the_days(spark, small):
    led, _ = small
    rows = {}
    for n in (4, 32):
        days = A.backtest_days(spark, X.TRAINING_END, periods=n + 1)
        lines, keys = FE._customer_lines(led, None, "custno")
        rows[n] = FE.posting_dates(lines, days, keys, True).count()
    # 28 more days read 28 more days of lines, of some 760
    assert rows[32] <= 1.1 * rows[4]


def test_date_span_reaches_the_parquet_scan(spark, tmp_path):
    raws = X.raw_extracts(spark, SF_SMALL)
    paths = []
    for i, r in enumerate(raws):
        p = str(tmp_path / f"e{i}")
        r.write.parquet(p)
        paths.append(p)
    led = read_ledger(spark, paths, X.HANDOVER)
    reg = X.register(spark, SF_SMALL)
    plan = _plan(FE.feature_frame(led, reg, A.training_day(spark, X.TRAINING_END)))
    scans = [ln for ln in plan.splitlines() if ln.startswith("PushedFilters")]
    assert scans and all("POSTDATE" in ln for ln in scans if "COMPNO" in ln)
    assert any("GreaterThanOrEqual(POSTDATE,1998-07-01)" in ln for ln in scans)


def test_builders_run_no_jobs(spark, small):
    led, reg = small
    sc = spark.sparkContext
    sc.setJobGroup("builder-check", "builder-check")
    try:
        days = A.backtest_days(spark, X.TRAINING_END)
        FE.feature_frame(led, reg, days)
        FE.daily_lag_wide(led, days)
        assert sc.statusTracker().getJobIdsForGroup("builder-check") == []
    finally:
        sc.setJobGroup("other", "other")


def test_any_number_of_days_and_rules(spark):
    import datetime as dt

    from churnscope.config import SegmentRule
    from churnscope.operators import campaign as C

    assert A.backtest_days(spark, dt.date(2000, 1, 1), periods=6001).frame.count() == 6000
    assert C.segment_rules(spark, [SegmentRule(str(i), 0.0, 1) for i in range(300)]).count() == 300


def test_company_level_shuffles_no_raw_line(spark, small):
    led, reg = small
    plan = _plan(FE.feature_frame(led, reg, A.training_day(spark, X.TRAINING_END), "compid"))
    # lines are combined per customer and transaction below the join that brings the company
    company = plan.index("_company")
    assert "partial_bit_or" in plan and company > 0
    exchanges = re.findall(r"Arguments: hashpartitioning\((.*?), 8\)", plan)
    assert not any("SALES" in x or "POSTDATE" in x for x in exchanges)


def test_bucketed_tables_need_no_exchange_below_the_first_aggregate(spark, small, tmp_path):
    names = ("plan_ledger", "plan_register")
    for name, rows in zip(names, small, strict=True):
        write_bucketed(rows, name, 8, str(tmp_path / name))
    try:
        led, reg = (read_bucketed(spark, name) for name in names)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        one, days = A.training_day(spark, X.TRAINING_END), A.backtest_days(spark, X.TRAINING_END)
        plan = _plan(FE.feature_frame(led, reg, one))
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan and "Exchange" not in plan
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10 << 20)
        several = re.findall(r"Arguments: hashpartitioning\((.*?), \d+\)", _plan(FE.feature_frame(led, reg, days)))
        assert not several  # a customer's days are in its bucket too
        for asof in (one, days):
            got, want = (FE.feature_frame(*tables, asof).collect() for tables in ((led, reg), small))
            assert sorted(map(str, got)) == sorted(map(str, want)) and got
        with pytest.raises(ValueError, match="not bucketed by COMPID"):
            read_bucketed(spark, names[1], "COMPID")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            spark.sql(f"drop table if exists {name}")
