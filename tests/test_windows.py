"""Free windows, exact sales, company level, encoders and the model's input layout."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from churnscope.operators import asof as A
from churnscope.operators import campaign as C
from churnscope.operators import drift as D
from churnscope.operators import features as FE
from churnscope.operators import ledger_ops as L
from churnscope.operators import model as MD
from churnscope.plans import pipelines as P
from churnscope.sources import fixtures as X
from churnscope.sources import normalise_register, to_ledger
from tests.conftest import SF_SMALL

END = dt.date(2000, 6, 30)
LEDGER = "CUSTNO long, POSTDATE date, TRANSREFNO long, SALES decimal(18,2)"


def daily(spark, days, sales=1):
    rows = [(1, END - dt.timedelta(days=k), k + 1, sales) for k in days]
    return spark.createDataFrame(rows, "CUSTNO long, POSTDATE date, TRANSREFNO long, SALES int").withColumn(
        "SALES", F.col("SALES").cast("decimal(18,2)"))


def register(spark, **values):
    row = {"CUSTNO": 1, "COMPID": 7, "CREDATE": dt.date(1990, 1, 1), "KILLDATE": None, "REGION": 1, "CUSTCLASS": "A"} | values
    return spark.createDataFrame([tuple(row.values())], "CUSTNO long, COMPID long, CREDATE date, KILLDATE date, REGION int, CUSTCLASS string")


@pytest.mark.parametrize("n_weeks", [12, 49, 60, 130])
def test_every_week_is_counted(spark, n_weeks):
    led = daily(spark, range(1000))
    for days in (A.training_day(spark, END), A.asof_days(spark, [END, END - dt.timedelta(days=1)])):
        for strategy in ("flags", "distinct"):
            row = FE.feature_frame(led, register(spark), days, n_weeks=n_weeks, with_label=False, strategy=strategy).where("loop_day = 0").first()
            assert [row[f"Week_{j}"] for j in range(1, n_weeks + 1)] == [7] * n_weeks
        wide = FE.features_week(led, days, n_weeks=n_weeks).where("loop_day = 0").first()
        assert [wide[f"Week_{j}"] for j in range(1, n_weeks + 1)] == [7] * n_weeks


def test_every_lag_is_counted(spark):
    row = FE.daily_lag_wide(daily(spark, range(200)), A.training_day(spark, END), n_lags=120).first()
    assert [row[f"lag_{k}"] for k in range(1, 121)] == [1] * 120


def test_a_long_active_window_is_not_cut(spark):
    led = daily(spark, range(500, 600))
    days = A.training_day(spark, END, active_days=730)
    assert FE.active_customers(led, days).first()["UNIQUE_TRANSREFNO_ACTIVE"] == 100
    for strategy in ("flags", "distinct"):
        row = FE.feature_frame(led, register(spark), days, with_label=False, strategy=strategy).first()
        assert row["UNIQUE_TRANSREFNO_ACTIVE"] == 100 and row["Month_1"] == 0


def test_current_prediction_counts_activity_within_the_year(spark):
    train, score = A.prediction_days(spark, END + dt.timedelta(days=365))
    assert train.single[1]["active_start"] == END - dt.timedelta(days=365)
    assert FE.active_customers(daily(spark, [365]), train).count() == 0
    assert FE.active_customers(daily(spark, [364]), train).first()["UNIQUE_TRANSREFNO_ACTIVE"] == 1
    assert score.first_end == END + dt.timedelta(days=366)


def test_churn_days_reach_target_and_shift(spark):
    latest = dt.date(2001, 8, 1)
    train, score = A.prediction_days(spark, latest, churn_days=180)
    assert train.single[1]["target_end"] == latest and train.first_end == latest - dt.timedelta(days=180)
    assert score.first_end == latest + dt.timedelta(days=1)
    windows = A.Windows(churn_days=180)
    days = A.backtest_days(spark, END, windows=windows)
    rows = days.frame.orderBy("loop_day").collect()
    assert rows[0].feature_end == END + dt.timedelta(days=181) and rows[0].target_end == rows[0].feature_end + dt.timedelta(days=180)


def test_evaluate_takes_windows_and_mature_rows_only(spark, small):
    led, reg = small
    windows = A.Windows(churn_days=200, active_days=120)
    ev = P.evaluate(led, reg, X.TRAINING_END, use_model=False, windows=windows)
    assert ev.backtest.first_end == X.TRAINING_END + dt.timedelta(days=201)
    latest = ev.backtest.first_end + dt.timedelta(days=201)  # the second day's labels are complete, the third's are not
    mature = P.evaluate(led, reg, X.TRAINING_END, use_model=False, windows=windows, latest=latest).metrics.collect()
    assert {r.loop_day: r.total_companies > 0 for r in mature} == {1: True, 2: True, 3: False, 4: False}


def test_free_rows_need_all_dates(spark):
    with pytest.raises(ValueError, match="lacks"):
        A.asof_rows(spark, [{"loop_day": 0, "feature_end": END}])


@pytest.mark.parametrize("kind, value, total", [("double", 19.99, 1999.0), ("decimal(18,3)", "0.005", 0.5), ("float", 19.99, 1999.0)])
def test_sales_are_exact_on_every_path(spark, kind, value, total):
    rows = [(1, END - dt.timedelta(days=k % 20), k % 30, str(value)) for k in range(100)]
    led = spark.createDataFrame(rows, "CUSTNO long, POSTDATE date, TRANSREFNO long, SALES string").withColumn("SALES", F.col("SALES").cast(kind))
    for days in (A.training_day(spark, END), A.asof_days(spark, [END, END - dt.timedelta(days=400)])):
        found = [FE.feature_frame(led, register(spark), days, with_label=False, strategy=s).where("loop_day = 0").first()["total_sales"]
                 for s in ("flags", "distinct")]
        found.append(float(FE.total_sales(led, days).where("loop_day = 0").first()["total_sales"]))
        found.append(FE.feature_frame(to_ledger(led), register(spark), days, with_label=False).where("loop_day = 0").first()["total_sales"])
        assert found == [total] * 4


def test_company_predictions_meet_their_own_register_row(spark):
    reg = spark.createDataFrame([(c, 7, dt.date(1990, 1, 1), None, 1, "A") for c in (1, 2, 3)],
                                "CUSTNO long, COMPID long, CREDATE date, KILLDATE date, REGION int, CUSTCLASS string")
    led = daily(spark, range(5))
    cur = P.predict_current(led, reg, "compid", use_model=False, checkpoint=False, latest=END)
    assert cur.predictions.count() == 3
    assert sorted(r.CUSTNO for r in C.enrich_predictions(cur.predictions, reg, "compid").collect()) == [1, 2, 3]
    assert C.prediction_audit(cur.scoring, cur.predictions).count() == 3
    assert C.churners_with_register(cur.predictions, reg, None, ("CUSTCLASS",), "compid").count() <= 3
    with pytest.raises(ValueError, match="CUSTNO"):
        C.enrich_predictions(cur.predictions.drop("CUSTNO"), reg, "compid")


def test_company_counts_merge_customers_of_a_shared_transaction(spark):
    led = spark.createDataFrame([(c, END, t, 1) for c, t in ((1, 5), (2, 5), (2, 6))], "CUSTNO long, POSTDATE date, TRANSREFNO long, SALES int")
    reg = spark.createDataFrame([(c, 7, dt.date(1990, 1, 1), None, 1, "A") for c in (1, 2)],
                                "CUSTNO long, COMPID long, CREDATE date, KILLDATE date, REGION int, CUSTCLASS string")
    for days in (A.training_day(spark, END), A.asof_days(spark, [END, END - dt.timedelta(days=400)])):
        for strategy in ("flags", "distinct"):
            rows = FE.feature_frame(led, reg, days, "compid", with_label=False, strategy=strategy).where("loop_day = 0").collect()
            assert [(r.Month_0, r.UNIQUE_TRANSREFNO_ACTIVE, r.total_sales) for r in rows] == [(2, 2, 3.0)] * 2


def test_drilldown_keeps_every_key(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "customer_level long, x string")
    keys = spark.createDataFrame([(1,), (3,), (3,)], "customer_level long")
    assert sorted(r.x for r in C.drilldown(frame, keys).collect()) == ["a", "c"]


def test_unseen_and_null_categories(spark):
    schema = "CUSTCLASS string, REGION int"
    train = spark.createDataFrame([("A", 1), ("B", 2), (None, None), ("B", 1)], schema)
    pred = spark.createDataFrame([("B", 1), ("C", 1), (None, 1)], schema)
    got = {(r.dataset, r.CUSTCLASS): (r.CUSTCLASS_index, r["count"]) for r in D.class_index_counts(train, pred).collect()}
    assert got == {("train", "A"): (1.0, 1), ("train", "B"): (0.0, 2), ("train", None): (2.0, 1),
                   ("pred", "B"): (0.0, 1), ("pred", "C"): (2.0, 1), ("pred", None): (2.0, 1)}
    index = {(r.input_column, r.value): r.label_index for r in D.category_index(train).collect()}
    assert index == {("CUSTCLASS", "B"): 0.0, ("CUSTCLASS", "A"): 1.0, ("REGION", "2"): 0.0, ("REGION", "1"): 1.0}


def test_encoded_frame_keeps_all_columns(spark, small):
    led, reg = small
    frame = FE.feature_frame(led, reg, A.training_day(spark, X.TRAINING_END))
    full = MD.model_inputs(MD.encoder(), frame, keep_all=True)
    assert set(frame.columns) <= set(full.columns)
    assert {"CUSTCLASS_index", "CUSTCLASS_vector", "REGION_index", "REGION_vector", "features"} <= set(full.columns)
    row = full.first()
    assert row["CUSTCLASS_vector"] == row["features"][:len(row["CUSTCLASS_vector"])]


def test_a_model_over_more_weeks(spark, small):
    led, reg = small
    frame = FE.feature_frame(led, reg, A.training_day(spark, X.TRAINING_END), n_weeks=9)
    numeric = MD.numeric_inputs(frame)
    assert [c for c in numeric if c.startswith("Week_")] == [f"Week_{j}" for j in range(1, 10)]
    model = MD.fit(MD.classifier_pipeline({"maxIter": 1, "maxDepth": 2, "seed": 1}, numeric=numeric), frame)
    assert MD.score(model, frame).count() == frame.count()
    assert "Week_9" in C.prediction_audit(frame, MD.score(model, frame)).columns


def test_metrics_agree_with_the_predictions(spark, small):
    led, reg = small
    ev = P.evaluate(led, reg, X.TRAINING_END, gbt_params={"maxIter": 2, "maxDepth": 2, "seed": 42})
    rows = ev.predictions.collect()
    for m in ev.metrics.collect():
        own = [r for r in rows if r.loop_day == m.loop_day]
        hit = sum(r.indexedLabel == 1 and r.prediction == 1 for r in own)
        assert m.total_companies == len(own)
        assert m.accuracy == pytest.approx(sum(r.indexedLabel == r.prediction for r in own) / len(own))
        flagged, churned = sum(r.prediction == 1 for r in own), sum(r.indexedLabel == 1 for r in own)
        assert m.precision == (pytest.approx(hit / flagged) if flagged else None)
        assert m.recall == (pytest.approx(hit / churned) if churned else None)


def test_sorted_outputs_are_in_order(spark):
    newest = L.register_newest(X.register(spark, SF_SMALL)).collect()
    assert [(r.CREDATE, -r.CUSTNO) for r in newest] == sorted(((r.CREDATE, -r.CUSTNO) for r in newest), reverse=True)
    frame = spark.createDataFrame([(k, float(k % 7), 1.0) for k in range(40)], "customer_level long, total_sales double, prediction double")
    top = C.top_churners(frame).collect()
    assert [(-r.total_sales, r.customer_level) for r in top] == sorted((-r.total_sales, r.customer_level) for r in top)


def test_register_text_columns_are_typed(spark):
    raw = spark.createDataFrame([("5", "2", "87", "2001-02-03")], "CUSTNO string, COMPID string, REGION string, CREDATE string")
    row = normalise_register(raw).first()
    assert (row.CUSTNO, row.COMPID, row.REGION, row.CREDATE) == (5, 2, 87, dt.date(2001, 2, 3))


def test_a_long_churn_window_counts_all_its_activity(spark):
    train, score = A.prediction_days(spark, END + dt.timedelta(days=730), churn_days=730)
    for days, end in ((train, END), (score, END + dt.timedelta(days=731))):
        assert days.single[1]["active_from"] == days.single[1]["active_start"] == end - dt.timedelta(days=730)
    led = daily(spark, [365, 730, 731])
    assert FE.active_customers(led, train).first()["UNIQUE_TRANSREFNO_ACTIVE"] == 2
    for strategy in ("flags", "distinct"):
        row = FE.feature_frame(led, register(spark), train, strategy=strategy).first()
        assert row["UNIQUE_TRANSREFNO_ACTIVE"] == 2 and row["Month_1"] == 0


@pytest.mark.parametrize("kind,refs", [("string", ["007", "7", "8", "x-1", None]), ("decimal(20,0)", [7, 8, 9, 2 ** 63, None])])
def test_references_keep_their_own_type(spark, kind, refs):
    rows = spark.createDataFrame([(1, END, r if r is None else str(r), "2.50") for r in refs],
                                 "CUSTNO long, POSTDATE date, TRANSREFNO string, SALES string")
    led = rows.withColumn("TRANSREFNO", F.col("TRANSREFNO").cast(kind)).withColumn("SALES", F.col("SALES").cast("decimal(18,2)"))
    one, two = A.training_day(spark, END), A.asof_days(spark, [END, END + dt.timedelta(days=1)])
    for days in (one, two):
        for strategy in ("flags", "distinct"):
            row = FE.feature_frame(led, register(spark), days, with_label=False, strategy=strategy).where("loop_day = 0").first()
            assert (row["UNIQUE_TRANSREFNO_ACTIVE"], row["Week_1"], row["total_sales"]) == (4, 4, 12.5)


def test_days_far_apart_and_many_dates_of_one_transaction(spark):
    led = daily(spark, range(0, 1500, 7)).unionByName(daily(spark, range(3, 900, 100)).withColumn("TRANSREFNO", F.lit(5).cast("long")))
    days = A.asof_days(spark, [END - dt.timedelta(days=k) for k in (0, 1, 63, 64, 65, 400, 900)])
    reg = register(spark, CREDATE=dt.date(1980, 1, 1))
    frames = [FE.feature_frame(led, reg, days, strategy=s).orderBy("loop_day").collect() for s in ("flags", "distinct")]
    assert frames[0] == frames[1] and len(frames[0]) == 7


def test_a_repeated_customer_number_fails_company_queries(spark):
    reg = register(spark).unionByName(register(spark, COMPID=8))
    led = daily(spark, [1])
    for days in (A.training_day(spark, END), A.asof_days(spark, [END, END - dt.timedelta(days=1)])):
        with pytest.raises(Exception, match="CUSTNO 1 more than once"):
            FE.feature_frame(led, reg, days, level="compid").collect()
    with pytest.raises(Exception, match="CUSTNO 1 more than once"):
        FE.enrich_ledger(led, reg).collect()
    with pytest.raises(Exception, match="CUSTNO 1 more than once"):
        FE.total_sales(led, A.training_day(spark, END), "compid", reg).collect()
    nulls = register(spark).unionByName(register(spark, CUSTNO=None)).unionByName(register(spark, CUSTNO=None))
    assert FE.enrich_ledger(led, nulls).first()["COMPID"] == 7
