"""Ledger summaries and the as-of schedule derived from the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.config import (
    ACTIVE_DAYS_EVALUATION,
    BACKTEST_PERIODS,
    CHURN_DAYS,
    EVALUATION_GAP_DAYS,
    LAG_WINDOW_DAYS,
    MONTH_WINDOW_DAYS,
)


def monthly_transactions(ledger: DataFrame) -> DataFrame:
    """Distinct transactions per calendar month (``yyyy-MM``)."""
    return (
        ledger.select(F.date_format("POSTDATE", "yyyy-MM").alias("year_month"), "TRANSREFNO")
        .groupBy("year_month")
        .agg(F.count_distinct("TRANSREFNO").alias("UNIQUE_TRANSREFNO"))
    )


def date_range(ledger: DataFrame) -> DataFrame:
    """Oldest and newest posting date, in one aggregate."""
    return ledger.agg(F.min("POSTDATE").alias("min_date"), F.max("POSTDATE").alias("max_date"))


def register_newest(register: DataFrame) -> DataFrame:
    """Register, newest account first (key breaks ties)."""
    return register.orderBy(F.col("CREDATE").desc_nulls_last(), F.col("CUSTNO").asc())


def asof_schedule(ledger: DataFrame, periods: int = BACKTEST_PERIODS,
                  gap_days: int = EVALUATION_GAP_DAYS, churn_days: int = CHURN_DAYS) -> DataFrame:
    """Every window set of one run, anchored at the newest posting.

    * ``evaluation_train`` (day 0): ends ``churn_days + gap_days`` before the
      newest posting; active window 90 days;
    * ``backtest`` days ``1..periods-1``: the evaluation dates shifted by
      ``i + churn_days``;
    * ``prediction_train`` (day 0): ends ``churn_days`` before the newest
      posting; active window ``churn_days``;
    * ``prediction_score`` (day 0): the prediction dates shifted by
      ``churn_days + 1``.

    Every target window is ``churn_days`` long.

    Built in one plan: the global max (one row) exploded into ``periods + 2``
    steps, so the table stays bounded whatever the ledger size.
    """
    latest = ledger.agg(F.max("POSTDATE").alias("latest"))
    j = latest.select(F.explode(F.sequence(F.lit(0), F.lit(periods + 1))).alias("id"), "latest")
    i = F.col("id").cast("int")
    eval_end = F.date_sub(F.col("latest"), churn_days + gap_days)
    pred_end = F.date_sub(F.col("latest"), churn_days)
    kind = (F.when(i == 0, F.lit("evaluation_train"))
            .when(i < periods, F.lit("backtest"))
            .when(i == periods, F.lit("prediction_train"))
            .otherwise(F.lit("prediction_score")))
    end = (F.when(i == 0, eval_end)
           .when(i < periods, F.date_add(eval_end, i + churn_days))
           .when(i == periods, pred_end)
           .otherwise(F.date_add(pred_end, churn_days + 1)))
    loop_day = F.when(i < periods, i).otherwise(F.lit(0))
    rows = j.select(kind.alias("purpose"), loop_day.alias("loop_day"), end.alias("e"), i.alias("i"))
    active = F.when(F.col("i") < periods, F.lit(ACTIVE_DAYS_EVALUATION)).otherwise(F.lit(churn_days))
    e = F.col("e")
    return rows.select(
        "purpose", "loop_day",
        F.date_sub(e, MONTH_WINDOW_DAYS).alias("month_start"),
        F.date_sub(e, LAG_WINDOW_DAYS).alias("lag_start"),
        e.alias("feature_end"),
        F.date_sub(e, active).alias("active_start"),
        e.alias("active_end"),
        F.date_add(e, 1).alias("target_start"),
        F.date_add(e, churn_days).alias("target_end"),
    )
