"""Backtest metrics over a predictions frame with ``loop_day``.

Everything is one Spark plan per result: no per-day collection, no driver
sets.  Positive class = churn = 1.  Ratios use ``try_divide`` (null when the
denominator is 0).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.config import SALES_CUTOFFS

LABEL = "indexedLabel"


def confusion_long(preds: DataFrame) -> DataFrame:
    """Counts per (day, label, prediction) for the cells that occur."""
    return preds.groupBy("loop_day", LABEL, "prediction").agg(F.count(F.lit(1)).alias("count"))


def _cell(label: float, pred: float):
    hit = (F.col(LABEL) == label) & (F.col("prediction") == pred)
    return F.sum(F.when(hit, F.lit(1)).otherwise(F.lit(0))).cast("long")


def confusion_wide(preds: DataFrame) -> DataFrame:
    """The four cells per day, named by value (absent cells are 0)."""
    return preds.groupBy("loop_day").agg(
        _cell(1.0, 1.0).alias("true_positives"),
        _cell(0.0, 1.0).alias("false_positive"),
        _cell(1.0, 0.0).alias("false_negative"),
        _cell(0.0, 0.0).alias("true_negative"),
    )


def _ratio(num, den):
    return F.try_divide(num.cast("double"), den.cast("double"))


def day_customer_flags(preds: DataFrame) -> DataFrame:
    """One row per (day, customer): flagged or not, whether this is the first
    day the customer is flagged, and the confusion cells of its rows.

    The first-flag mark is a window over each customer's rows (at most one
    per as-of day, so bounded), which keeps the whole metric a single linear
    plan: the prediction plan below runs once.
    """
    label, pred = F.col(LABEL), F.col("prediction")

    def cell(lv: float, pv: float):
        return F.sum(F.when((label == lv) & (pred == pv), F.lit(1)).otherwise(F.lit(0))).cast("long")

    per = preds.groupBy("loop_day", "customer_level").agg(
        F.max(F.when(pred == 1.0, F.lit(1)).otherwise(F.lit(0))).alias("flagged"),
        cell(1.0, 1.0).alias("tp"), cell(0.0, 1.0).alias("fp"),
        cell(1.0, 0.0).alias("fn"), cell(0.0, 0.0).alias("tn"),
    )
    before = (Window.partitionBy("customer_level").orderBy("loop_day")
              .rowsBetween(Window.unboundedPreceding, -1))
    earlier = F.coalesce(F.max("flagged").over(before), F.lit(0))
    return per.withColumn("first_flag", F.when((F.col("flagged") == 1) & (earlier == 0), F.lit(1))
                          .otherwise(F.lit(0)))


def _dynamics(flags: DataFrame, days: DataFrame | None) -> DataFrame:
    per_day = flags.groupBy("loop_day").agg(
        F.sum("flagged").cast("long").alias("predicted"),
        F.sum("first_flag").cast("long").alias("newly"),
        F.sum("tp").cast("long").alias("true_positives"),
        F.sum("fp").cast("long").alias("false_positive"),
        F.sum("fn").cast("long").alias("false_negative"),
        F.sum("tn").cast("long").alias("true_negative"),
    )
    j = per_day if days is None else days.join(per_day, "loop_day", "left")
    newly = F.coalesce(F.col("newly"), F.lit(0)).cast("long")
    running = Window.orderBy("loop_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = ["predicted", "true_positives", "false_positive", "false_negative", "true_negative"]
    return j.select(
        "loop_day",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in cells],
        newly.alias("newly_classified"),
        F.sum(newly).over(running).cast("long").alias("total_classified"),
    ).withColumn("fallen_out", (F.col("total_classified") - F.col("predicted")).cast("long"))


def set_dynamics(preds: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """How the predicted-churner set moves from day to day.

    With ``C_i`` the customers flagged on any day up to ``i`` and ``P_i`` those
    flagged on day i: ``newly_classified`` = |P_i \\ C_{i-1}|, ``fallen_out`` =
    |C_{i-1} \\ P_i| (against everyone flagged before, not only yesterday),
    ``total_classified`` = |C_i|.

    Closed form: newly_i = customers whose first flagged day is i; total is
    the running sum of newly; fallen_i = total_i - |P_i|.  The running sum is
    a window over one row per day (bounded by the as-of table); days without
    flags are kept when ``days`` is given.
    """
    d = _dynamics(day_customer_flags(preds), days)
    return d.select("loop_day", "predicted", "newly_classified", "total_classified", "fallen_out")


def backtest_metrics(preds: DataFrame, days: DataFrame | None = None, mature_only: bool = False) -> DataFrame:
    """One row per day: recall, precision, accuracy, newly classified,
    fallen out, total classified and total companies (0 on a day without
    predictions, where the ratios are null).

    ``mature_only`` keeps rows whose target window is complete (needs the
    ``label_mature`` column, see ``feature_frame(latest=...)``)."""
    if mature_only:
        preds = preds.where(F.col("label_mature"))
    d = _dynamics(day_customer_flags(preds), days)
    tp, fp, fn, tn = (F.col(c) for c in ("true_positives", "false_positive", "false_negative", "true_negative"))
    total = tp + fp + fn + tn
    return d.select(
        "loop_day",
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp + tn, total).alias("accuracy"),
        "newly_classified",
        "fallen_out",
        "total_classified",
        total.cast("long").alias("total_companies"),
    )


def _literals(values: Sequence[float], kind: str) -> Column:
    """Many numbers as one literal array (an expression each would make the plan as long as the list)."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def precision_by_cutoff(preds: DataFrame, loop_day: int = 1,
                        cutoffs: Sequence[float] = SALES_CUTOFFS) -> DataFrame:
    """Precision of one day's predicted churners above each sales cutoff
    (strictly greater).

    Each churner is counted once, by the number of cutoffs below its sales
    (found by halving the sorted list); sums from each number up answer the
    cutoffs, one window over at most ``len(cutoffs)`` rows.  Cutoffs nobody
    exceeds are kept with 0 predicted, repeated ones are repeated.
    """
    spark = preds.sparkSession
    ordered = sorted({float(c) for c in cutoffs})
    steps = F.sequence(F.lit(1), F.lit(max(1, len(ordered).bit_length())))
    cut_arr, sales = _literals(ordered, "double"), F.col("total_sales")

    def halved(span: Column, step: Column) -> Column:
        middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
        below = F.get(cut_arr, middle) < sales
        open_ = span["low"] < span["high"]
        return F.struct(F.when(open_ & below, middle + 1).otherwise(span["low"]).alias("low"),
                        F.when(open_ & ~below, middle).otherwise(span["high"]).alias("high"))

    exceeded = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(ordered)).alias("high")), halved, lambda span: span["low"])
    churn = preds.where((F.col("loop_day") == loop_day) & (F.col("prediction") == 1.0) & sales.isNotNull())
    counted = churn.select(exceeded.alias("exceeded"), LABEL).groupBy("exceeded").agg(
        F.count(F.lit(1)).alias("n"), F.sum(LABEL).alias("hits"))
    places = spark.range(len(ordered)).select((F.col("id") + 1).cast("int").alias("exceeded")).join(counted, "exceeded", "left")
    from_here = Window.orderBy("exceeded").rowsBetween(0, Window.unboundedFollowing)
    summed = places.select("exceeded", F.coalesce(F.sum("n").over(from_here), F.lit(0)).cast("long").alias("predicted"),
                           F.coalesce(F.sum("hits").over(from_here), F.lit(0.0)).cast("double").alias("correct"))
    number = {c: n for n, c in enumerate(ordered, 1)}
    asked = F.arrays_zip(_literals(cutoffs, "double").alias("cutoff"), _literals([number[float(c)] for c in cutoffs], "int").alias("exceeded"))
    given = spark.range(1).select(F.explode(asked).alias("c")).select("c.cutoff", "c.exceeded")
    return given.join(summed, "exceeded").select(
        "cutoff", "predicted", "correct", F.try_divide("correct", F.col("predicted").cast("double")).alias("precision"))
