"""As-of window tables.

An as-of day is described by seven dates: month-feature start, lag start,
feature end, active start/end and target start/end.  Instead of passing them
as strings to one call per day, they are rows of a small table keyed by
``loop_day``; every feature operator evaluates all rows in one plan.

The dates come from one :class:`Windows` (lengths in days before and after the
feature end) or are given row by row (:func:`asof_rows`).  The overall span of
each window is kept on the driver as literals, so scans are pruned with pushed
filters.  Ledger lines meet the table by an equi-join on 32-day buckets, so
Spark chooses the join, whatever the number of days.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.config import (
    ACTIVE_DAYS_EVALUATION,
    BACKTEST_PERIODS,
    CHURN_DAYS,
    EVALUATION_GAP_DAYS,
    LAG_WINDOW_DAYS,
    MONTH_WINDOW_DAYS,
)

WINDOW_COLUMNS = ("month_start", "lag_start", "feature_end", "active_start",
                  "active_end", "target_start", "target_end")
# Window -> its first and last date.  ``active_from`` is where activity is
# counted from (see Windows.active_in_year).
RANGES = {"month": ("month_start", "feature_end"), "lag": ("lag_start", "feature_end"),
          "active": ("active_from", "active_end"), "target": ("target_start", "target_end")}
BUCKET_DAYS = 32


@dataclass(frozen=True)
class Windows:
    """Window lengths in days, counted from the feature end.

    ``active_in_year``: activity is counted among the month window's lines
    only, so an active window that starts earlier is cut there (the current
    prediction's rule); otherwise the active window stands for itself.
    """

    month_days: int = MONTH_WINDOW_DAYS
    lag_days: int = LAG_WINDOW_DAYS
    active_days: int = ACTIVE_DAYS_EVALUATION
    churn_days: int = CHURN_DAYS
    active_in_year: bool = False

    def columns(self, end: Column) -> list[Column]:
        back = min(self.active_days, self.month_days) if self.active_in_year else self.active_days
        return [
            F.date_sub(end, self.month_days).alias("month_start"),
            F.date_sub(end, self.lag_days).alias("lag_start"),
            end.alias("feature_end"),
            F.date_sub(end, self.active_days).alias("active_start"),
            end.alias("active_end"),
            F.date_add(end, 1).alias("target_start"),
            F.date_add(end, self.churn_days).alias("target_end"),
            F.date_sub(end, back).alias("active_from"),
        ]

    def dates(self, end: dt.date) -> dict[str, dt.date]:
        back = min(self.active_days, self.month_days) if self.active_in_year else self.active_days

        def before(days: int) -> dt.date:
            return end - dt.timedelta(days=days)

        return {"month_start": before(self.month_days), "lag_start": before(self.lag_days), "feature_end": end,
                "active_start": before(self.active_days), "active_end": end, "target_start": before(-1),
                "target_end": before(-self.churn_days), "active_from": before(back)}


@dataclass(frozen=True)
class AsOf:
    """A set of as-of days.

    ``frame``: one row per ``loop_day`` with the seven window dates and
    ``active_from``.  ``spans``: window -> earliest start and latest end over
    all days.  ``single``: ``loop_day`` and dates when the set holds one day
    known on the driver; such a day is attached to rows as literal columns
    instead of a join.
    """

    frame: DataFrame
    n_days: int
    spans: Mapping[str, tuple[dt.date, dt.date]]
    first_end: dt.date
    last_end: dt.date
    single: tuple[int, dict[str, dt.date]] | None = None

    def span(self, *windows: str) -> tuple[dt.date, dt.date]:
        """Earliest and latest date any of the windows reads."""
        return min(self.spans[w][0] for w in windows), max(self.spans[w][1] for w in windows)

    def day_literal(self) -> Column:
        return F.lit(self.single[0]).cast("int").alias("loop_day")

    def attach(self, df: DataFrame) -> DataFrame:
        """Add the single day's ``loop_day`` and window dates as literal
        columns (constant-folded, so conditions on them reach the scan)."""
        day, dates = self.single
        return df.select("*", self.day_literal(), *(F.lit(d).alias(name) for name, d in dates.items()))

    def reaching(self, lag_days: int) -> AsOf:
        """The same days with a lag window of at least ``lag_days`` days."""
        first, last = self.spans["lag"]
        least = F.least(F.col("lag_start"), F.date_sub(F.col("feature_end"), lag_days))
        single = self.single
        if single is not None:
            dates = single[1]
            reach = min(dates["lag_start"], dates["feature_end"] - dt.timedelta(days=lag_days))
            single = (single[0], {**dates, "lag_start": reach})
        spans = {**self.spans, "lag": (min(first, self.first_end - dt.timedelta(days=lag_days)), last)}
        return replace(self, frame=self.frame.withColumn("lag_start", least), spans=spans, single=single)

    def meet(self, lines: DataFrame, *windows: str) -> DataFrame:
        """Each line once per as-of day with one of the ``windows`` around its
        ``POSTDATE``; the day's columns are added.

        The overall span is applied first as literals, which reach the scan.
        """
        first, last = self.span(*windows)
        posted = F.col("POSTDATE")
        rows = lines.where((posted >= F.lit(first)) & (posted <= F.lit(last)))
        inside = F.lit(False)
        for w in windows:
            start, end = RANGES[w]
            inside = inside | ((posted >= F.col(start)) & (posted <= F.col(end)))
        if self.single is not None:
            return self.attach(rows).where(inside)
        starts, ends = ([F.col(RANGES[w][k]) for w in windows] for k in (0, 1))
        low, high = (f(*c) if len(c) > 1 else c[0] for f, c in ((F.least, starts), (F.greatest, ends)))
        days = self.frame.withColumn("_bucket", F.explode(F.sequence(_bucket(low), _bucket(high))))
        return rows.withColumn("_bucket", _bucket(posted)).join(days, "_bucket").where(inside).drop("_bucket")


def _bucket(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BUCKET_DAYS)


def literal_rows(spark: SparkSession, rows: Sequence[Column]) -> DataFrame:
    """A small literal table from struct columns, built in the JVM (folds to
    a local relation; no Python worker, no driver-side RDD)."""
    return spark.range(1).select(F.inline(F.array(*rows)))


def _spans(dates: Sequence[Mapping[str, dt.date]]) -> dict[str, tuple[dt.date, dt.date]]:
    return {w: (min(d[start] for d in dates), max(d[end] for d in dates)) for w, (start, end) in RANGES.items()}


def asof_days(spark: SparkSession, ends: Sequence[dt.date], loop_days: Sequence[int] | None = None,
              active_days: int = ACTIVE_DAYS_EVALUATION, windows: Windows | None = None) -> AsOf:
    """As-of table for feature-end dates; ``windows`` replaces ``active_days``."""
    ends = list(ends)
    if not ends:
        raise ValueError("no as-of days")
    windows = windows or Windows(active_days=active_days)
    loop_days = list(loop_days) if loop_days is not None else list(range(len(ends)))
    base = literal_rows(spark, [
        F.struct(F.lit(int(i)).cast("int").alias("loop_day"), F.lit(e).cast("date").alias("e"))
        for i, e in zip(loop_days, ends, strict=True)])
    frame = base.select(F.col("loop_day"), *windows.columns(F.col("e")))
    single = (int(loop_days[0]), windows.dates(ends[0])) if len(ends) == 1 else None
    return AsOf(frame, len(ends), _spans([windows.dates(e) for e in (min(ends), max(ends))]), min(ends), max(ends), single)


def asof_rows(spark: SparkSession, rows: Sequence[Mapping[str, dt.date | int]]) -> AsOf:
    """As-of table from rows of ``loop_day`` and the seven dates, each free.

    Windows stand for themselves: activity, weeks and lags are not cut at the
    month window.
    """
    rows = [dict(r) for r in rows]
    if not rows:
        raise ValueError("no as-of days")
    for r in rows:
        missing = {"loop_day", *WINDOW_COLUMNS} - set(r)
        if missing:
            raise ValueError(f"as-of row lacks {sorted(missing)}")
        r["active_from"] = r["active_start"]
    names = [*WINDOW_COLUMNS, "active_from"]
    frame = literal_rows(spark, [
        F.struct(F.lit(int(r["loop_day"])).cast("int").alias("loop_day"), *(F.lit(r[n]).cast("date").alias(n) for n in names))
        for r in rows])
    ends = [r["feature_end"] for r in rows]
    single = (int(rows[0]["loop_day"]), {n: rows[0][n] for n in names}) if len(rows) == 1 else None
    return AsOf(frame, len(rows), _spans(rows), min(ends), max(ends), single)


def training_day(spark: SparkSession, end: dt.date, active_days: int = ACTIVE_DAYS_EVALUATION,
                 windows: Windows | None = None) -> AsOf:
    """A single as-of day with ``loop_day = 0``."""
    return asof_days(spark, [end], [0], active_days, windows)


def backtest_days(spark: SparkSession, training_end: dt.date, periods: int = BACKTEST_PERIODS,
                  active_days: int = ACTIVE_DAYS_EVALUATION, shift_days: int | None = None,
                  windows: Windows | None = None) -> AsOf:
    """Backtest day i in ``1..periods-1`` ends ``i + shift_days`` after training.

    ``shift_days`` defaults to the windows' churn days, so the first day's
    features start where the training labels end.  Built from ``spark.range``
    so no list of dates is materialised on the driver.
    """
    n = periods - 1
    if n < 1:
        raise ValueError("periods must be at least 2")
    windows = windows or Windows(active_days=active_days)
    shift_days = windows.churn_days if shift_days is None else shift_days
    ids = spark.range(1, periods, numPartitions=1).select(F.col("id").cast("int").alias("loop_day"))
    end = F.date_add(F.lit(training_end), F.col("loop_day") + F.lit(shift_days))
    frame = ids.select(F.col("loop_day"), *windows.columns(end))
    ends = [training_end + dt.timedelta(days=i + shift_days) for i in (1, n)]
    single = (1, windows.dates(ends[0])) if n == 1 else None
    return AsOf(frame, n, _spans([windows.dates(e) for e in ends]), ends[0], ends[-1], single)


def prediction_days(spark: SparkSession, latest_posting: dt.date, churn_days: int = CHURN_DAYS,
                    shift_days: int | None = None) -> tuple[AsOf, AsOf]:
    """Training and scoring days of the current prediction.

    Training ends ``churn_days`` before the newest posting, so its target
    window of as many days is complete, and counts every customer with a
    purchase in the trailing ``churn_days`` as active; scoring shifts all
    dates by ``shift_days`` (``churn_days + 1``).  At the usual 365 days
    activity is counted among the trailing year's lines (364 days back), as in
    the analysed workload; longer windows stand for themselves.
    """
    windows = Windows(active_days=churn_days, churn_days=churn_days, active_in_year=churn_days <= CHURN_DAYS)
    shift_days = churn_days + 1 if shift_days is None else shift_days
    train_end = latest_posting - dt.timedelta(days=churn_days)
    train = asof_days(spark, [train_end], [0], windows=windows)
    score = asof_days(spark, [train_end + dt.timedelta(days=shift_days)], [0], windows=windows)
    return train, score


def latest_posting_date(ledger: DataFrame) -> dt.date:
    """Newest ``POSTDATE``: one scalar aggregate job over that column alone.

    Pass the newest extract instead of the whole ledger, or the date itself to
    the pipelines, where it is known.
    """
    return ledger.agg(F.max("POSTDATE").alias("d")).first()["d"]


def evaluation_training_end(latest: dt.date, churn_days: int = CHURN_DAYS, gap_days: int = EVALUATION_GAP_DAYS) -> dt.date:
    """Training end that leaves ``gap_days`` of data after a full label window."""
    return latest - dt.timedelta(days=churn_days + gap_days)
