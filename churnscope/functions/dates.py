"""Date expressions used by the feature builder.

All take and return ``Column``s so they stay inside whole-stage codegen.
Window ends are columns too: one plan can evaluate many as-of days at once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnscope.config import N_MONTHS, N_WEEKS


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def age_days(end: Column | str, d: Column | str) -> Column:
    """Whole days from ``d`` to ``end`` (0 on the end day itself)."""
    return F.date_diff(_c(end), _c(d))


def in_window(d: Column | str, start: Column | str, end: Column | str) -> Column:
    """Closed range ``start <= d <= end`` (dates, so the end day is included)."""
    d = _c(d)
    return (d >= _c(start)) & (d <= _c(end))


def relative_month(d: Column | str, end: Column | str) -> Column:
    """Calendar month of ``d`` counted back from the month of ``end``.

    The end month is 0, the month before it 1, ... wrapping around the year,
    so a trailing 365-day window that starts in the end month also maps its
    oldest days to 0 (the known calendar overlap; see ``rolling_month``).
    """
    return ((F.month(_c(end)) - F.month(_c(d)) + N_MONTHS) % N_MONTHS).cast("int")


def rolling_month(d: Column | str, end: Column | str) -> Column:
    """30-day buckets counted back from ``end`` (0..11), no calendar overlap."""
    return F.least(F.floor(age_days(end, d) / 30), F.lit(N_MONTHS - 1)).cast("int")


def week_bucket(d: Column | str, end: Column | str, n_weeks: int = N_WEEKS) -> Column:
    """Week 1..n counted back from ``end``; week j covers ages 7(j-1)..7j-1.

    Null outside the first ``n_weeks`` weeks (including dates after ``end``).
    """
    age = age_days(end, d)
    return F.when((age >= 0) & (age < 7 * n_weeks), (F.floor(age / 7) + 1).cast("int"))


def customer_age_days(end: Column | str, created: Column | str) -> Column:
    """Days the customer has existed at ``end``, counting both end points."""
    return (F.date_diff(_c(end), _c(created)) + 1).cast("int")


def is_live(created: Column | str, killed: Column | str, end: Column | str) -> Column:
    """Open on or before ``end`` and not closed by ``end``."""
    k = _c(killed)
    return (_c(created) <= _c(end)) & (k.isNull() | (k > _c(end)))


def killed_flag(killed: Column | str, target_end: Column | str) -> Column:
    """1 when the account closes before the target window ends, else 0."""
    return F.when(_c(killed) < _c(target_end), F.lit(1)).otherwise(F.lit(0))
