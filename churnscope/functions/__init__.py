"""Column expressions (JVM-side, codegen-friendly; no Python UDFs)."""

from churnscope.functions.dates import (
    age_days,
    customer_age_days,
    in_window,
    is_live,
    killed_flag,
    relative_month,
    rolling_month,
    week_bucket,
)

__all__ = [
    "age_days",
    "customer_age_days",
    "in_window",
    "is_live",
    "killed_flag",
    "relative_month",
    "rolling_month",
    "week_bucket",
]
