"""churnscope: customer churn analytics as of a date, on Spark.

From a ledger of sales lines and a customer register it builds, in one
distributed plan for any number of as-of days, trailing month and week
activity features, live-customer and activity filters and churn labels;
trains and applies a gradient-boosted-tree model with Spark ML; backtests it
day by day; compares training and scoring populations; and exports segmented
call lists.

Layout:

* ``sources``    ledger extracts, register snapshots, CSV sink, test-data adapters
* ``functions``  column expressions (relative month, week bucket, ages, flags)
* ``operators``  DataFrame -> DataFrame building blocks (as-of windows, features,
                 model, metrics, campaign, drift)
* ``plans``      end-to-end compositions (evaluation, current prediction) and
                 the catalogue of named queries
"""

from churnscope.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
