"""From predictions to call lists.

Predictions are joined back to the register, projected to the campaign
columns and matched against a table of segment rules (one broadcast join for
any number of segments instead of one filter pass per segment).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.config import CAMPAIGN_COLUMNS, SegmentRule
from churnscope.operators.asof import literal_rows
from churnscope.operators.features import level_column


def predicted_churners(preds: DataFrame, loop_day: int | None = None) -> DataFrame:
    """Rows predicted to churn (optionally of one day)."""
    out = preds.where(F.col("prediction") == 1.0)
    if loop_day is not None:
        out = out.where(F.col("loop_day") == loop_day)
    return out


def churners_with_register(preds: DataFrame, register: DataFrame, loop_day: int | None = 1,
                           columns: Sequence[str] = ("CUSTCAT", "CZTURNOVER"),
                           level: str = "custno") -> DataFrame:
    """Predicted churners with a few register attributes (left join).

    At company level the predictions carry their register row's ``CUSTNO``,
    which is the join key, so each row meets its own register row only.
    """
    name = level_column(level).lower()
    churn = predicted_churners(preds, loop_day)
    if level_column(level) == "CUSTNO":
        churn = churn.withColumnRenamed("customer_level", name)
        return churn.join(register.select(F.col("CUSTNO").alias(name), *columns), name, "left")
    reg = register.select("CUSTNO", *columns)
    return _by_customer(churn, reg).withColumnRenamed("customer_level", name)


def _by_customer(preds: DataFrame, register: DataFrame) -> DataFrame:
    if "CUSTNO" not in preds.columns:
        raise ValueError("company-level predictions need CUSTNO (score with keep=('CUSTNO',))")
    return preds.join(register, "CUSTNO", "left")


def enrich_predictions(preds: DataFrame, register: DataFrame, level: str = "custno") -> DataFrame:
    """Predictions with every register column (left join on the customer
    number: ``customer_level`` itself, or at company level the ``CUSTNO`` that
    the predictions carry, so there is one row per prediction)."""
    key = level_column(level)
    if key != "CUSTNO":
        return _by_customer(preds, register.drop(key))  # the key is customer_level
    return preds.join(register.withColumnRenamed("CUSTNO", "customer_level"), "customer_level", "left")


def campaign_view(enriched: DataFrame, columns: Sequence[str] = CAMPAIGN_COLUMNS) -> DataFrame:
    """The call-list projection; contact columns the register lacks are null
    text.  At company level (predictions with ``CUSTNO``) the company id is
    ``customer_level``."""
    have = {c.upper(): c for c in enriched.columns}
    if "CUSTNO" in have:
        have.setdefault("COMPID", "customer_level")
    return enriched.select(*[
        F.col(have[c.upper()]).alias(c) if c.upper() in have else F.lit(None).cast("string").alias(c)
        for c in columns
    ])


def segment_rules(spark: SparkSession, rules: Sequence[SegmentRule]) -> DataFrame:
    def ints(xs):
        return F.array(*[F.lit(int(x)) for x in xs]).cast("array<int>")

    return literal_rows(spark, [
        F.struct(F.lit(r.segment).alias("segment"), F.lit(float(r.min_sales)).alias("min_sales"),
                 F.lit(int(r.region)).cast("int").alias("region"), ints(r.districts).alias("districts"),
                 ints(r.categories).alias("categories"))
        for r in rules])


def campaign_segments(enriched: DataFrame, rules: DataFrame | Sequence[SegmentRule],
                      columns: Sequence[str] = CAMPAIGN_COLUMNS) -> DataFrame:
    """Predicted churners matching a segment rule: sales strictly above the
    rule's level, its region, a listed district and category (empty list =
    any).  Output: ``segment`` + the campaign columns.  A customer matching
    several rules appears once per rule."""
    if not isinstance(rules, DataFrame):
        rules = segment_rules(enriched.sparkSession, rules)
    view = campaign_view(enriched, columns).where(F.col("prediction") == 1.0)
    r = rules.withColumnRenamed("region", "_region")
    j = view.join(r, view["REGION"] == r["_region"], "inner")

    def listed(arr: str, value: str):
        return (F.size(F.col(arr)) == 0) | F.array_contains(F.col(arr), F.col(value))

    j = j.where((F.col("total_sales") > F.col("min_sales")) & listed("districts", "DISTRICT")
                & listed("categories", "CUSTCAT"))
    return j.select("segment", *[view[c] for c in columns])


def segment_counts(segments: DataFrame, rules: DataFrame | Sequence[SegmentRule] | None = None) -> DataFrame:
    """Rows per segment (segments with no rows count 0 when rules are given)."""
    counts = segments.groupBy("segment").agg(F.count(F.lit(1)).alias("count"))
    if rules is None:
        return counts
    if not isinstance(rules, DataFrame):
        rules = segment_rules(segments.sparkSession, rules)
    return rules.select("segment").join(counts, "segment", "left").select(
        "segment", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def top_churners(enriched: DataFrame, n: int | None = None) -> DataFrame:
    """Predicted churners, largest trailing-year sales first (key breaks
    ties).  With ``n`` Spark plans a top-k (TakeOrderedAndProject)."""
    out = enriched.where(F.col("prediction") == 1.0).orderBy(
        F.col("total_sales").desc(), F.col("customer_level").asc())
    return out.limit(n) if n is not None else out


def drilldown(frame: DataFrame, customer: DataFrame | object) -> DataFrame:
    """Rows of one entity or several.  ``customer`` is a key value, or a frame
    with ``customer_level`` (a semi join keeps it in the plan)."""
    if isinstance(customer, DataFrame):
        return frame.join(customer.select("customer_level"), "customer_level", "left_semi")
    return frame.where(F.col("customer_level") == F.lit(customer))


def largest_churner(enriched: DataFrame) -> DataFrame:
    """One-row frame: the predicted churner with the largest sales."""
    return top_churners(enriched, 1).select("customer_level")


def audit_columns(frame: DataFrame) -> list[str]:
    """The audit's columns of a feature frame: all its months and weeks."""
    buckets = [c for c in frame.columns if c.startswith(("Month_", "Week_"))]
    return ["loop_day", "customer_level", *buckets, "feature_days_customer", "UNIQUE_TRANSREFNO_ACTIVE", "total_sales"]


def prediction_audit(frame: DataFrame, preds: DataFrame | None = None) -> DataFrame:
    """Feature columns next to each customer's prediction.

    With ``preds``: a left join of the frame's audit columns with the
    predictions (any source), at company level by the ``CUSTNO`` that both
    carry.  Without: ``frame`` already carries ``prediction``
    (``score``/``rule_score`` with ``keep=audit_columns(frame)``), so the
    feature plan runs once.
    """
    cols = audit_columns(frame)
    if "target_churn" in frame.columns:
        cols.append("target_churn")
    if preds is None:
        return frame.select(*cols, "prediction")
    keys = ["loop_day", "customer_level", *(["CUSTNO"] if "CUSTNO" in preds.columns else [])]
    return frame.select(*dict.fromkeys([*keys, *cols])).join(preds.select(*keys, "prediction"), keys, "left")
