"""Population checks between the training and the scoring frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.session import materialize


def class_balance(preds: DataFrame, training: DataFrame) -> DataFrame:
    """Row counts by predicted class and by true label."""
    a = preds.groupBy(F.col("prediction").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    b = training.groupBy(F.col("target_churn").cast("double").alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    return (a.select(F.lit("predictions").alias("frame"), F.lit("prediction").alias("source_column"),
                     "value", "count")
            .unionByName(b.select(F.lit("training").alias("frame"), F.lit("target_churn").alias("source_column"),
                                  "value", "count")))


def population_shift(training: DataFrame, scoring: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts and shares per value of ``by`` in both frames.

    One union + one aggregation (pivot on two fixed values, no discovery
    job); shares divide by a one-row total joined back by broadcast, so any
    cardinality of ``by`` stays distributed.
    """
    tagged = (training.select(*by, F.lit("train").alias("dataset"))
              .unionByName(scoring.select(*by, F.lit("pred").alias("dataset"))))
    counts = tagged.groupBy(*by).agg(
        F.sum(F.when(F.col("dataset") == "train", 1).otherwise(0)).cast("long").alias("train_count"),
        F.sum(F.when(F.col("dataset") == "pred", 1).otherwise(0)).cast("long").alias("pred_count"),
    )
    totals = counts.agg(F.sum("train_count").alias("train_total"), F.sum("pred_count").alias("pred_total"))
    # Equi-join on a constant key with the one-row total (broadcast).
    one = F.lit(1).alias("_one")
    j = counts.select("*", one).join(F.broadcast(totals.select("*", one)), "_one")
    return j.select(
        *by, "train_count", "pred_count",
        F.try_divide(F.col("train_count").cast("double"), F.col("train_total").cast("double")).alias("train_share"),
        F.try_divide(F.col("pred_count").cast("double"), F.col("pred_total").cast("double")).alias("pred_share"),
    )


def class_index_counts(training: DataFrame, scoring: DataFrame, column: str = "CUSTCLASS",
                       indexer: PipelineModel | None = None) -> DataFrame:
    """Counts per (dataset, value, index) with the index fitted on training:
    the same value must get the same index in both frames; null values and
    values that training lacks share the index after the last.

    Each frame is read once: values are counted first, and the index is
    fitted on and applied to the counts."""
    out_col = f"{column}_index"
    counts = materialize(
        training.select(F.lit("train").alias("dataset"), column)
        .unionByName(scoring.select(F.lit("pred").alias("dataset"), column))
        .groupBy("dataset", column).agg(F.count(F.lit(1)).alias("count")))
    if indexer is None:
        indexer = StringIndexer(inputCol=column, outputCol=out_col, stringOrderType="alphabetDesc",
                                handleInvalid="keep").fit(counts.where("dataset = 'train'"))
    return indexer.transform(counts).select("dataset", column, out_col, "count")


def category_index(training: DataFrame, columns: Sequence[str] = ("CUSTCLASS", "REGION")) -> DataFrame:
    """The fitted index of every category value in ``training``:
    (input_column, value, label_index).  Null is no value and has no row.

    One pass over ``training``; the fitted labels, one per distinct value,
    are held by the driver, as in any string indexer."""
    values = materialize(training.select(*columns).distinct())
    model = StringIndexer(inputCols=list(columns), outputCols=[f"{c}_index" for c in columns],
                          stringOrderType="alphabetDesc", handleInvalid="keep").fit(values)
    rows = [(c, value, float(k)) for c, labels in zip(columns, model.labelsArray, strict=True) for k, value in enumerate(labels)]
    return training.sparkSession.createDataFrame(rows, "input_column string, value string, label_index double")
