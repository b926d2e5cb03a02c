"""Model inputs, gradient-boosted trees, scoring and a deterministic rule score.

The encoders and the classifier are stages of one ``Pipeline`` fitted on the
training frame, so a scoring frame is always encoded with the training
vocabulary:

* ``StringIndexer`` (labels in descending text order; unseen or null values
  keep an extra index),
* ``OneHotEncoder`` (last index dropped, so an unseen value is all zeros and
  the width equals the number of training labels),
* ``VectorAssembler`` of the two encoded vectors, ``Month_1..11``,
  ``Week_1..6`` and ``feature_days_customer`` (``Month_0`` and
  ``total_sales`` are not inputs),
* ``GBTClassifier`` on ``indexedLabel`` (= ``target_churn`` as double).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from churnscope.config import CATEGORICAL_INPUTS, EVALUATION_GBT, NUMERIC_INPUTS, WEEK_COLUMNS
from churnscope.session import materialize

LABEL = "indexedLabel"


# How the trees are grown, not which: node ids kept with the rows instead of walking the trees at every level, and room
# for the statistics of a whole level of deep trees in one pass.
FIT_SETTINGS = {"cacheNodeIds": True, "checkpointInterval": 10, "maxMemoryInMB": 1024}


def with_label(frame: DataFrame) -> DataFrame:
    """Add ``indexedLabel``: churn = 1.0."""
    return frame.withColumn(LABEL, F.col("target_churn").cast("double"))


def encoder_stages(categorical: Sequence[str] = CATEGORICAL_INPUTS,
                   numeric: Sequence[str] = NUMERIC_INPUTS) -> list:
    idx = [f"{c}_index" for c in categorical]
    vec = [f"{c}_vector" for c in categorical]
    return [
        StringIndexer(inputCols=list(categorical), outputCols=idx,
                      stringOrderType="alphabetDesc", handleInvalid="keep"),
        OneHotEncoder(inputCols=idx, outputCols=vec, dropLast=True),
        VectorAssembler(inputCols=vec + list(numeric), outputCol="features"),
    ]


def encoder(categorical: Sequence[str] = CATEGORICAL_INPUTS,
            numeric: Sequence[str] = NUMERIC_INPUTS) -> Pipeline:
    """Index + one-hot + assemble, without a classifier."""
    return Pipeline(stages=encoder_stages(categorical, numeric))


def numeric_inputs(frame: DataFrame) -> list[str]:
    """The numeric inputs of a feature frame with any number of weeks."""
    months = [c for c in NUMERIC_INPUTS if c.startswith("Month_")]
    weeks = sorted((c for c in frame.columns if c.startswith("Week_")), key=lambda c: int(c[5:]))
    return [*months, *weeks, "feature_days_customer"]


def classifier_pipeline(params: dict | None = None,
                        categorical: Sequence[str] = CATEGORICAL_INPUTS,
                        numeric: Sequence[str] = NUMERIC_INPUTS) -> Pipeline:
    p = FIT_SETTINGS | dict(EVALUATION_GBT if params is None else params)
    gbt = GBTClassifier(labelCol=LABEL, featuresCol="features", **p)
    return Pipeline(stages=[*encoder_stages(categorical, numeric), gbt])


# Rows of one fit partition, beyond the session's default parallelism.
ROWS_PER_FIT_PARTITION = 100_000


def fit(pipeline: Pipeline, training: DataFrame) -> PipelineModel:
    """Fit on the labelled frame.

    The frame is checkpointed, dealt by entity to the session's default
    parallelism (more partitions where they would exceed
    ``ROWS_PER_FIT_PARTITION`` rows), and persisted for the boosting passes
    (spilling to disk, read again from the checkpoint if an executor is lost);
    it is released afterwards.
    """
    train = with_label(training) if LABEL not in training.columns else training
    train = materialize(train)
    parts = max(train.sparkSession.sparkContext.defaultParallelism, -(-train.count() // ROWS_PER_FIT_PARTITION))
    dealt = train.repartition(parts, "loop_day", "customer_level").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return pipeline.fit(dealt)
    finally:
        dealt.unpersist()


def score(model: PipelineModel, frame: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Predictions: ``loop_day, customer_level, total_sales, [indexedLabel],
    prediction, probability_churn`` plus ``keep`` columns."""
    if "target_churn" in frame.columns and LABEL not in frame.columns:
        frame = with_label(frame)
    out = model.transform(frame)
    label = [LABEL] if LABEL in out.columns else []
    keep = [*keep, *(["label_mature"] if "label_mature" in out.columns else [])]
    extra = [c for c in keep if c not in ("loop_day", "customer_level", "total_sales", LABEL, "prediction")]
    return out.select(
        "loop_day", "customer_level", "total_sales", *label, "prediction",
        vector_to_array("probability")[1].alias("probability_churn"), *extra,
    )


def model_inputs(model: PipelineModel | Pipeline, frame: DataFrame, keep_all: bool = False) -> DataFrame:
    """Encoded frame with ``features`` as an array (for inspection/export).

    ``keep_all``: every column of ``frame``, the index and one-hot columns
    (vectors as arrays) and ``features``; otherwise the keys and the label.
    """
    stages = model.stages[:3] if isinstance(model, PipelineModel) else None
    enc = PipelineModel(stages) if stages is not None else model.fit(frame)
    out = enc.transform(frame)
    if keep_all:
        vectors = [c for c in out.columns if c == "features" or c.endswith("_vector")]
        return out.withColumns({c: vector_to_array(c) for c in vectors})
    label = [LABEL] if LABEL in out.columns else (["target_churn"] if "target_churn" in out.columns else [])
    return out.select("loop_day", "customer_level", "total_sales", *label,
                      vector_to_array("features").alias("features"))


def model_input_entries(model: PipelineModel | Pipeline, frame: DataFrame) -> DataFrame:
    """The encoded input matrix in coordinate form: one row per non-zero
    slot (``loop_day, customer_level, slot, value``).  Slots are the two
    one-hot blocks, then ``Month_1..11``, ``Week_1..6`` and
    ``feature_days_customer``."""
    stages = model.stages[:3] if isinstance(model, PipelineModel) else None
    enc = PipelineModel(stages) if stages is not None else model.fit(frame)
    out = enc.transform(frame).select(
        "loop_day", "customer_level", F.posexplode(vector_to_array("features")).alias("slot", "value"))
    return out.where(F.col("value") != 0.0)


def feature_importance(model: PipelineModel, frame: DataFrame) -> DataFrame:
    """Importance of every assembled input slot, named from the vector's
    attribute metadata (e.g. ``CUSTCLASS_vector_BUILDING``, ``Week_1``)."""
    gbt = model.stages[-1]
    assembled = PipelineModel(model.stages[:3]).transform(frame.limit(0))
    meta = assembled.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {}
    for group in meta.values():
        for a in group:
            names[a["idx"]] = a["name"]
    imp = gbt.featureImportances.toArray().tolist()
    rows = [(i, names.get(i, f"slot_{i}"), float(v)) for i, v in enumerate(imp)]
    spark = frame.sparkSession
    return spark.createDataFrame(rows, "slot int, feature string, importance double")


def rule_score(frame: DataFrame, weeks: Sequence[str] = WEEK_COLUMNS, max_active: int = 1,
               keep: Sequence[str] = ()) -> DataFrame:
    """Deterministic stand-in for the model: churn when no purchase in any of
    the last weeks and at most ``max_active`` transactions in the active
    window.  Same output shape as ``score`` (plus ``keep`` columns)."""
    quiet = F.lit(True)
    for w in weeks:
        quiet = quiet & (F.col(w) == 0)
    pred = F.when(quiet & (F.col("UNIQUE_TRANSREFNO_ACTIVE") <= max_active), F.lit(1.0)).otherwise(F.lit(0.0))
    label = [F.col("target_churn").cast("double").alias(LABEL)] if "target_churn" in frame.columns else []
    keep = [*keep, *(["label_mature"] if "label_mature" in frame.columns else [])]
    extra = [c for c in keep if c not in ("loop_day", "customer_level", "total_sales")]
    return frame.select("loop_day", "customer_level", "total_sales", *label, pred.alias("prediction"), *extra)
