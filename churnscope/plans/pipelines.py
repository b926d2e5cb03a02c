"""End-to-end runs: evaluation (fit, backtest, metrics) and current
prediction (fit on the last labelled year, score as of the next day).

Actions happen where a model is fitted, for the newest posting date (one
scalar job), and — with ``checkpoint=True`` — where the frames that several
outputs read (predictions; training and scoring frames) are written once to
the shared checkpoint folder, so metrics, call lists, audits and drift checks
do not each re-run the ledger plan.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from churnscope.config import BACKTEST_PERIODS, CHURN_DAYS, EVALUATION_GBT, PRODUCTION_GBT
from churnscope.operators import asof as A
from churnscope.operators.features import feature_frame, level_column
from churnscope.operators.metrics import backtest_metrics
from churnscope.operators.model import classifier_pipeline, fit, rule_score, score
from churnscope.session import materialize
from churnscope.sources.register import normalise_register


@dataclass
class Evaluation:
    model: PipelineModel | None
    training: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    backtest: A.AsOf


@dataclass
class CurrentPrediction:
    model: PipelineModel | None
    training: DataFrame
    scoring: DataFrame
    predictions: DataFrame
    training_days: A.AsOf
    scoring_days: A.AsOf


def _prediction(model: PipelineModel | None, frame: DataFrame, level: str) -> DataFrame:
    """Scores; at company level with the CUSTNO of their register row."""
    keep = () if level_column(level) == "CUSTNO" else ("CUSTNO",)
    return rule_score(frame, keep=keep) if model is None else score(model, frame, keep=keep)


def backtest(model: PipelineModel | None, ledger: DataFrame, register: DataFrame, days: A.AsOf,
             level: str = "custno", latest: dt.date | None = None) -> DataFrame:
    """Score every backtest day in one plan (``model=None``: rule score).
    With ``latest`` the predictions carry ``label_mature``."""
    frame = feature_frame(ledger, normalise_register(register), days, level, with_label=True, latest=latest)
    return _prediction(model, frame, level)


def evaluate(ledger: DataFrame, register: DataFrame, training_end: dt.date,
             periods: int = BACKTEST_PERIODS, level: str = "custno",
             gbt_params: dict | None = None, use_model: bool = True,
             checkpoint: bool = True, model: PipelineModel | None = None,
             windows: A.Windows | None = None, latest: dt.date | None = None) -> Evaluation:
    """Fit on ``training_end`` (or use the given fitted ``model``), score the
    backtest days in one plan, compute the metrics.

    ``windows`` sets all window lengths, the definition of churn in days
    included.  With ``latest`` (newest posting) only rows whose whole target
    window lies within the data enter the metrics.
    """
    spark = ledger.sparkSession
    register = normalise_register(register)
    train_days = A.training_day(spark, training_end, windows=windows)
    training = feature_frame(ledger, register, train_days, level, with_label=True)
    if use_model and model is None:
        model = fit(classifier_pipeline(gbt_params or EVALUATION_GBT), training)
    elif not use_model:
        model = None
    days = A.backtest_days(spark, training_end, periods, windows=windows)
    preds = backtest(model, ledger, register, days, level, latest)
    if checkpoint:
        preds = materialize(preds)
    metrics = backtest_metrics(preds, days.frame.select("loop_day"), mature_only=latest is not None)
    return Evaluation(model, training, preds, metrics, days)


def predict_current(ledger: DataFrame, register: DataFrame, level: str = "custno",
                    gbt_params: dict | None = None, latest: dt.date | None = None,
                    use_model: bool = True, checkpoint: bool = True,
                    model: PipelineModel | None = None, churn_days: int = CHURN_DAYS) -> CurrentPrediction:
    """Fit on the last complete label window of ``churn_days`` (or use the
    given fitted ``model``) and score as of the day after the newest posting.

    ``latest`` is looked up in the whole ledger if it is not given.
    """
    spark = ledger.sparkSession
    register = normalise_register(register)
    latest = latest or A.latest_posting_date(ledger)
    train_days, score_days = A.prediction_days(spark, latest, churn_days)
    training = feature_frame(ledger, register, train_days, level, with_label=True)
    scoring = feature_frame(ledger, register, score_days, level, with_label=False)
    if checkpoint:
        training, scoring = materialize(training), materialize(scoring)
    if use_model and model is None:
        model = fit(classifier_pipeline(gbt_params or PRODUCTION_GBT), training)
    elif not use_model:
        model = None
    return CurrentPrediction(model, training, scoring, _prediction(model, scoring, level), train_days, score_days)
