"""Encoding and model tests (small settings; the production settings are
parameters)."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnscope.operators import asof as A
from churnscope.operators import drift as D
from churnscope.operators import features as FE
from churnscope.operators import model as MD
from churnscope.operators import trees as TR
from churnscope.sources import fixtures as X

SMALL_GBT = {"maxIter": 3, "maxDepth": 3, "seed": 42}


def _train(spark, small):
    led, reg = small
    return FE.feature_frame(led, reg, A.training_day(spark, X.TRAINING_END))


def test_vector_width_and_unseen_category(spark, small):
    train = MD.with_label(_train(spark, small))
    enc = MD.encoder().fit(train)
    out = enc.transform(train)
    n_class = train.select("CUSTCLASS").distinct().count()
    n_region = train.select("REGION").distinct().count()
    width = len(out.select(vector_to_array("features").alias("f")).first().f)
    assert width == n_class + n_region + 11 + 6 + 1
    # A value never seen in training encodes as all zeros in its block.
    unseen = train.limit(1).withColumn("CUSTCLASS", F.lit("NEVER-SEEN"))
    v = enc.transform(unseen).select(vector_to_array("CUSTCLASS_vector").alias("v")).first().v
    assert len(v) == n_class and sum(v) == 0


def test_index_is_descending_text_order(spark, small):
    idx = D.category_index(_train(spark, small), ["CUSTCLASS"]).collect()
    ordered = sorted(idx, key=lambda r: r.label_index)
    values = [r.value for r in ordered]
    assert values == sorted(values, reverse=True)


def test_fixed_seed_rerun_gives_equal_predictions(spark, small):
    led, reg = small
    train = _train(spark, small)
    days = A.backtest_days(spark, X.TRAINING_END)
    frame = FE.feature_frame(led, reg, days)
    preds = []
    for _ in range(2):
        model = MD.fit(MD.classifier_pipeline(SMALL_GBT), train)
        preds.append(sorted((r.loop_day, r.customer_level, r.prediction)
                            for r in MD.score(model, frame).collect()))
    assert preds[0] == preds[1]
    assert len(preds[0]) == frame.count()


def test_feature_importance_names_every_slot(spark, small):
    train = _train(spark, small)
    model = MD.fit(MD.classifier_pipeline(SMALL_GBT), train)
    imp = MD.feature_importance(model, train).collect()
    names = [r.feature for r in imp]
    assert "Week_1" in names and "feature_days_customer" in names
    assert abs(sum(r.importance for r in imp) - 1.0) < 1e-6


def test_prediction_windows_follow_newest_posting(spark, small):
    led, _ = small
    latest = A.latest_posting_date(led)
    train, score = A.prediction_days(spark, latest)
    t = train.frame.first()
    s = score.frame.first()
    assert t.feature_end == latest - dt.timedelta(days=365)
    assert s.feature_end == latest + dt.timedelta(days=1)
    assert t.active_start == t.feature_end - dt.timedelta(days=365)


def test_evaluation_with_checkpointed_predictions(spark, small):
    from churnscope.plans import pipelines as P

    led, reg = small
    ev = P.evaluate(led, reg, X.TRAINING_END, gbt_params=SMALL_GBT, use_model=False, checkpoint=True)
    # The checkpointed predictions no longer carry the ledger plan.
    assert "BroadcastNestedLoopJoin" not in ev.predictions._jdf.queryExecution().executedPlan().toString()
    plain = P.evaluate(led, reg, X.TRAINING_END, use_model=False, checkpoint=False)
    assert sorted(map(tuple, ev.metrics.collect())) == sorted(map(tuple, plain.metrics.collect()))


@pytest.mark.parametrize("params", [{"maxIter": 6, "maxDepth": 8, "seed": 42}, {"maxIter": 3, "maxDepth": 20, "seed": 42}])
def test_predictions_and_importances_equal_those_of_the_node_table(spark, small, params):
    led, reg = small
    train = FE.feature_frame(led, reg, A.asof_days(spark, [X.TRAINING_END - dt.timedelta(days=30 * k) for k in range(3)]))
    model = MD.fit(MD.classifier_pipeline(params), train)
    frame = FE.feature_frame(led, reg, A.backtest_days(spark, X.TRAINING_END))
    rows = TR.compared(model, frame, MD.score(model, frame)).collect()
    assert len(rows) == frame.count() and {r.prediction for r in rows} == {0.0, 1.0}
    for r in rows:
        assert r.prediction == r.prediction_by_nodes and abs(r.probability_churn - r.probability_by_nodes) < 1e-9
    nodes = TR.node_table(spark, model)
    assert TR.tree_depth(nodes) == max(t.depth for t in model.stages[-1].trees) and nodes.where("left < 0").count() > 0
    own = {r.slot: r.importance for r in TR.node_importances(nodes).collect()}
    told = {r.slot: r.importance for r in MD.feature_importance(model, train).collect()}
    assert abs(sum(own.values()) - 1) < 1e-9 and all(abs(told[k] - own.get(k, 0.0)) < 1e-9 for k in told) and set(own) <= set(told)


def test_splits_by_categories_go_by_the_listed_values(spark):
    nodes = spark.createDataFrame(
        [(0, 1.0, 0, 1, 2, 1, None, [1.0, 3.0], 2.0, 9, 0.0), (0, 1.0, 1, -1, -1, -1, None, None, -1.0, 4, 0.5),
         (0, 1.0, 2, -1, -1, -1, None, None, -1.0, 5, -0.5), (1, 0.1, 0, -1, -1, -1, None, None, -1.0, 9, 1.0)],
        "tree int, weight double, node int, left int, right int, feature int, threshold double, categories array<double>, gain double, n long, prediction double")
    rows = spark.createDataFrame([(1, [9.0, 3.0]), (2, [1.0, 2.0])], "k int, features array<double>")
    assert {r.k: round(r.margin, 9) for r in TR.evaluate_nodes(nodes, rows, ["k"]).collect()} == {1: 0.6, 2: -0.4}


def test_fit_settings_do_not_change_the_trees(spark, small):
    train = _train(spark, small)
    plain = {"cacheNodeIds": False, "maxMemoryInMB": 256}
    trees = [MD.fit(MD.classifier_pipeline({**SMALL_GBT, "maxDepth": 12, **extra}), train).stages[-1].toDebugString.split("\n", 1)[1]
             for extra in ({}, plain)]
    assert trees[0] == trees[1]


def test_trees_are_walked_without_shuffling_rows_at_every_level(spark, monkeypatch):
    nodes = spark.createDataFrame(
        [(0, 1.0, 0, 1, 2, 0, 5.0, None, 2.0, 9, 0.0), (0, 1.0, 1, -1, -1, -1, None, None, -1.0, 4, 0.5), (0, 1.0, 2, -1, -1, -1, None, None, -1.0, 5, -0.5)],
        "tree int, weight double, node int, left int, right int, feature int, threshold double, categories array<double>, gain double, n long, prediction double")
    rows = spark.createDataFrame([(1, [5.0]), (2, [6.0])], "k int, features array<double>")
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffles = []
        for limit in (TR.BROADCAST_NODES, 0):
            monkeypatch.setattr(TR, "BROADCAST_NODES", limit)
            told = TR.evaluate_nodes(nodes, rows, ["k"])
            assert {r.k: r.margin for r in told.collect()} == {1: 0.5, 2: -0.5}
            shuffles.append(told._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin"))
        assert shuffles[0] == 0 < shuffles[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
