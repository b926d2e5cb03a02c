"""End-to-end pipelines on the smallest tables (rule score, both levels)."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from churnscope.config import fixture_segments
from churnscope.operators import campaign as C
from churnscope.operators import drift as D
from churnscope.plans import pipelines as P


@pytest.mark.parametrize("level,key", [("custno", "CUSTNO"), ("compid", "COMPID")])
def test_current_prediction_to_call_lists(spark, small, level, key):
    led, reg = small
    cur = P.predict_current(led, reg, level=level, use_model=False, checkpoint=True)
    assert cur.predictions.count() == cur.scoring.count() > 0
    enriched = C.enrich_predictions(cur.predictions, reg, level=level)
    # The entity key became customer_level; every row found its register row.
    assert key not in enriched.columns
    assert enriched.where(F.col("NAME1").isNull()).count() == 0
    seg = C.campaign_segments(enriched, fixture_segments())
    counts = {r.segment: r["count"] for r in C.segment_counts(seg, fixture_segments()).collect()}
    assert set(counts) == {"a", "b", "c"} and sum(counts.values()) == seg.count()
    shift = D.population_shift(cur.training, cur.scoring, ["REGION"]).collect()
    assert sum(r.train_count for r in shift) == cur.training.count()
    assert abs(sum(r.pred_share for r in shift) - 1.0) < 1e-9


def test_backtest_metrics_cover_every_day(spark, small):
    led, reg = small
    ev = P.evaluate(led, reg, dt.date(1999, 6, 30), use_model=False, checkpoint=False)
    rows = ev.metrics.collect()
    assert sorted(r.loop_day for r in rows) == [1, 2, 3, 4]
    assert all(r.total_classified >= r.newly_classified for r in rows)


def test_metrics_of_a_fitted_run_from_its_own_predictions(spark, small):
    led, reg = small
    ev = P.evaluate(led, reg, dt.date(1999, 6, 30), gbt_params={"maxIter": 3, "maxDepth": 3, "seed": 42})
    by_day: dict[int, list] = {}
    for r in ev.predictions.collect():
        by_day.setdefault(r.loop_day, []).append((r.customer_level, r.prediction == 1.0, r.indexedLabel == 1.0))
    got = {r.loop_day: r for r in ev.metrics.collect()}
    assert set(got) == set(by_day) == {1, 2, 3, 4}
    before: set = set()
    for day in sorted(by_day):
        rows = by_day[day]
        hit, called, churned = (sum(f(p, y) for _, p, y in rows) for f in
                                (lambda p, y: p and y, lambda p, y: p, lambda p, y: y))
        right = sum(p == y for _, p, y in rows)
        want = {"recall": hit / churned if churned else None, "precision": hit / called if called else None, "accuracy": right / len(rows)}
        for name, value in want.items():
            assert got[day][name] == (None if value is None else pytest.approx(value)), (day, name)
        flagged = {c for c, p, _ in rows if p}
        assert got[day].total_companies == len(rows) and got[day].total_classified == len(flagged | before)
        assert got[day].newly_classified == len(flagged - before)
        assert got[day].fallen_out == len(before - flagged)
        before |= flagged
