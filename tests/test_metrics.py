"""Metrics against direct Python definitions."""

from __future__ import annotations

import random

import pytest

from churnscope.operators import metrics as M


def _preds(spark, rows):
    return spark.createDataFrame(rows, "loop_day int, customer_level long, total_sales double, "
                                       "indexedLabel double, prediction double")


def _python_dynamics(rows, days):
    seen: set = set()
    out = {}
    for d in days:
        today = {c for (ld, c, _s, _l, p) in rows if ld == d and p == 1.0}
        newly = len(today - seen)
        fallen = len(seen - today)
        seen |= today
        out[d] = (len(today), newly, fallen, len(seen))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_set_dynamics_closed_form_equals_sets(spark, seed):
    rnd = random.Random(seed)
    days = [1, 2, 3, 4, 5]
    rows = [(d, c, 1.0, float(rnd.random() < 0.3), float(rnd.random() < 0.4))
            for d in days for c in range(40) if rnd.random() < 0.8]
    want = _python_dynamics(rows, days)
    df = _preds(spark, rows)
    days_df = spark.createDataFrame([(d,) for d in days], "loop_day int")
    got = {r.loop_day: (r.predicted, r.newly_classified, r.fallen_out, r.total_classified)
           for r in M.set_dynamics(df, days_df).collect()}
    assert got == want


def test_day_without_flags_and_missing_confusion_cells(spark):
    rows = [(1, 1, 5.0, 1.0, 1.0), (1, 2, 5.0, 0.0, 0.0), (2, 1, 5.0, 0.0, 0.0)]
    df = _preds(spark, rows)
    days = spark.createDataFrame([(1,), (2,), (3,)], "loop_day int")
    m = {r.loop_day: r for r in M.backtest_metrics(df, days).collect()}
    assert m[1].recall == 1.0 and m[1].precision == 1.0 and m[1].accuracy == 1.0
    # Day 2: nobody flagged: precision and recall undefined, customer 1 fell out.
    assert m[2].precision is None and m[2].recall is None and m[2].fallen_out == 1
    # Day 3: no rows at all, still reported.
    assert m[3].total_companies == 0 and m[3].accuracy is None and m[3].total_classified == 1
    wide = {r.loop_day: r for r in M.confusion_wide(df).collect()}
    assert (wide[2].true_positives, wide[2].false_positive, wide[2].true_negative) == (0, 0, 1)


def test_precision_by_cutoff_matches_python(spark):
    rnd = random.Random(7)
    rows = [(1, c, float(rnd.choice([0, 500, 1000, 1000.5, 7000, 60000, 600000])), float(rnd.random() < 0.5),
             float(rnd.random() < 0.6)) for c in range(200)]
    rows += [(2, c, 1e9, 1.0, 1.0) for c in range(5)]  # another day is ignored
    got = {r.cutoff: (r.predicted, r.correct, r.precision) for r in M.precision_by_cutoff(_preds(spark, rows)).collect()}
    for cut in (0, 1000, 5000, 10000, 15000, 20000, 50000, 150000, 500000):
        sel = [r for r in rows if r[0] == 1 and r[4] == 1.0 and r[2] > cut]
        n, k = len(sel), sum(r[3] for r in sel)
        p = k / n if n else None
        assert got[float(cut)] == (n, k, p)


def test_many_cutoffs(spark):
    rnd = random.Random(8)
    cuts = [rnd.randrange(-50, 4000) / 4 for _ in range(10_000)]
    rows = [(1, c, rnd.choice([rnd.choice(cuts), rnd.random() * 1200, -99.0, 1e9, None]), float(rnd.random() < 0.5), 1.0) for c in range(500)]
    got = sorted(map(tuple, M.precision_by_cutoff(_preds(spark, rows), cutoffs=cuts).collect()), key=str)
    want = []
    for cut in cuts:
        sel = [r[3] for r in rows if r[2] is not None and r[2] > cut]
        want.append((cut, len(sel), sum(sel), sum(sel) / len(sel) if sel else None))
    assert got == sorted(want, key=str)
    one = M.precision_by_cutoff(_preds(spark, rows[:0]), cutoffs=[5, 5]).collect()
    assert [tuple(r) for r in one] == [(5.0, 0, 0.0, None)] * 2
