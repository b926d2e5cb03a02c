"""The feature frame against a plain-Python brute force on random ledgers.

The brute force follows the definitions line by line (sets of transaction
references per bucket), independent of the Spark plan's bit flags."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from churnscope.operators import asof as A
from churnscope.operators import features as FE

BASE = dt.date(2000, 3, 15)


def _random_case(seed: int):
    rnd = random.Random(seed)
    n_cust = rnd.randint(3, 12)
    reg = []
    for c in range(1, n_cust + 1):
        cre = BASE - dt.timedelta(days=rnd.randint(-20, 900))
        kill = None if rnd.random() < 0.6 else BASE + dt.timedelta(days=rnd.randint(-60, 400))
        reg.append((c, c % 4, cre, kill, rnd.choice("ABC"), rnd.randint(0, 2)))
    led = []
    for _ in range(rnd.randint(20, 120)):
        c = rnd.randint(1, n_cust + 2)           # some lines belong to nobody in the register
        d = BASE + dt.timedelta(days=rnd.randint(-420, 420))
        t = None if rnd.random() < 0.1 else rnd.randint(1, 40)   # shared and missing references
        led.append((c, d, t, Decimal(rnd.randint(1, 10000)) / 100))
    ends = sorted({BASE + dt.timedelta(days=rnd.randint(-30, 30)) for _ in range(rnd.randint(1, 4))})
    return reg, led, ends


def _brute(reg, led, ends, level):
    comp = {c: k for c, k, *_ in reg}
    out = set()
    for day, e in enumerate(ends):
        per = {}
        for c, d, t, s in led:
            ent = c if level == "custno" else comp.get(c)
            if ent is None:
                continue
            p = per.setdefault(ent, {"m": [set() for _ in range(12)], "w": [set() for _ in range(6)],
                                     "act": set(), "tgt": set(), "any_tgt": False, "sales": Decimal(0),
                                     "year": False})
            age = (e - d).days
            if 0 <= age <= 364:
                p["year"] = True
                p["sales"] += s
                if t is not None:
                    p["m"][(e.month - d.month) % 12].add(t)
                    if age <= 41:
                        p["w"][age // 7].add(t)
                    if age <= 90:
                        p["act"].add(t)
            if 1 <= -age <= 365:
                p["any_tgt"] = True
                if t is not None:
                    p["tgt"].add(t)
        for c, k, cre, kill, cls, region in reg:
            ent = c if level == "custno" else k
            p = per.get(ent)
            if p is None or not p["act"] or cre > e or (kill is not None and kill <= e):
                continue
            out.add((day, ent, c, *[len(x) for x in p["m"]], *[len(x) for x in p["w"]],
                     float(p["sales"]), len(p["act"]), len(p["tgt"]) if p["any_tgt"] else None,
                     0 if p["any_tgt"] else 1, (e - cre).days + 1))
    return out


@pytest.mark.parametrize("seed,level", [(1, "custno"), (2, "custno"), (3, "compid"), (4, "custno"),
                                        (5, "compid"), (6, "custno")])
def test_feature_frame_equals_brute_force(spark, seed, level):
    reg, led, ends = _random_case(seed)
    reg_df = spark.createDataFrame(reg, "CUSTNO long, COMPID long, CREDATE date, KILLDATE date, "
                                        "CUSTCLASS string, REGION int")
    led_df = spark.createDataFrame(led, "CUSTNO long, POSTDATE date, TRANSREFNO long, SALES decimal(18,2)")
    days = A.asof_days(spark, ends)
    ff = FE.feature_frame(led_df, reg_df, days, level=level)
    cols = ["loop_day", "customer_level", "CUSTNO", *[f"Month_{k}" for k in range(12)],
            *[f"Week_{j}" for j in range(1, 7)], "total_sales", "UNIQUE_TRANSREFNO_ACTIVE",
            "UNIQUE_TRANSREFNO_TARGET", "target_churn", "feature_days_customer"]
    got = {tuple(r) for r in ff.select(*cols).collect()}
    assert got == _brute(reg, led, ends, level)
    # The direct distinct-count strategy agrees too.
    alt = FE.feature_frame(led_df, reg_df, days, level=level, strategy="distinct")
    assert {tuple(r) for r in alt.select(*cols).collect()} == got
    assert ff.where(F.col("UNIQUE_TRANSREFNO_ACTIVE") <= 0).count() == 0
