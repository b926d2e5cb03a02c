"""Ledger extracts, hand-over and the CSV sink."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.operators import asof as A
from churnscope.operators import features as FE
from churnscope.session import fresh_path
from churnscope.sources import fixtures as X
from churnscope.sources import dated_register, ledger_from_extracts, ledger_from_tagged, qualify, read_call_lists, union_extracts, write_call_lists
from tests.conftest import SF_SMALL


def test_union_with_handover_equals_qualified_ledger(spark):
    led = X.ledger(spark, SF_SMALL)
    assert led.count() == 3247
    assert led.exceptAll(qualify(X.raw_ledger(spark, SF_SMALL)).select(*led.columns)).count() == 0


def test_without_handover_the_overlap_is_counted_twice(spark):
    parts = [qualify(r) for r in X.raw_extracts(spark, SF_SMALL)]
    assert union_extracts(parts).count() == 3718


def test_postdate_is_a_date_even_from_timestamps(spark):
    raw = X.raw_ledger(spark, SF_SMALL).withColumn("POSTDATE", F.to_timestamp("POSTDATE"))
    led = union_extracts([qualify(raw)])
    assert isinstance(led.schema["POSTDATE"].dataType, T.DateType)


def test_csv_is_latin1_with_semicolons(spark):
    df = spark.createDataFrame([("a", "Åsa;Ørjan", 1.5), ("b", "日本", 2.0)],
                               "segment string, NAME1 string, total_sales double")
    path = fresh_path(spark, "csv-test")
    write_call_lists(df, path, partition_by=None, single_file=True)
    files = [f for f in __import__("os").listdir(path) if f.endswith(".csv")]
    assert len(files) == 1
    raw = open(f"{path}/{files[0]}", "rb").read()
    assert raw.startswith(b"segment;NAME1;total_sales")
    assert "Åsa".encode("latin-1") in raw and b"??" in raw
    back = read_call_lists(spark, path, df.schema)
    assert sorted(r.NAME1 for r in back.collect()) == ["??", "Åsa;Ørjan"]


def test_delta_without_connector_explains_itself(spark, tmp_path):
    import pytest

    from churnscope.sources import read_extract

    p = str(tmp_path / "d")
    spark.range(1).write.parquet(p)
    with pytest.raises(Exception) as info:
        read_extract(spark, p, fmt="delta").count()
    assert "delta" in str(info.value).lower()


def test_every_day_reads_the_snapshot_it_holds(spark, small):
    led, reg = small
    taken = [dt.date(2000, 6, 1), dt.date(2000, 7, 2)]
    days = A.backtest_days(spark, X.TRAINING_END)
    ends = {r.loop_day: r.feature_end for r in days.frame.collect()}
    dated = dated_register({day: reg.withColumn("REGION", F.lit(k)) for k, day in enumerate(taken)})
    frame = FE.feature_frame(led, dated, days)
    assert frame.columns == FE.feature_frame(led, reg, days).columns
    held = {r.loop_day: r.regions for r in frame.groupBy("loop_day").agg(F.collect_set("REGION").alias("regions")).collect()}
    assert held == {day: [int(end >= taken[1])] for day, end in ends.items()} and len({tuple(v) for v in held.values()}) == 2
    plain = FE.feature_frame(led, reg, days)
    assert frame.drop("REGION").exceptAll(plain.drop("REGION")).count() == 0 and frame.count() == plain.count()
    live = FE.live_customers(dated, days)
    assert live.count() == FE.live_customers(reg, days).count() and live.columns == FE.live_customers(reg, days).columns
    # a single day before all snapshots reads the first
    early = A.training_day(spark, X.TRAINING_END)
    assert {r.REGION for r in FE.feature_frame(led, dated, early).collect()} == {0}
    assert {r.REGION for r in FE.live_customers(dated, early).collect()} == {0}
    with pytest.raises(ValueError, match="customer level"):
        FE.feature_frame(led, dated, days, "compid")
    with pytest.raises(ValueError, match="needs a snapshot"):
        dated_register({})


def test_ledger_joins_its_lines_once_and_equals_the_union_of_extracts(spark, tmp_path):
    days = [dt.datetime(*d) for d in ((1996, 12, 31), (1997, 1, 1), (1999, 7, 1), (1999, 12, 31), (2000, 1, 1), (2000, 6, 30), (2000, 7, 1))]
    orders = [(k, k % 3, day) for k, day in enumerate([*days, None], 1)] + [(2, 9, days[4]), (None, 1, days[0])]
    lines = [(k, n, 1.5 * n, flag) for k in range(1, 9) for n, flag in ((1, "A"), (1, "A"), (2, "N"), (3, "R"), (7, "A"))] + [(None, 1, 1.0, "A")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    led, apart = X.ledger(spark, str(tmp_path)), ledger_from_extracts(X.raw_extracts(spark, str(tmp_path)), X.HANDOVER)
    assert led.schema == apart.schema and sorted(map(tuple, led.collect())) == sorted(map(tuple, apart.collect())) and led.count() == 24
    assert led._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_tagged_extracts_are_cut_at_their_own_borders(spark):
    first, second = dt.date(2020, 1, 1), dt.date(2020, 2, 1)
    rows = [(k, day, 5, "10", 61, tag) for tag in (0, 1, 2, 3) for k, day in enumerate((dt.date(2019, 12, 31), first, dt.date(2020, 1, 31), second, None))]
    raw = spark.createDataFrame(rows, "CUSTNO long, POSTDATE date, TRANSREFNO long, COMPNO string, OTYPE int, EXTRACT int").selectExpr("*", "cast(1 as decimal(18,2)) as SALES")
    for handover in ([first, second], [None, second]):
        apart = ledger_from_extracts([raw.where(f"EXTRACT = {k}") for k in range(3)], handover)
        assert sorted(map(str, ledger_from_tagged(raw, handover).collect())) == sorted(map(str, apart.collect()))
