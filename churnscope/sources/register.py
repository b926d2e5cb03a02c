"""Customer-register sources.

The register is a dated snapshot folder; one snapshot serves every as-of day
(so categorical columns are today's values).  Pass another snapshot, or several
with the days they were taken, to score history with the attributes it had then.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTER_KEY_COLUMNS = ("CUSTNO", "COMPID")
REGISTER_DATE_COLUMNS = ("CREDATE", "KILLDATE")
# First day and first day no longer of a dated snapshot's rows.
VALIDITY_COLUMNS = ("VALID_FROM", "VALID_TO")


def read_register_snapshot(spark: SparkSession, base: str, snapshot: str,
                           fmt: str = "parquet") -> DataFrame:
    """Read ``{base}/{snapshot}`` (e.g. ``.../2022/24``)."""
    return spark.read.format(fmt).load(f"{base.rstrip('/')}/{snapshot}")


def dated_register(snapshots: Mapping[dt.date, DataFrame]) -> DataFrame:
    """Whole snapshots by the day each was taken, as one register whose rows
    hold from that day until the next snapshot (``VALID_FROM``, ``VALID_TO``).

    Days before the first snapshot read the first.  The feature frame and the
    live customers take, for every as-of day, the rows that hold on its feature
    end, by two more conditions of the live test; customers alone, since a
    company would need its members as of each posting date.
    """
    if not snapshots:
        raise ValueError("a dated register needs a snapshot")
    days = sorted(snapshots)
    starts = ["0001-01-01", *(day.isoformat() for day in days[1:])]
    ends = [*starts[1:], "9999-12-31"]
    parts = [snapshots[day].withColumns({"VALID_FROM": F.to_date(F.lit(start)), "VALID_TO": F.to_date(F.lit(end))})
             for day, start, end in zip(days, starts, ends, strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_register_snapshots(spark: SparkSession, base: str, snapshots: Mapping[str, dt.date],
                            fmt: str = "parquet") -> DataFrame:
    """Read the folders ``snapshots`` (name -> day taken) of ``base`` as a :func:`dated_register`."""
    if len(set(snapshots.values())) < len(snapshots):
        raise ValueError("two register snapshots of one day")
    return dated_register({day: normalise_register(read_register_snapshot(spark, base, name, fmt))
                           for name, day in snapshots.items()})


def normalise_register(df: DataFrame) -> DataFrame:
    """Fixed types on the columns the operators read; others pass through."""
    casts = {
        "CUSTNO": "long", "COMPID": "long", "CREDATE": "date", "KILLDATE": "date",
        "REGION": "int", "DISTRICT": "int", "CUSTCAT": "int",
    }
    return df.select(*[
        F.col(c).cast(casts[c.upper()]).alias(c) if c.upper() in casts else F.col(c)
        for c in df.columns
    ])


def duplicate_keys(register: DataFrame, key: str = "CUSTNO") -> DataFrame:
    """Keys that occur more than once: which ones they are, where
    :func:`unique_keys` has failed a query for the first it met."""
    return register.groupBy(key).count().where(F.col("count") > 1)


def unique_keys(register: DataFrame, value: str, key: str = "CUSTNO") -> DataFrame:
    """``key`` and ``value`` of every register row, one row a key.

    A key that occurs twice fails the query that reads its value, inside the
    plan: no job of its own, and the aggregate's exchange serves the join on
    the key.  Null keys meet nothing and are left out.
    """
    known = register.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.first(value).alias("_value"))
    message = F.concat(F.lit(f"register holds {key} "), F.col(key).cast("string"), F.lit(" more than once"))
    one = F.when(F.col("_n") == 1, F.col("_value")).otherwise(F.raise_error(message).cast(register.schema[value].dataType))
    return known.select(key, one.alias(value))
