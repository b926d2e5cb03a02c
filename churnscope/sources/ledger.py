"""Sales-ledger sources.

A ledger arrives as several overlapping yearly extracts (Parquet folders, the
newest one possibly a Delta table).  Each extract is qualified (company code,
transaction reference present, order type), cut at a hand-over date so the
overlap is counted once, projected to four columns and unioned.

Predicates are applied on the raw columns before any cast so Catalyst pushes
them into the Parquet scan (``PushedFilters``) and prunes row groups.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.config import QUALIFYING_COMPANY, QUALIFYING_ORDER_TYPES

LEDGER_COLUMNS = ("CUSTNO", "POSTDATE", "TRANSREFNO", "SALES")

RAW_LEDGER_SCHEMA = T.StructType([
    T.StructField("CUSTNO", T.LongType()),
    T.StructField("POSTDATE", T.DateType()),
    T.StructField("TRANSREFNO", T.LongType()),
    T.StructField("SALES", T.DecimalType(18, 2)),
    T.StructField("COMPNO", T.StringType()),
    T.StructField("OTYPE", T.IntegerType()),
])

LEDGER_SCHEMA = T.StructType([f for f in RAW_LEDGER_SCHEMA.fields if f.name in LEDGER_COLUMNS])


def read_extract(spark: SparkSession, path: str, fmt: str = "parquet",
                 schema: T.StructType | None = None) -> DataFrame:
    """Read one raw extract folder.  ``fmt`` may be ``parquet`` or ``delta``
    (Delta needs its connector on the classpath)."""
    reader = spark.read.format(fmt)
    if schema is not None and fmt == "parquet":
        reader = reader.schema(schema)
    try:
        return reader.load(path)
    except Exception as e:  # noqa: BLE001 - Py4J raises generic errors for missing sources
        if fmt == "delta" and "delta" in str(e).lower() and "path does not exist" not in str(e).lower():
            raise RuntimeError("reading a Delta extract needs the Delta Lake connector on the Spark "
                               "classpath (e.g. --packages io.delta:delta-spark_2.13:<version>)") from e
        raise


def qualify(raw: DataFrame, company: str = QUALIFYING_COMPANY,
            order_types: Sequence[int] = QUALIFYING_ORDER_TYPES) -> DataFrame:
    """Keep qualifying sales lines: one company, a transaction reference, an
    order type from the list."""
    return raw.where(
        (F.col("COMPNO") == F.lit(company))
        & F.col("TRANSREFNO").isNotNull()
        & F.col("OTYPE").isin(list(order_types))
    )


def cut(raw: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Hand-over cut of an extract: ``start <= POSTDATE < end`` (either open)."""
    out = raw
    if start is not None:
        out = out.where(F.col("POSTDATE") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("POSTDATE") < F.lit(end))
    return out


def to_ledger(df: DataFrame) -> DataFrame:
    """Project to the ledger columns with fixed types.  ``POSTDATE`` becomes a
    date so closed ranges include their end day even if the source holds
    timestamps.  ``SALES`` keeps a decimal's scale; other numbers become
    decimals of 6 places."""
    sales = df.schema["SALES"].dataType
    exact = F.col("SALES") if isinstance(sales, T.DecimalType) else F.col("SALES").cast("decimal(28,6)")
    return df.select(
        F.col("CUSTNO").cast("long").alias("CUSTNO"),
        F.col("POSTDATE").cast("date").alias("POSTDATE"),
        F.col("TRANSREFNO").cast("long").alias("TRANSREFNO"),
        exact.alias("SALES"),
    )


def union_extracts(extracts: Sequence[DataFrame]) -> DataFrame:
    """Union-all of projected extracts (duplicates kept, columns by name)."""
    if not extracts:
        raise ValueError("no extracts")
    out = to_ledger(extracts[0])
    for e in extracts[1:]:
        out = out.unionByName(to_ledger(e))
    return out


def ledger_from_extracts(raws: Sequence[DataFrame], handover: Sequence[dt.date | None],
                         company: str = QUALIFYING_COMPANY,
                         order_types: Sequence[int] = QUALIFYING_ORDER_TYPES) -> DataFrame:
    """Qualify, cut and union extracts.

    ``handover`` holds one boundary between each pair of neighbouring extracts
    (``len(raws) - 1`` dates): extract i keeps ``[handover[i-1], handover[i])``.
    A ``None`` boundary leaves that side open.
    """
    if len(handover) != len(raws) - 1:
        raise ValueError("need one hand-over date between each pair of extracts")
    bounds = [None, *handover, None]
    parts = [cut(qualify(r, company, order_types), bounds[i], bounds[i + 1])
             for i, r in enumerate(raws)]
    return union_extracts(parts)


def ledger_from_tagged(raw: DataFrame, handover: Sequence[dt.date | None], tag: str = "EXTRACT",
                       company: str = QUALIFYING_COMPANY,
                       order_types: Sequence[int] = QUALIFYING_ORDER_TYPES) -> DataFrame:
    """:func:`ledger_from_extracts` of extracts that come as one frame.

    ``tag`` numbers a row's extract from 0; rows of several extracts repeat.
    The same rows as the union, but what ``raw`` is made from is read and
    shuffled once.
    """
    bounds = [None, *handover, None]
    kept = F.lit(False)
    for k, (start, end) in enumerate(zip(bounds, bounds[1:])):
        own = F.col(tag) == k
        if start is not None:
            own = own & (F.col("POSTDATE") >= F.lit(start))
        if end is not None:
            own = own & (F.col("POSTDATE") < F.lit(end))
        kept = kept | own
    return to_ledger(qualify(raw, company, order_types).where(kept))


def read_ledger(spark: SparkSession, paths: Sequence[str], handover: Sequence[dt.date | None],
                formats: Sequence[str] | None = None) -> DataFrame:
    """Read, qualify, cut and union extract folders in one lazy plan."""
    formats = formats or ["parquet"] * len(paths)
    raws = [read_extract(spark, p, f) for p, f in zip(paths, formats)]
    return ledger_from_extracts(raws, handover)
