"""Bucketed tables: ledger and register laid out by customer once, so that the
frames read from them need no exchange below their first aggregate and none
for the register join.

A table is named in the session's catalog; its files lie where the caller says
(a folder every executor shares) or in the warehouse.  Writing shuffles
nothing: every task adds to each bucket it has rows of.  All lines of a
customer are in one bucket, so a customer holding a large share of them makes
one long scan task; where that matters, read plain extracts, whose first
exchange combines such a customer before it moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY = "CUSTNO"


def write_bucketed(rows: DataFrame, table: str, buckets: int, path: str | None = None, key: str = KEY) -> None:
    """Write ``rows`` as table ``table``, bucketed and sorted by ``key``.

    Choose ``buckets`` by size (about 256 MB of lines each) and the same for
    ledger and register.  An existing table of that name is an error.
    """
    writer = rows.write.format("parquet").bucketBy(buckets, key).sortBy(key)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def read_bucketed(spark: SparkSession, table: str, key: str = KEY) -> DataFrame:
    """The table, if it is bucketed by ``key``."""
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"describe extended {table}").collect()}
    if told.get("Bucket Columns") != f"[`{key}`]":
        raise ValueError(f"{table} is not bucketed by {key}")
    return spark.table(table)
