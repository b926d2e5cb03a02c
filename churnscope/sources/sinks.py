"""Call-list export.

CSV with a header, ``;`` separator and ISO-8859-1 text (characters outside
Latin-1 are written as ``?``).  By default the write is parallel and split
into one folder per segment; ``single_file=True`` funnels everything through
one task and is meant only for small call lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CSV_OPTIONS = {"header": "true", "sep": ";", "encoding": "ISO-8859-1"}


def write_call_lists(df: DataFrame, path: str, partition_by: str | None = "segment",
                     single_file: bool = False, mode: str = "overwrite") -> None:
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode(mode).options(**CSV_OPTIONS)
    if partition_by and partition_by in df.columns:
        writer = writer.partitionBy(partition_by)
    writer.csv(path)


def read_call_lists(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)
