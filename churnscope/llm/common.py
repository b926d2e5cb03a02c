"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from types import ModuleType
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.session import materialize

__all__ = ["broadcast_if_small", "connected_components", "documents", "fold_of", "free_names", "in_slices", "kept_between_tasks", "materialize", "table"]


def kept_between_tasks(name: str, make: Callable[[], Any]) -> Any:
    """An object that a Python worker keeps from one task to the next.

    Functions of this package come to the worker by value, with new globals for
    every task; a module registered here outlives them.
    """
    kept = sys.modules.setdefault("_churnscope_worker", ModuleType("_churnscope_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened by underscores until ``docs`` has no column of that name in any case."""
    taken = {c.lower() for c in docs.columns}
    free = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        free.append(name)
    return free


def in_slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so few texts are Python objects at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def broadcast_if_small(rows: DataFrame, limit: int) -> DataFrame:
    """``rows``, marked for broadcast if a count shows at most ``limit``; otherwise the join shuffles.

    ``rows`` is read twice, so pass a table or a checkpointed frame.
    """
    return F.broadcast(rows) if rows.count() <= limit else rows


def fold_of(id_column: str, n_folds: int) -> Column:
    """crc32(id as text) mod ``n_folds``; null ids count as the text ``""``."""
    return F.crc32(F.encode(F.coalesce(F.col(id_column).cast("string"), F.lit("")), "UTF-8")) % n_folds


def _smallest(pairs: DataFrame) -> DataFrame:
    """Per node ``a``: the smallest of itself and its neighbours ``b``."""
    return pairs.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node each node of ``edges`` (a, b: long) is linked to.

    Alternating large-star and small-star steps until nothing changes.  Each
    step is a map-side combined minimum and one equi-join, so a node with very
    many links is split like any skewed join; every round is checkpointed.
    Nodes without edges have no row.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .filter("a <> b").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (both.filter("b > a").join(_smallest(both), "a")
                 .select(F.col("b").alias("a"), F.col("least").alias("b")))
        least = _smallest(large)
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
                 .unionByName(least.select("a", F.col("least").alias("b"))).filter("a <> b").distinct())
        now = materialize(small)
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = after
