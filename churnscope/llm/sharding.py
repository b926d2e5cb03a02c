"""Sharding by Karmarkar-Karp differencing.

Equal texts are one indivisible group.  Groups are dealt to buckets by a hash;
in each bucket the differencing runs over its groups and leaves one partial
partition (the shard sums of the bucket).  The buckets' partial partitions are
differenced in the same way, level by level; that only permutes each bucket's
shards, so the last level, on the driver, sees ``shards`` numbers a bucket.
"""

from __future__ import annotations

import heapq
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope.llm.common import materialize

SHARDS = 8
GROUPS_A_BUCKET = 1000
CELL_ROWS = 512
MAX_CELLS = 4096


def difference(vectors: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Karmarkar-Karp over partial partitions.

    ``vectors``: the shard sums of each.  The two with the largest spread are
    combined, oppositely ordered, until one is left.  Returns its sums and,
    for every input, which final shard each of its shards became.
    """
    heap = []
    parts: dict[int, tuple] = {}  # node: its two sources and the order of each in which they were added
    for i, sums in enumerate(vectors):
        heap.append((min(sums) - max(sums), i, sums))
    heapq.heapify(heap)
    node = len(vectors)
    while len(heap) > 1:
        _, a, first = heapq.heappop(heap)
        _, b, second = heapq.heappop(heap)
        down = sorted(range(len(first)), key=lambda k, s=first: -s[k])
        up = sorted(range(len(second)), key=lambda k, s=second: s[k])
        sums = [first[x] + second[y] for x, y in zip(down, up, strict=True)]
        parts[node] = (a, down, b, up)
        heapq.heappush(heap, (min(sums) - max(sums), node, sums))
        node += 1
    if not heap:
        return [], []
    _, top, total = heap[0]
    final: dict[int, list[int]] = {top: list(range(len(total)))}
    for n in range(node - 1, len(vectors) - 1, -1):  # sources come before what is made of them
        at = final.pop(n)
        a, down, b, up = parts[n]
        for source, order in ((a, down), (b, up)):
            became = [0] * len(order)
            for position, k in enumerate(order):
                became[k] = at[position]
            final[source] = became
    return total, [final[i] for i in range(len(vectors))]


def _differenced(items: DataFrame, n: int, a_bucket: int, shards: int) -> DataFrame:
    """One level: ``key, bucket, became, total`` of items (``key``, ``sums``), differenced bucket by bucket.

    ``total`` (the bucket's sums) stands on one row of each bucket.
    """
    dealt = items.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(-(-n // a_bucket))).cast("string"))

    def run(rows: pa.Table) -> pa.Table:
        listed = sorted(zip(rows.column("key").to_pylist(), rows.column("sums").to_pylist(), strict=True))
        total, became = difference([sums for _, sums in listed])
        return pa.table({"key": pa.array([key for key, _ in listed], pa.string()),
                         "bucket": pa.array(rows.column("bucket").to_pylist(), pa.string()),
                         "became": pa.array(became, pa.list_(pa.int32())),
                         "total": pa.array([total] + [None] * (len(listed) - 1), pa.list_(pa.int64()))})

    return dealt.groupBy("bucket").applyInArrow(run, "key string, bucket string, became array<int>, total array<long>")


def balance_groups(groups: DataFrame, shards: int = SHARDS, a_bucket: int = GROUPS_A_BUCKET) -> DataFrame:
    """``group_key, shard`` for groups (``group_key`` string, ``weight`` long; weights of at least 0, keys distinct).

    Differenced in buckets of about ``a_bucket`` groups, then in buckets of as
    many partial partitions, until one bucket is left, which the driver does.
    """
    n = groups.count()
    levels = []
    items = groups.select(F.col("group_key").alias("key"),
                          F.concat(F.array("weight"), F.array_repeat(F.lit(0).cast("long"), shards - 1)).alias("sums"))
    while n > a_bucket or not levels:
        level = materialize(_differenced(items, max(n, 1), a_bucket, shards))
        levels.append(level)
        items = level.filter("total is not null").select(F.col("bucket").alias("key"), F.col("total").alias("sums"))
        n = items.count()
    rows = sorted(items.collect())  # at most a_bucket rows of ``shards`` numbers
    _, became = difference([list(r[1]) for r in rows])
    final = groups.sparkSession.createDataFrame([(r[0], to) for r, to in zip(rows, became, strict=True)],
                                                "bucket string, to array<int>")
    for level in reversed(levels[1:]):
        final = level.join(final, "bucket").select(F.col("key").alias("bucket"),
                                                   F.transform("became", lambda k: F.col("to")[k]).alias("to"))
    return levels[0].join(final, "bucket").select(F.col("key").alias("group_key"),
                                                  F.col("to")[F.col("became")[0]].alias("shard"))


def number_rows(rows: DataFrame, group: str, order: tuple[str, ...], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... within each value of ``group`` (few values, any size).

    Rows are dealt to cells by a hash of ``order``, numbered inside their cell,
    and a cell's numbers start after those of the cells before it.
    """
    n = rows.count()
    cells = max(1, min(MAX_CELLS, -(-n // CELL_ROWS)))
    keyed = rows.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    starts = (keyed.groupBy(group, "_cell").agg(F.count("*").alias("_size"))
              .withColumn("_before", F.sum("_size").over(Window.partitionBy(group).orderBy("_cell")) - F.col("_size"))
              .drop("_size"))
    numbered = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(group, "_cell").orderBy(*order)) - 1)
    return (numbered.join(starts, [group, "_cell"]).withColumn(name, F.col("_n") + F.col("_before"))
            .drop("_cell", "_n", "_before"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs``.

    ``size``: UTF-8 bytes of the text (null: none) plus 1.  Law ``bytes``: the
    shards' sizes are near equal, equal texts stay together (null counts as
    empty).  ``slot`` is gapless from 0 in each shard.  Repeated rows each get
    a slot of their own; a null doc_id is an ordinary value.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = materialize(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.md5(F.encode(text, "UTF-8")).alias("group_key")))
    groups = sized.groupBy("group_key").agg(F.sum("size").alias("weight"))
    dealt = sized.join(balance_groups(groups, shards), "group_key").select("doc_id", "size", "text_crc32", "shard")
    numbered = number_rows(materialize(dealt), "shard", ("doc_id", "text_crc32", "size"), "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                           F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_sizes(sharded: DataFrame) -> DataFrame:
    """``shard, rows, bytes``: one row a shard."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
