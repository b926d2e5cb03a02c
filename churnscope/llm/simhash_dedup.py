"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are computed per document, then only distinct ones go on.  Blocks
of ``BLOCK_BITS`` bits: two fingerprints within the radius agree in all but
``radius`` of the blocks, so every choice of the other blocks is a bucket key.
Inside a bucket the fingerprints are stored as bit planes (bit b of all
members in one integer), and one pass over the planes updates the distances of
all members with carry-save counters, given up once every member exceeds the
radius.  Buckets above ``BUCKET_LIMIT`` take an exact way without comparing:
two fingerprints at most two bits apart share a neighbour one bit from both,
and a neighbour has at most 65 fingerprints around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.common import broadcast_if_small, connected_components, free_names, in_slices, materialize

SHINGLE = 3
RADIUS = 2
SEED = 42
BLOCKS = 4
BLOCK_BITS = 16
BUCKET_LIMIT = 2048
BROADCAST_IDS = 2_000_000  # ids of documents to drop (8 bytes each) up to this many go to every task; more are joined by shuffle


def shingle_fingerprint(raw: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a UTF-8 text: ASCII lower case, words at ASCII white space."""
    from xxhash import xxh64_digest

    words = raw.lower().split()
    if not words:
        return 0
    counts = np.zeros(64, np.int64)
    n = max(1, len(words) - size + 1)
    for at in range(0, n, 65_536):  # bounded memory for very long texts
        part = words[at:at + 65_536 + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False)) if n > 1 or len(part) >= size \
            else (b" ".join(part),)
        hashes = np.frombuffer(b"".join(map(xxh64_digest, shingles, repeat(seed))), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp``: fp is the 64 bits as a signed long.  Null text counts as empty (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 500):
            prints = np.array([shingle_fingerprint(t, size, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def near_links(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (i, j), enough to connect all members within ``radius`` bits, by bit-sliced comparison.

    For each member the differing planes are added to a carry-save counter
    per member: bit j of ``sums[k]`` is bit k of member j's distance so far;
    ``over`` marks members that have passed the radius.
    """
    n = len(prints)
    full = (1 << n) - 1
    bits = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    live = [b for b in range(64) if 0 < bits[:, b].sum() < n]  # planes on which members differ at all
    planes = [int.from_bytes(np.packbits(bits[:, b], bitorder="little").tobytes(), "little") for b in live]
    width = radius.bit_length() + 1
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i in range(n):
        sums, over = [0] * width, full >> i + 1 << i + 1 ^ full  # members up to i have had their turn
        for plane in planes:
            carry = plane ^ full if plane >> i & 1 else plane
            for k in range(width):
                sums[k], carry = sums[k] ^ carry, sums[k] & carry
                if not carry:
                    break
            over |= carry
            past, equal = 0, full  # counters above the radius, compared from the highest bit
            for k in range(width - 1, -1, -1):
                if radius >> k & 1:
                    equal &= sums[k]
                else:
                    past |= equal & sums[k]
                    equal &= ~sums[k]
            over |= past
            if over == full:
                break
        near = full & ~over
        while near:
            j = (near & -near).bit_length() - 1
            near &= near - 1
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, limit: int = BUCKET_LIMIT) -> DataFrame:
    """``a, b``: links that connect all fingerprints within ``radius`` (at most 2) bits of each other."""
    if not 0 <= radius <= 2:
        raise ValueError("blocks and the exact way for large buckets are laid out for a radius of 0 to 2")
    block = [F.shiftrightunsigned("fp", BLOCK_BITS * k).bitwiseAND((1 << BLOCK_BITS) - 1) for k in range(BLOCKS)]
    choices = list(combinations(range(BLOCKS), BLOCKS - radius))
    shift = F.lit(0).cast("long")
    keys = []
    for t, choice in enumerate(choices):
        key = shift
        for k in choice:
            key = F.shiftleft(key, BLOCK_BITS) + block[k]
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keyed.join(sizes, ["t", "key"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = [], []
            for members in batch.column(0).to_pylist():
                for i, j in near_links(np.array(members, np.int64).view(np.uint64), radius):
                    first.append(members[i])
                    second.append(members[j])
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["a", "b"])

    buckets = (shared.filter(F.col("n") <= limit).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps"))
    compared = buckets.mapInArrow(compare, "a long, b long")
    if radius == 0:
        return compared
    near = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)),
                                               lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    # radius 1: a shared neighbour would also join members two bits apart, so there only the fingerprints themselves meet
    around = shared.filter(F.col("n") > limit).select("fp").distinct().select("fp", F.explode(near).alias("m"))
    if radius == 1:
        met = around.join(distinct.withColumnRenamed("fp", "m"), "m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    else:
        met = (around.groupBy("m").agg(F.collect_list("fp").alias("fps"), F.min("fp").alias("b"))  # at most 65
               .filter(F.size("fps") > 1).select(F.explode("fps").alias("a"), "b"))
    return compared.unionByName(met.filter("a <> b"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, seed: int = SEED,
                    limit: int = BUCKET_LIMIT) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs`` (doc_id, text; others are ignored).

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``radius`` differing bits.  Null text is empty; repeated rows stay repeated;
    a null doc_id gets the smallest id of its group, null if there is none.
    """
    prints = materialize(fingerprints(docs, size, seed))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(fingerprint_links(distinct.select("fp"), radius, limit))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The document with the smallest id of each near-duplicate group, all columns kept.

    Of rows that share that id one stays; rows without an id are left alone.
    Columns may have any names.
    """
    other, repeat = free_names(docs, "_other", "_repeated")
    groups = materialize(near_duplicates(docs, **options).filter("doc_id is not null"))
    others = materialize(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(other)).distinct())
    kept = docs.join(broadcast_if_small(others, BROADCAST_IDS), F.col("doc_id") == F.col(other), "left_anti")
    repeated = materialize(groups.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
                           .filter("n > 1").select(F.col("doc_id").alias(repeat)))
    if repeated.isEmpty():
        return kept
    again = F.col("doc_id") == F.col(repeat)
    return (kept.join(repeated, again, "left_anti")
            .unionByName(kept.join(repeated, again, "left_semi").dropDuplicates(["doc_id"])))
