"""Document fingerprints: SimHash with permuted block tables.

A document's terms are its pairs of neighbouring words (the word itself in a
one-word text), weighted by 1 + log2 of their count.  Every term's 256-bit hash
votes on each bit with its weight, for a one or against it for a zero.

Search: with the bits cut into ``radius + 1`` blocks, two fingerprints within
the radius agree in at least one block, so one table per block, keyed by that
block (the block permuted to the front), holds every pair.  A pair is counted
only in the first table in which it meets.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.common import broadcast_if_small, materialize

BITS = 256
RADIUS = 7
BUCKET_CHUNK = 1024
BROADCAST_BLOCKS = 2_000_000  # queries' blocks (some 20 bytes each) up to this many go to every task; more are joined by shuffle
_LANES = BITS // 64
# Odd 64-bit mixing constants of the splitmix64 finaliser, and a lane step.
_MIX_1, _MIX_2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)

_STEPS = _STEP * np.arange(1, _LANES + 1, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def text_fingerprint(raw: bytes, known: dict[bytes, int]) -> bytes:
    """The 32 bytes of a text's fingerprint; zero without words.  ``known``: hashes of words met so far."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    if not words:
        return bytes(BITS // 8)
    try:
        hashes = np.array(list(map(known.__getitem__, words)), np.uint64)
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = xxh64_intdigest(w)
        hashes = np.array(list(map(known.__getitem__, words)), np.uint64)
    if len(hashes) > 1:
        hashes = _mixed(hashes[:-1]) + hashes[1:] * _STEP  # order matters
    terms, counts = np.unique(hashes, return_counts=True)
    weights = (1 + np.log2(counts)).astype(np.float32)
    votes = np.zeros(BITS, np.float64)
    for at in range(0, len(terms), 16_384):  # bounded memory for very long texts
        part, w = terms[at:at + 16_384], weights[at:at + 16_384]
        lanes = np.stack([_mixed(part + _STEPS[k]) for k in range(_LANES)], axis=1)
        ones = np.unpackbits(lanes.astype(">u8").view(np.uint8).reshape(len(part), BITS // 8), axis=1)
        votes += 2 * (w @ ones.astype(np.float32)).astype(np.float64) - w.sum(dtype=np.float64)
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Cosine that the share of differing bits estimates, 0 where it is negative."""
    differing = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return 1.0 if differing == 0 else max(0.0, float(np.cos(np.pi * differing / BITS)))


def fingerprint_documents(docs: DataFrame, known_words: int = 500_000) -> DataFrame:
    """``doc_id, fingerprint`` (64 hex digits) of every row; null text counts as empty (all zeros)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                if len(known) > known_words:
                    known.clear()
                out.append(text_fingerprint(text, known).hex())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, fingerprint string")


def neighbour_buckets(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows in buckets of neighbouring ids, with each bucket's next document added.

    Columns ``bucket, border, doc_id, text, digest``.  Ascending bucket numbers
    follow the order of the documents: descending doc_id, equal ids by the
    text's digest, null ids last.  Ids that fill several buckets, null ids
    among them, are cut into even ranges of the digest.  ``border`` rows are
    copies: the first document of the next bucket (after the last: of the
    first), which follows the bucket's last row; of rows equal in id and text
    every one is copied.
    """
    base = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
            .withColumn("digest", F.xxhash64("text")))
    shares = [k / buckets for k in range(1, buckets)] or [0.5]
    found, rows, nulls = base.agg(F.percentile_approx("doc_id", shares, 10 * buckets), F.count("*"),
                                  F.count_if(F.col("doc_id").isNull())).first()
    times = Counter(found or [])
    hot = {i: n for i, n in times.items() if n > 1}
    cuts = np.array(sorted(set(times) | {i + 1 for i in hot if i < np.iinfo(np.int64).max}), np.int64)
    null_place = len(cuts) + 1
    slices = np.ones(null_place + 1, np.int64)  # places in the order of the documents: the highest ids first
    for i, n in hot.items():
        slices[len(cuts) - np.searchsorted(cuts, i, side="right")] = n
    slices[null_place] = max(1, -(-nulls * buckets // max(rows, 1)))
    width = int(slices.max())

    def bucket_numbers(doc_id: pd.Series, missing: pd.Series, digest: pd.Series) -> np.ndarray:
        place = len(cuts) - np.searchsorted(cuts, doc_id.to_numpy(np.int64), side="right")
        place = np.where(missing.to_numpy(bool), null_place, place)
        slice_of = ((digest.to_numpy(np.int64) >> 32) + 2 ** 31) * slices[place] >> 32  # ascending with the digest
        return place * width + slice_of

    @F.pandas_udf("long")
    def bucket_of(doc_id: pd.Series, missing: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series(bucket_numbers(doc_id, missing, digest))

    key = (F.coalesce("doc_id", F.lit(0).cast("long")), F.col("doc_id").isNull(), F.col("digest"))
    firsts = sorted((r[0], r[1][0] or 0, ~r[1][1]) for r in base.select("doc_id", "digest", bucket_of(*key).alias("b")).groupBy("b")
                    .agg(F.max(F.struct("doc_id", F.bitwise_not("digest")))).collect())  # one row a bucket
    first_of = {b: (i, digest) for b, i, digest in firsts}
    before = {firsts[k][0]: firsts[k - 1][0] for k in range(len(firsts))}

    @F.pandas_udf("array<struct<bucket: long, border: boolean>>")
    def places(doc_id: pd.Series, missing: pd.Series, digest: pd.Series) -> pd.Series:
        at = bucket_numbers(doc_id, missing, digest)
        out = []
        for b, i, d in zip(at.tolist(), doc_id.tolist(), digest.tolist(), strict=True):
            own = [{"bucket": b, "border": False}]
            if (i, d) == first_of[b]:
                own.append({"bucket": before[b], "border": True})
            out.append(own)
        return pd.Series(out)

    return (base.withColumn("p", F.explode(places(*key)))
            .select("p.bucket", "p.border", "doc_id", "text", "digest"))


def edited_likeness(docs: DataFrame, buckets: int | None = None, known_words: int = 500_000) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the likeness to that and to the next document.

    Edited: the last floor(n/2) code points replaced by the first as many (or
    all) of the next document in descending doc_id; after the last comes the
    first, so a lone document follows itself.  Null text is empty; null ids
    come last; equal ids, null ones too, are ordered by a digest of their text.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = neighbour_buckets(docs, buckets or 4 * n)
    dealt = (placed.repartition(n, "bucket")
             .sortWithinPartitions("bucket", "border", F.col("doc_id").desc_nulls_last(), "digest").drop("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        out: list[tuple] = []

        def scored(doc_id, text: str, own: bytes, following: str, next_print: bytes) -> tuple:
            half = len(text) // 2
            edited = (text[:len(text) - half] + following[:half]).encode()
            changed = text_fingerprint(edited, known)
            return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), own.hex(), changed.hex(),
                    likeness(own, changed), likeness(own, next_print))

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)
            out.clear()
            return made

        last = None  # (bucket, doc_id, text, fingerprint) that waits for the row after it
        for batch in batches:
            for bucket, border, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(known) > known_words:
                    known.clear()
                follows = last is not None and last[0] == bucket
                if border and not follows:
                    continue  # a second copy behind the border, or of a bucket without rows
                own = text_fingerprint(text.encode(), known)
                if follows:
                    out.append(scored(last[1], last[2], last[3], text, own))
                last = None if border else (bucket, doc_id, text, own)
            if out:
                yield flush()

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")


def count_within(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, chunk: int = BUCKET_CHUNK) -> DataFrame:
    """``fingerprint, n_within``: how many rows of ``prints`` lie within ``radius`` bits of each distinct query.

    Both frames have a column ``fingerprint`` (64 hex digits; null rows are
    ignored).  Equal fingerprints are one candidate with a count.  A bucket is
    held in chunks of about ``chunk`` fingerprints on either side, so a very
    common block is spread over tasks and its pairs are compared in blocks,
    not emitted.  Candidates that share no block with a query are left out
    before any exchange if the queries' blocks are few enough to go to every
    task.
    """
    digits = BITS // 4
    edges = [round(k * digits / (radius + 1)) for k in range(radius + 2)]
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.substring("fingerprint", edges[t] + 1, edges[t + 1] - edges[t]).alias("key"))
                       for t in range(radius + 1)))

    def blocks(frame: DataFrame) -> DataFrame:
        return frame.select("fingerprint", "n", F.explode(tables).alias("k")).select("fingerprint", "n", "k.t", "k.key")

    def bucketed(keyed: DataFrame, side: str) -> DataFrame:
        sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("size"))
        cell = F.pmod(F.xxhash64("fingerprint"), F.ceil(F.col("size") / chunk))
        return (keyed.join(sizes, ["t", "key"]).groupBy("t", "key", cell.alias(f"{side}_cell"))
                .agg(F.collect_list(F.struct("fingerprint", "n")).alias(side)))

    classes = prints.filter("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n"))
    asked = queries.filter("fingerprint is not null").select("fingerprint", F.lit(1).cast("long").alias("n")).distinct()
    asked_blocks = materialize(blocks(asked))
    met = broadcast_if_small(materialize(asked_blocks.select("t", "key").distinct()), BROADCAST_BLOCKS)
    candidates = blocks(classes).join(met, ["t", "key"], "left_semi")
    pairs = bucketed(asked_blocks, "q").join(bucketed(candidates, "c"), ["t", "key"]).select("t", "q", "c")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bits(rows: list[dict]) -> np.ndarray:
            raw = np.frombuffer(bytes.fromhex("".join(r["fingerprint"] for r in rows)), np.uint8)
            return raw.reshape(len(rows), digits // 2)

        def nibbles(raw: np.ndarray) -> np.ndarray:
            return np.stack([raw >> 4, raw & 15], axis=2).reshape(len(raw), digits)

        for batch in batches:
            out: dict[str, int] = {}
            for t, q, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                candidates, weight = bits(c), np.array([r["n"] for r in c])
                earlier = nibbles(candidates)
                for row, own, own_nibbles in zip(q, bits(q), nibbles(bits(q)), strict=True):
                    near = np.bitwise_count(candidates ^ own).sum(axis=1, dtype=np.int64) <= radius
                    for s in range(t):  # the pair has met in an earlier table
                        near &= (earlier[:, edges[s]:edges[s + 1]] != own_nibbles[edges[s]:edges[s + 1]]).any(axis=1)
                    out[row["fingerprint"]] = out.get(row["fingerprint"], 0) + int(weight[near].sum())
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())],
                                             names=["fingerprint", "n_within"])

    return (pairs.mapInArrow(compare, "fingerprint string, n_within long")
            .groupBy("fingerprint").agg(F.sum("n_within").alias("n_within")))
