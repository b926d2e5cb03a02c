"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments.  A segment holds the words of some whole
documents: a dictionary of its terms, how often each occurs, and the postings,
which are the sorted word positions of every term.  It knows nothing of the
benchmark, so one index answers many test sets.

Test items come in blocks of bounded size.  A block's windows (runs of
``window`` words) are asked of every segment:

1. the terms' frequencies are summed over all segments;
2. in each window the terms are ordered by them, the rarest first;
3. the rarest term's postings, less its offset in the window, are the possible
   starts; they are intersected with the next rarest term's postings, less its
   offset, and so on.  Starts left over are exact occurrences of the phrase.

Proximity matches start from the rarest term's postings too: all the window's
words must stand within a given number of words, in any order.

Segments are cut by their number of words, so neither a common word nor a
passage that many documents share makes one of them larger than the others.
Nothing but a block of test items and its terms' frequencies passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.common import in_slices, materialize
from churnscope.session import fresh_path, remove_path

WINDOW = 10
NEAR = 15                # a proximity match holds all words of a window within so many
SEGMENT_WORDS = 500_000  # a segment ends with the document that reaches this
BLOCK_WORDS = 500_000    # words of test items asked at a time; more items mean more passes over the index
STARTS = 1_000_000       # possible starts that one step intersects

INDEX_SCHEMA = ("segment long, doc_ids array<long>, lengths array<long>, terms binary, counts binary, postings binary")
HITS_SCHEMA = "segment long, nth int, doc_id long, item long, spans array<struct<start: long, end: long>>"

# A-Z lowered; of the other ASCII signs only digits and letters are part of words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of digits, ASCII letters (lowered) and signs outside ASCII."""
    return text.translate(_FOLD).split()


# ---------------------------------------------------------------- index

def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Segments of the positional index of ``docs`` (doc_id, text; other columns are ignored).

    ``doc_ids`` and ``lengths`` (in words) list a segment's documents in order,
    one entry a row: rows may repeat and ids may be null.  Null texts have no
    words.  ``terms`` are joined by spaces, ``counts`` tells the postings of
    each, ``postings`` their positions in the segment, term after term
    (differences, compressed).  Write the result before asking it twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        words: list[bytes] = []
        ids: list[int | None] = []
        lengths: list[int] = []

        def flushed() -> pa.RecordBatch:
            codes = {word: n for n, word in enumerate(dict.fromkeys(words))}
            at = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
            order = np.sort(at << np.uint64(32) | np.arange(len(words), dtype=np.uint64))
            places = (order & np.uint64(0xFFFFFFFF)).astype("<i4")
            counts = np.bincount(at.astype(np.int64), minlength=len(codes)).astype("<u4")
            packed = zstandard.compress(np.diff(places, prepend=np.int32(0)).tobytes(), 1)
            return pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                 pa.array([b" ".join(codes)], pa.binary()), pa.array([counts.tobytes()], pa.binary()), pa.array([packed], pa.binary())],
                names=["segment", "doc_ids", "lengths", "terms", "counts", "postings"])

        for batch in in_slices(batches, 200):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words_of(text)
                words += own
                ids.append(doc_id)
                lengths.append(len(own))
                if len(words) + 64 * len(ids) >= segment_words:  # documents count too, or empty texts would never fill one
                    yield flushed()
                    segment += 1
                    words, ids, lengths = [], [], []
        if ids:
            yield flushed()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return narrow.mapInArrow(run, INDEX_SCHEMA)


def indexed_documents(index: DataFrame) -> DataFrame:
    """``segment, nth, doc_id, n_words``: one row per row of the documents."""
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("nth", "doc"))
    return rows.select("segment", "nth", F.col("doc.doc_ids").alias("doc_id"), F.col("doc.lengths").alias("n_words"))


# ---------------------------------------------------------------- test items

@dataclass(frozen=True)
class Query:
    """Distinct windows of a block of items, and the items that hold each.

    ``terms[w, k]`` and ``offsets[w, k]``: the k-th rarest word of window w
    (-1: none) and where it stands in it; ``lengths`` the windows' words;
    ``items[first[w]:first[w + 1]]`` the items that hold window w.
    """

    vocabulary: dict[bytes, int]
    terms: np.ndarray
    offsets: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    items: np.ndarray

    def rarest_first(self, frequency: np.ndarray) -> Query:
        seen = np.where(self.terms < 0, np.iinfo(np.int64).max, frequency[self.terms])
        order = np.argsort(seen, axis=1, kind="stable")
        take = lambda part: np.ascontiguousarray(np.take_along_axis(part, order, 1))
        return Query(self.vocabulary, take(self.terms), take(self.offsets), self.lengths, self.first, self.items)


def windows_of(block: list[tuple[int, bytes]], window: int = WINDOW) -> Query:
    """Distinct windows of items (number, words joined by spaces); an item of fewer words is one window."""
    vocabulary: dict[bytes, int] = {}
    found, holders = [np.empty((0, window), np.int32)], [np.empty(0, np.int64)]
    for item, joined in block:
        words = joined.split()
        codes = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32)
        if len(codes) < window:
            codes = np.concatenate([codes, np.full(window - len(codes), -1, np.int32)])
        rows = np.lib.stride_tricks.sliding_window_view(codes, window)
        found.append(rows)
        holders.append(np.full(len(rows), item, np.int64))
    terms, inverse = np.unique(np.concatenate(found), axis=0, return_inverse=True)
    held = np.unique(np.stack([inverse.reshape(-1).astype(np.int64), np.concatenate(holders)]), axis=1)
    first = np.searchsorted(held[0], np.arange(len(terms) + 1))
    offsets = np.broadcast_to(np.arange(window, dtype=np.int32), terms.shape)
    return Query(vocabulary, terms, offsets, (terms >= 0).sum(1), first, held[1])


# ---------------------------------------------------------------- search in one segment

class Segment:
    """Postings of one segment, with the query's terms looked up in its dictionary."""

    def __init__(self, row: dict[str, Any], query: Query, margin: int) -> None:
        import zstandard

        terms = row["terms"].split(b" ") if row["terms"] else []
        asked = np.fromiter((query.vocabulary.get(t, -1) for t in terms), np.int64, len(terms))
        counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        places = np.cumsum(np.frombuffer(zstandard.decompress(row["postings"]), "<i4"), dtype=np.int64)
        wanted = np.repeat(asked >= 0, counts)
        local = np.flatnonzero(asked >= 0)
        self.number = np.full(len(query.vocabulary) + 1, -1, np.int64)  # the query's term -> its place here; the last stands for no term
        self.number[asked[local]] = np.arange(len(local))
        self.number[-1] = -2
        self.counts = counts[local]
        self.begins = np.concatenate([[0], np.cumsum(self.counts)])
        # one sorted array of (term, position); the margin keeps positions before or behind the segment apart from other terms'
        self.stride = int(sum(row["lengths"])) + 2 * margin
        self.postings = np.repeat(np.arange(len(local)), self.counts) * self.stride + places[wanted]
        self.doc_ends = np.cumsum(np.array(row["lengths"], np.int64))

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_ends, place, "right")

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each place is in the postings of each term (-2: any place is)."""
        key = term * self.stride + place
        at = np.minimum(np.searchsorted(self.postings, key), len(self.postings) - 1)
        return (term < 0) | (self.postings[at] == key)

    def steps(self, query: Query) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows all of whose terms occur here, with every posting of their rarest term, in steps of about ``STARTS``."""
        terms = self.number[query.terms]
        alive = np.flatnonzero((terms != -1).all(1))
        rarest = terms[alive, 0]
        step = np.cumsum(self.counts[rarest]) // STARTS
        for part in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(step)) + 1):
            if len(part):
                n = self.counts[rarest[part]]
                ordinal = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                term = np.repeat(rarest[part], n)
                yield np.repeat(alive[part], n), self.postings[self.begins[term] + ordinal] - term * self.stride


def _phrases(segment: Segment, query: Query, within: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, start, end) of every exact occurrence."""
    for window, place in segment.steps(query):
        start = place - query.offsets[window, 0]
        for k in range(1, query.terms.shape[1]):
            good = segment.has(segment.number[query.terms[window, k]], start + query.offsets[window, k])
            window, start = window[good], start[good]
        end = start + query.lengths[window]
        good = (start >= 0) & (segment.document(start) == segment.document(end - 1))
        yield window[good], start[good], end[good]


def _proximities(segment: Segment, query: Query, within: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, start, end): from each word of the window on, the shortest stretch of at most ``within`` words with all of them."""
    width = query.terms.shape[1]
    for window, place in segment.steps(query):
        for k in range(1, width):  # every word must be near the rarest one at all
            term = segment.number[query.terms[window, k]]
            at = np.searchsorted(segment.postings, term * segment.stride + place - within + 1)
            near = segment.postings[np.minimum(at, len(segment.postings) - 1)] - term * segment.stride - place
            good = (term < 0) | ((near < within) & (near > -within))
            window, place = window[good], place[good]
        starts = []
        for k in range(width):  # the stretch starts at a word of the window, not behind the rarest one
            term = segment.number[query.terms[window, k]]
            low = np.searchsorted(segment.postings, term * segment.stride + place - within + 1)
            n = np.where(term < 0, 0, np.searchsorted(segment.postings, term * segment.stride + place, "right") - low)
            ordinal = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = segment.postings[np.repeat(low, n) + ordinal] - np.repeat(term, n) * segment.stride
            starts.append(np.stack([np.repeat(window, n), begin]))
        window, start = np.unique(np.concatenate(starts, axis=1), axis=1)
        end = start + 1
        for k in range(width):
            term = segment.number[query.terms[window, k]]
            at = np.searchsorted(segment.postings, term * segment.stride + start)
            place = segment.postings[np.minimum(at, len(segment.postings) - 1)] - term * segment.stride
            good = (term < 0) | ((at < len(segment.postings)) & (place >= start) & (place < start + within))
            end = np.where(term < 0, end, np.maximum(end, place + 1))[good]
            window, start = window[good], start[good]
        good = segment.document(start) == segment.document(end - 1)
        yield window[good], start[good], end[good]


def _merged(start: np.ndarray, end: np.ndarray) -> list[dict[str, int]]:
    order = np.lexsort((end, start))
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return [{"start": int(a), "end": int(b)} for a, b in zip(start[new], reach[last], strict=True)]


def _search(index: DataFrame, query: Query, find: Callable[..., Iterator], within: int) -> DataFrame:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(query.vocabulary), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                asked = np.fromiter((query.vocabulary.get(t, -1) for t in (terms.split(b" ") if terms else [])), np.int64)
                seen[asked[asked >= 0]] += np.frombuffer(counts, "<u4")[asked >= 0]
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], names=["term", "n"])

    found = index.select("terms", "counts").mapInArrow(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(len(query.vocabulary), np.int64)
    frequency[found["term"].to_numpy()] = found["n"].to_numpy()
    ordered = query.rarest_first(frequency)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            row = batch.to_pylist()[0]
            segment = Segment(row, ordered, max(within, ordered.terms.shape[1]))
            steps = list(find(segment, ordered, within)) if len(segment.postings) else []
            if not steps:
                continue
            window, start, end = (np.concatenate(parts) for parts in zip(*steps, strict=True))
            n = ordered.first[window + 1] - ordered.first[window]
            ordinal = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item = ordered.items[np.repeat(ordered.first[window], n) + ordinal]
            start, end = np.repeat(start, n), np.repeat(end, n)
            doc = segment.document(start)
            order = np.lexsort((item, doc))
            item, doc, start, end = item[order], doc[order], start[order], end[order]
            cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1
            at = np.concatenate([[0], cuts]).astype(np.int64)[:len(doc)]
            base = np.concatenate([[0], segment.doc_ends])
            spans = [_merged(s - base[d], e - base[d]) for s, e, d in zip(np.split(start, cuts), np.split(end, cuts), doc[at], strict=True)] \
                if len(doc) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["segment"]] * len(at), pa.int64()), pa.array(doc[at].astype(np.int32)),
                 pa.array([row["doc_ids"][d] for d in doc[at]], pa.int64()), pa.array(item[at]),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["segment", "nth", "doc_id", "item", "spans"])

    return index.mapInArrow(matched, HITS_SCHEMA)


# ---------------------------------------------------------------- over all items

def item_classes(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``item, words``, one row per distinct word sequence; ``item, item_id``, the items that have it).

    Needs ``item_id`` and ``text``.  Items without words are left out; repeated
    item ids are one item with several texts; a null id counts as ``""``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 200):
            joined = [b" ".join(words_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(joined, pa.binary())], names=["item_id", "words"])

    narrow = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                          F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    words = narrow.mapInArrow(run, "item_id string, words binary").filter(F.length("words") > 0)
    named = materialize(words.withColumn("sha", F.sha2("words", 256)))
    # numbers from the digest's order would need one task; 62 of its bits are a number as good, checked to be distinct
    number = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("item")
    classes = materialize(named.groupBy("sha").agg(F.first("words").alias("words")).select(number, "words"))
    if classes.count() != classes.select("item").distinct().count():
        raise ValueError("two word sequences share a number")
    return classes, named.select(number, "item_id").distinct()


def _over_blocks(index: DataFrame, classes: DataFrame, find: Callable[..., Iterator], window: int, within: int, block_words: int) -> DataFrame:
    n_words = classes.agg(F.sum(F.size(F.split(F.col("words").cast("string"), " ")))).first()[0] or 0
    n_blocks = max(1, -(-n_words // block_words))
    parts = []
    for block in range(n_blocks):
        rows = classes.filter(F.pmod(F.col("item"), F.lit(n_blocks)) == block).collect()
        query = windows_of([(r["item"], bytes(r["words"])) for r in rows], window)
        parts.append(_search(index, query, find, within))
    return reduce(DataFrame.unionByName, parts)


def phrase_matches(index: DataFrame, classes: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``segment, nth, doc_id, item, spans``: stretches of a document's words (start, end behind) that are covered by
    occurrences of windows of an item (``item, words`` of :func:`item_classes`).  No row where nothing is found."""
    return _over_blocks(index, classes, _phrases, window, window, block_words)


def proximity_matches(index: DataFrame, classes: DataFrame, window: int = WINDOW, within: int = NEAR,
                      block_words: int = BLOCK_WORDS) -> DataFrame:
    """The same for stretches of at most ``within`` words that hold all words of a window, in any order and with others between."""
    return _over_blocks(index, classes, _proximities, window, within, block_words)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: int = NEAR,
                  segment_words: int = SEGMENT_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): how far test items (item_id, text) stand in it.

    ``doc_id, n_words, n_hit`` (words inside occurrences of windows), ``n_items``
    and ``item_ids`` (sorted ids of items with occurring windows), ``n_near``
    (items with all words of a window within ``near`` words).  Null and empty
    texts have no words; without items all documents are clean; other columns
    are ignored; equal texts fare alike.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "positional-index")
    build_index(docs, segment_words).write.option("compression", "none").parquet(path)
    index = spark.read.parquet(path)
    classes, members = item_classes(items)
    exact = materialize(phrase_matches(index, classes, window, block_words))
    close = proximity_matches(index, classes, window, near, block_words)

    doc = ["segment", "nth"]
    covered = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["reach"]), F.lit(0))).alias("n"),
                              F.greatest(a["reach"], s["end"]).alias("reach")), lambda a: a["n"])
    hits = exact.groupBy(*doc).agg(covered.alias("n_hit"))
    names = exact.select(*doc, "item").join(members, "item").groupBy(*doc).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    near_items = close.select(*doc, "item").join(members, "item").groupBy(*doc).agg(F.count_distinct("item_id").alias("n_near"))
    none = F.array().cast("array<string>")
    rows = (indexed_documents(index).join(hits, doc, "left").join(names, doc, "left").join(near_items, doc, "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"),
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")))
    done = materialize(rows)
    remove_path(spark, path)
    return done
