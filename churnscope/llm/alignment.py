"""Cross-tokenizer alignment: which ids of two vocabularies stand for the same bytes.

Both tokenizers split the same bytes.  Where tokens of both end at one byte,
the text is cut; the stretches between are groups, and every A token of a group
is linked to every B token of it.

* Fast path: an array maps each A id to the B id of the same bytes.  Groups of
  one A token and its B twin need no pair at all: how many documents hold such
  a link is counted in vectors as long as the A vocabulary.
* All other groups are irregular.  Only their pairs are shuffled, once for each
  slice of documents that holds them, and their counts come back the same way.

A slice is some whole documents of one task, bounded by tokens.  It is written
as one row, in a row group of its own: twin ids, numbers of irregular groups,
and a dictionary of those groups.  So texts are encoded once, a pair that all
documents hold is one row a slice, and nothing passes the driver but vectors
over the A vocabulary.  Twins, which are most of a slice, are summed up where
they are read; only the irregular groups travel to their counts.
"""

from __future__ import annotations

import ctypes
import hashlib
import json
from collections.abc import Iterator
from contextlib import suppress
from itertools import pairwise
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from churnscope.llm.common import in_slices, kept_between_tasks, materialize
from churnscope.llm.packing import _byte_signs
from churnscope.session import fresh_path, remove_path

SLICE_TOKENS = 1_000_000  # a slice ends with the document that reaches this
DOC_COST = 64             # what a document counts besides its tokens

# A writer holds, and a reader decodes, one slice at a time; by bytes Parquet would look only every 100 rows.
ROW_GROUPS = {"compression": "zstd", "parquet.block.row.count.limit": "1"}

_ARRAYS = ["twins", "groups", "first", "keys", "times", "twin_keys"]
_LONGS = pa.list_(pa.int64())
SLICE_SCHEMA = pa.schema([
    ("slice", pa.int64()), ("doc_ids", _LONGS), ("n_a", _LONGS), ("n_b", _LONGS), ("n_groups", _LONGS), ("n_links", _LONGS),
    ("groups_sha256", pa.list_(pa.string())), ("n_twins", _LONGS), ("n_irregular", _LONGS), *((c, pa.binary()) for c in _ARRAYS),
    ("twin_ids", pa.list_(pa.int32())), ("twin_docs", _LONGS), ("pairs", pa.list_(pa.struct([("pair", pa.int64()), ("docs", pa.int64())])))])
_KEPT = [("slice", pa.int64()), *((c, _LONGS) for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.list_(pa.string())),
         ("n_irregular", _LONGS), *((c, pa.binary()) for c in _ARRAYS[1:])]
SUMMED_SCHEMA = pa.schema([*_KEPT, ("twin_sum", _LONGS), ("twin_best", _LONGS)])
RESULT_SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


class ByteLevelTokenizer:
    """Byte-level BPE from a ``tokenizers`` file; texts get a space in front, special tokens are plain text."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte_of = {sign: byte for byte, sign in _byte_signs().items()}
        ranks = {bytes(byte_of[sign] for sign in token): number for token, number in model["vocab"].items()}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if [model["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))):
            raise ValueError("ids must follow the order of the merges")
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for token, number in ranks.items():
            self.token_bytes[number] = token
        self.encoding = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + text) for text in texts]


class PieceTokenizer:
    """A ``sentencepiece`` model, which puts the space in front itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(n, self.model.id_to_piece(n)) for n in range(self.model.get_piece_size())]
        self.token_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(n) else p.replace("▁", " ").encode() for n, p in pieces]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Two tokenizers with the tables that every slice needs."""

    def __init__(self, a: Any, b: Any) -> None:
        self.a, self.b = a, b
        self.length_a, self.length_b = (np.array([len(t) for t in x.token_bytes], np.int64) for x in (a, b))
        self.n_b = len(b.token_bytes)
        number = {token: n for n, token in enumerate(b.token_bytes)}  # of equal bytes the last id: whole pieces follow the single bytes
        self.twin = np.array([number.get(token, -1) if token else -1 for token in a.token_bytes], np.int64)
        self.twin_texts = [f"{n}|{t};" for n, t in enumerate(self.twin)]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text by A and B; none if either's bytes are not a space and the text."""
        nothing = np.empty(0, np.int32)
        for text, ids_a, ids_b in zip(texts, self.a.encode(texts), self.b.encode(texts), strict=True):
            raw = b" " + text.encode()
            same = text and all(b"".join(map(x.token_bytes.__getitem__, ids)) == raw for x, ids in ((self.a, ids_a), (self.b, ids_b)))
            yield (np.array(ids_a, np.int32), np.array(ids_b, np.int32)) if same else (nothing, nothing)

    def slice_row(self, slice_id: int, docs: list[tuple[int | None, np.ndarray, np.ndarray]]) -> dict[str, Any]:
        """Groups, digests, and what documents of the slice hold of each pair."""
        n_a, n_b = (np.array([len(d[k]) for d in docs], np.int64) for k in (1, 2))
        a, b = (np.concatenate([d[k] for d in docs]) if docs else np.empty(0, np.int32) for k in (1, 2))
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        marks = np.zeros((2, end_a[-1] + 1 if len(a) else 1), bool)
        marks[0, end_a] = marks[1, end_b] = True
        cut_a, cut_b = marks[1, end_a], marks[0, end_b]
        del end_a, end_b, marks
        n_all = int(cut_a.sum())
        size_a, size_b = (np.bincount(np.cumsum(cut) - cut, minlength=n_all) for cut in (cut_a, cut_b))
        at_a, at_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        regular = (size_a == 1) & (size_b == 1) & (self.twin[a[at_a]] == b[at_b])
        odd = np.flatnonzero(~regular)

        known: dict[tuple[bytes, bytes], int] = {}
        raw_a, raw_b = memoryview(a).cast("B"), memoryview(b).cast("B")
        numbers = np.array([known.setdefault((bytes(raw_a[p:q]), bytes(raw_b[r:s])), len(known)) for p, q, r, s in zip(
            (4 * at_a[odd]).tolist(), (4 * (at_a + size_a)[odd]).tolist(), (4 * at_b[odd]).tolist(), (4 * (at_b + size_b)[odd]).tolist(),
            strict=True)], np.int64)
        del raw_a, raw_b, at_b

        # text of every group: twins by A id, behind them the irregular groups by number
        own = [(np.frombuffer(x, np.int32), np.frombuffer(y, np.int32)) for x, y in known]
        texts = self.twin_texts + [f"{','.join(map(str, x.tolist()))}|{','.join(map(str, y.tolist()))};" for x, y in own]
        which = a[at_a].astype(np.int64)
        which[odd] = len(self.twin_texts) + numbers
        group_ends = np.concatenate([[0], np.cumsum(cut_a)])[np.concatenate([[0], np.cumsum(n_a)])]
        digests = [hashlib.sha256("".join(map(texts.__getitem__, which[p:q].tolist()))[:-1].encode()).hexdigest() if q > p else ""
                   for p, q in pairwise(group_ends.tolist())]
        del which

        # pairs of every distinct irregular group, with how often it has each
        counts = [(np.unique(x, return_counts=True), np.unique(y, return_counts=True)) for x, y in own]
        key = [np.add.outer(x[0].astype(np.int64) * self.n_b, y[0].astype(np.int64)).ravel() for x, y in counts]
        times = np.concatenate([np.multiply.outer(x[1], y[1]).ravel() for x, y in counts]) if own else np.empty(0, np.int64)
        first = np.concatenate([[0], np.cumsum([len(k) for k in key])]).astype(np.int64)
        keys, place = np.unique(np.concatenate(key) if own else np.empty(0, np.int64), return_inverse=True)
        is_twin = self.twin[keys // self.n_b] == keys % self.n_b

        # documents that hold each: distinct (document, A id) of twins, distinct (document, pair) of the others
        doc = np.repeat(np.arange(len(docs)), np.diff(group_ends))
        held = np.unique(doc[odd] * max(1, len(known)) + numbers)
        n = np.diff(first)[held % max(1, len(known))]
        ordinal = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair = place[np.repeat(first[held % max(1, len(known))], n) + ordinal]
        doc_pair = np.unique(np.repeat(held // max(1, len(known)), n) * max(1, len(keys)) + pair)
        pair_docs = np.bincount(doc_pair % max(1, len(keys)), minlength=len(keys))
        inside = doc_pair[is_twin[doc_pair % max(1, len(keys))]] if len(keys) else doc_pair
        doc_twin = np.concatenate([doc[regular] * len(self.twin) + a[at_a[regular]],
                                   inside // max(1, len(keys)) * len(self.twin) + keys[inside % max(1, len(keys))] // self.n_b])
        twin_docs = np.bincount(np.unique(doc_twin) % len(self.twin), minlength=len(self.twin))
        twin_ids = np.flatnonzero(twin_docs)

        per_doc = lambda flags: np.add.reduceat(np.append(flags, 0), group_ends[:-1]) * (np.diff(group_ends) > 0)
        return {"slice": slice_id, "doc_ids": [d[0] for d in docs], "n_a": n_a, "n_b": n_b, "n_groups": np.diff(group_ends),
                "n_links": per_doc(size_a * size_b), "groups_sha256": digests, "n_twins": per_doc(regular.astype(np.int64)),
                "n_irregular": per_doc((~regular).astype(np.int64)), "twins": a[at_a[regular]].astype("<i4").tobytes(),
                "groups": numbers.astype("<i4").tobytes(), "first": first.astype("<i8").tobytes(), "keys": place.astype("<i4").tobytes(),
                "times": times.astype("<i8").tobytes(), "twin_keys": keys[is_twin].astype("<i8").tobytes(),
                "twin_ids": twin_ids, "twin_docs": twin_docs[twin_ids],
                "pairs": (keys[~is_twin], pair_docs[~is_twin])}


def _batch(row: dict[str, Any]) -> pa.RecordBatch:
    arrays = [pa.array([row[f.name]], f.type) for f in SLICE_SCHEMA if f.name != "pairs"]
    kind = SLICE_SCHEMA.field("pairs").type
    pairs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in row["pairs"]], fields=list(kind.value_type))
    held = pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs, type=kind)
    return pa.RecordBatch.from_arrays([*arrays, held], schema=SLICE_SCHEMA)


def _give_back() -> None:
    """Memory that Python has freed back to the system, where the C library can (a slice leaves some 100 MB)."""
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _slices(docs: DataFrame, name: str, make: Any, slice_tokens: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = kept_between_tasks(name, make)
        slice_id, size = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[int | None, np.ndarray, np.ndarray]] = []
        for batch in in_slices(batches, 100):
            for doc_id, ids in zip(batch.column(0).to_pylist(), aligner.encode(batch.column(1).to_pylist()), strict=True):
                held.append((doc_id, *ids))
                size += len(ids[0]) + DOC_COST
                if size >= slice_tokens:
                    yield _batch(aligner.slice_row(slice_id, held))
                    slice_id, size, held = slice_id + 1, 0, []
                    _give_back()
        if held:
            yield _batch(aligner.slice_row(slice_id, held))
        _give_back()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return narrow.mapInArrow(run, from_arrow_schema(SLICE_SCHEMA))


def _by_doc(values: np.ndarray, sizes: list[int]) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return np.diff(np.concatenate([[0], np.cumsum(values)])[ends])


def _twins_summed(slices: DataFrame, twin_docs: np.ndarray, best: np.ndarray) -> DataFrame:
    """The slices with ``twin_sum, twin_best`` (counts of a document's twins, and how many are best) in place of the twins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            twins = np.frombuffer(batch.column("twins")[0].as_buffer(), "<i4")
            sizes = batch.column("n_twins")[0].as_py()
            sums = [pa.array([_by_doc(x, sizes)], _LONGS) for x in (twin_docs[twins], twin_docs[twins] == best[twins])]
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(kind) for c, kind in _KEPT] + sums, schema=SUMMED_SCHEMA)

    return slices.select("n_twins", "twins", *(c for c, _ in _KEPT)).mapInArrow(run, from_arrow_schema(SUMMED_SCHEMA))


def _scored(n_b: int, twin_docs: np.ndarray, best: np.ndarray) -> Any:
    """What one slice needs to score its documents, given the counts of its irregular pairs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        first, times, own_twins = (np.frombuffer(row[c], "<i8") for c in ("first", "times", "twin_keys"))
        groups, place = (np.frombuffer(row[c], "<i4") for c in ("groups", "keys"))
        keys = np.concatenate([right["pair"].to_numpy(), own_twins]).astype(np.int64)
        docs = np.concatenate([right["docs"].to_numpy(), twin_docs[own_twins // n_b]]).astype(np.int64)
        order = np.argsort(keys)
        keys, docs = keys[order], docs[order]
        of_link, is_best = docs[place], docs[place] == best[keys[place] // n_b]
        sums = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[first])
        group_sum, group_best = sums(of_link * times), sums(is_best * times)
        count_sum = np.array(row["twin_sum"], np.int64) + _by_doc(group_sum[groups], row["n_irregular"])
        n_best = np.array(row["twin_best"], np.int64) + _by_doc(group_best[groups], row["n_irregular"])
        out = [row["doc_ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], n_best, count_sum]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out] + [pa.array(row["groups_sha256"], pa.string())],
                                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def _vector(rows: DataFrame, length: int) -> np.ndarray:
    """``id, n`` rows, at most one an id of the vocabulary, as a vector."""
    found, out = rows.toArrow(), np.zeros(length, np.int64)
    out[found["id"].to_numpy()] = found["n"].to_numpy()
    return out


def align(docs: DataFrame, path_a: str, path_b: str, pattern: str, slice_tokens: int = SLICE_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Documents aligned, and the counts of all linked pairs.

    First: one row per row of ``docs`` (doc_id, text; others are ignored) with
    ``doc_id, n_a, n_b`` (tokens), ``n_groups, n_links, n_best`` (links whose
    pair has the highest count of its A id, ties included), ``count_sum`` (of
    counts over links) and ``groups_sha256``.  Second: ``a, b, docs``, how many
    documents hold the pair linked.

    ``path_a`` is a byte-level BPE file, cut into words by ``pattern``;
    ``path_b`` a sentencepiece model.  Null and empty texts, and those whose
    tokens do not give back their bytes, have no tokens: zeros and an empty
    digest.  Repeated rows are documents of their own; null ids stay null.
    """
    spark = docs.sparkSession
    name = f"aligner {path_a} {path_b}"

    def make() -> Aligner:
        return Aligner(ByteLevelTokenizer(path_a, pattern), PieceTokenizer(path_b))

    path = fresh_path(spark, "alignment-slices")
    _slices(docs, name, make, slice_tokens).write.options(**ROW_GROUPS).parquet(path)
    slices = spark.read.parquet(path)
    aligner = make()
    n_b, twin = aligner.n_b, aligner.twin
    held = slices.select("slice", F.explode("pairs").alias("p")).select("slice", "p.pair", "p.docs")
    pairs = materialize(held.groupBy("pair").agg(F.sum("docs").alias("docs")))
    twins = slices.select(F.explode(F.arrays_zip("twin_ids", "twin_docs")).alias("t")).groupBy(F.col("t.twin_ids").alias("id")).agg(
        F.sum("t.twin_docs").alias("n"))
    twin_docs = _vector(twins, len(twin))
    id_a = F.expr(f"pair div {n_b}")
    best = np.maximum(twin_docs, _vector(pairs.groupBy(id_a.alias("id")).agg(F.max("docs").alias("n")), len(twin)))

    counts = held.select(F.col("slice").alias("asked_by"), "pair").join(pairs, "pair")
    rows = materialize(_twins_summed(slices, twin_docs, best).groupBy("slice").cogroup(counts.groupBy("asked_by")).applyInArrow(
        _scored(n_b, twin_docs, best), RESULT_SCHEMA))
    remove_path(spark, path)
    same = [(int(n), int(twin[n]), int(twin_docs[n])) for n in np.flatnonzero(twin_docs)]
    linked = pairs.select(id_a.cast("long").alias("a"), (F.col("pair") % n_b).alias("b"), "docs").unionByName(
        spark.createDataFrame(same, "a long, b long, docs long"))
    return rows, linked
