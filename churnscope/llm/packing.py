"""Best-fit packing by minimum bin slack.

Pieces of equal length are interchangeable, so the search runs over the
histogram of lengths (at most ``capacity`` rows, whatever the corpus size):
per bin, a bitset subset-sum program over the available lengths, seeded with
the longest one left, finds the fullest feasible combination; the combination
is removed as often as the counts allow.  Spark then numbers the pieces of
each length and looks each number up in the resulting plan, so no piece passes
through the driver and the token ids are never shuffled.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope.llm.common import broadcast_if_small, free_names, in_slices, kept_between_tasks, materialize

CAPACITY = 2048
BROADCAST_HOT = 1_000_000  # hashes of often repeated pieces (8 bytes each) up to this many go to every task
CELL_ROWS = 512      # pieces numbered by one window group, until MAX_CELLS groups a length
MAX_CELLS = 4096

PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids binary"


# Words of Latin letters, with a full stop or comma at most: lower case and mark can be split off without changing ids.
_PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,]?)")
# White space to Python, but not to the tokenizer.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def _byte_signs() -> dict[int, str]:
    """Byte -> sign of the byte-level alphabet, by code point: visible Latin-1 signs stand for themselves."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of words (little-endian unsigned 32-bit), by a tokenizer that drops white space and never spans it.

    Plain words are merged by the model's own merges, if that gives the ids of
    its full chain for some probes; all other words go through the chain.
    """

    def __init__(self, path: str, known_words: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker on every core
        from tokenizers import Tokenizer

        self.chain, self.known, self.known_words = Tokenizer.from_file(path), {}, known_words
        self._merge_plain(path)
        probes = ["the", "Thndbleou.", "\u00dcbergr\u00f6\u00dfe,", "NA\u00cfVE", "a"]
        self.plain = all(self._plain_ids(w) == self._chain_ids([w])[0] for w in probes)

    def _merge_plain(self, path: str) -> None:
        """The model's merges over bytes, for words without its chain.

        A word's last byte is a symbol of its own in the model; here it is the
        byte and 0xFF, which no UTF-8 text holds, merged before all others.
        """
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        signs, end = _byte_signs(), model["end_of_word_suffix"]
        byte_of = {sign: byte for byte, sign in signs.items()}

        def as_bytes(token: str) -> bytes:
            body = token.removesuffix(end)
            return bytes(map(byte_of.__getitem__, body)) + (b"\xff" if body != token else b"")

        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        tokens = [*((bytes([byte]), sign) for byte, sign in signs.items()),
                  *((bytes([byte, 255]), sign + end) for byte, sign in signs.items() if byte != 255),
                  *((as_bytes(x) + as_bytes(y), x + y) for x, y in pairs)]
        ranks: dict[bytes, int] = {}
        self.packed: list[bytes] = []
        for token, sign in tokens:
            if token not in ranks:
                ranks[token] = len(self.packed)
                self.packed.append(struct.pack("<I", model["vocab"].get(sign, 0)))
        self.merged = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.marks = {mark: self._merged(mark) for mark in ".,"}

    def _chain_ids(self, words: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.chain.encode_batch_fast(words, add_special_tokens=False)]

    def _plain_ids(self, word: str) -> bytes | None:
        found = _PLAIN.fullmatch(low := word.lower())
        if not found or len(low) != len(word):
            return None
        part, mark = found.groups()
        ids = self.known.get(part)
        if ids is None:
            ids = self.known[part] = self._merged(part)
        return ids + self.marks[mark] if mark else ids

    def _merged(self, part: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.merged.encode_single_piece(part.encode() + b"\xff")))

    def _learn(self, words: set[str]) -> None:
        rest = []
        for word in words:
            ids = self._plain_ids(word) if self.plain else None
            if ids is None:
                rest.append(word)
            else:
                self.known[word] = ids
        self.known.update(zip(rest, self._chain_ids(rest), strict=True))

    def texts_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts: cut at white space, every distinct word encoded once."""
        return list(map(self.text_ids, texts))

    def text_ids(self, text: str) -> bytes:
        if any(sign in text for sign in _SEPARATORS):
            words = [w for w in text.replace("\n", " ").split(" ") if w]
        else:
            words = text.split()
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:  # only texts with new words are looked through for them
            new = set(words).difference(self.known)
            if len(self.known) + len(new) > self.known_words:
                self.known.clear()
                new = set(words)
            self._learn(new)
            return b"".join(map(self.known.__getitem__, words))


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = 0,
                    known_words: int = 500_000) -> DataFrame:
    """Token ids of each document plus ``separator``, cut into pieces of ``capacity``.

    Needs ``doc_id`` and ``text``; other columns are ignored.  Null text is
    empty (one piece with the separator alone); repeated rows give repeated
    pieces.  ``ids`` are little-endian unsigned 32-bit numbers.
    ``known_words`` bounds a worker's word memory (it is emptied when full).
    The tokenizer must be case-blind, drop white space and never span it (see
    :class:`WordTokenizer`).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = kept_between_tasks(f"tokenizer {tokenizer_path}", lambda: WordTokenizer(tokenizer_path, known_words))
        end = np.array([separator], dtype="<u4").tobytes()
        step = 4 * capacity
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        for batch in in_slices(batches, 100):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, own in zip(batch.column(0).to_pylist(), tokenizer.texts_ids(batch.column(1).to_pylist()), strict=True):
                ids = own + end
                for n, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    for out, value in zip(rows, (doc_id, n, at // 4, len(part) // 4, part), strict=True):
                        out.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)],
                                             names=["doc_id", "piece", "start", "length", "ids"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return narrow.mapInArrow(run, PIECES_SCHEMA)


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Plan of (combination {length: how many}, times it is packed).

    Each combination holds the longest length left and the fullest feasible
    rest: a bitset whose bit s tells that s tokens can be reached is grown
    length by length (multiples in powers of two) until the room is filled.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError(f"lengths must be 1 to {capacity}")
    plan = []
    order = sorted(left, reverse=True)
    while order:
        seed = order[0]
        room = capacity - seed
        mask, bits = (1 << (room + 1)) - 1, 1
        grown: list[tuple[int, int, int]] = []
        for length in order:
            free = min(left[length] - (length == seed), room // length)
            take = 1
            while free > 0 and not bits >> room & 1:
                take = min(take, free)
                wider = (bits | bits << (take * length)) & mask
                if wider != bits:
                    grown.append((length, take, bits))
                    bits = wider
                free -= take
                take *= 2
            if bits >> room & 1:
                break
        reached = bits.bit_length() - 1
        combination = {seed: 1}
        for length, take, before in reversed(grown):
            if not before >> reached & 1:
                combination[length] = combination.get(length, 0) + take
                reached -= take * length
        times = min(left[length] // n for length, n in combination.items())
        plan.append((combination, times))
        for length, n in combination.items():
            left[length] -= n * times
        order = [length for length in order if left[length]]
    return plan


def _segments(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length: rows (first number, how many in a bin, first bin, first offset), by first number."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    first_bin = 0
    for combination, times in plan:
        offset = 0
        for length, n in combination.items():
            rows.setdefault(length, []).append((used.get(length, 0), n, first_bin, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        first_bin += times
    return {length: np.array(r, dtype=np.int64) for length, r in rows.items()}


def numbering_cells(sized: DataFrame, length: str, order: tuple[str, ...], widths: dict[int, int], cell: str = "cell") -> DataFrame:
    """``sized`` with ``cell``: one of ``widths[length]`` groups in which a length's pieces are numbered.

    The cell is a hash of ``order``; pieces equal in it and the length that are
    more than CELL_ROWS are interchangeable and dealt one by one.
    """
    spark = sized.sparkSession
    width, key, hot, number = free_names(sized, "_cells", "_order", "_hot", "_row")
    same = F.xxhash64(length, *order)
    often = materialize(sized.groupBy(same.alias(hot)).agg(F.count("*").alias(number)).filter(F.col(number) > CELL_ROWS).select(hot))
    spread = sized.withColumn(key, F.xxhash64(*order))
    if not often.isEmpty():
        numbered = spread.withColumn(number, F.monotonically_increasing_id())
        # written, as cells are counted and numbered in two reads that must see the same row numbers
        spread = materialize(numbered.join(broadcast_if_small(often, BROADCAST_HOT), same == F.col(hot), "left")
                             .withColumn(key, F.when(F.col(hot).isNull(), F.col(key)).otherwise(F.col(number))).drop(number, hot))
    width_frame = spark.createDataFrame(list(widths.items()) or [(0, 1)], f"`{length}` long, `{width}` long")
    return (spread.join(F.broadcast(width_frame), length)  # one row a length: at most capacity rows
            .withColumn(cell, F.pmod(F.col(key), F.col(width))).drop(width, key))


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length",
                  order: tuple[str, ...] = ("doc_id", "piece", "start")) -> DataFrame:
    """Adds ``sequence_id`` (0, 1, ...) and ``offset`` (place in it, gapless from 0).

    ``pieces`` is read four times: pass a table or a checkpointed frame.
    Rows tied in ``order`` and length are interchangeable only if equal, so
    name enough columns.  Null or zero lengths take no place: both columns are
    null.  A length above ``capacity`` raises ``ValueError``.  Columns of the
    caller named ``sequence_id`` or ``offset`` are replaced by the new ones; all
    others stay, whatever their names.
    """
    pieces = pieces.drop("sequence_id", "offset")
    cell, before, number, spot = free_names(pieces, "_cell", "_before", "_n", "_p")
    sized = pieces.filter(F.col(length) > 0)
    counts = {r[0]: r[1] for r in sized.groupBy(length).count().collect()}  # at most capacity rows, or an error
    segments = _segments(minimum_bin_slack(counts, capacity))
    cells = {n: min(MAX_CELLS, -(-c // CELL_ROWS)) for n, c in counts.items()}
    keyed = numbering_cells(sized, length, order, cells, cell)
    starts = keyed.groupBy(length, cell).agg(F.count("*").alias(number)).withColumn(
        before, F.sum(number).over(Window.partitionBy(length).orderBy(cell)) - F.col(number)).drop(number)
    numbered = (keyed.withColumn(number, F.row_number().over(Window.partitionBy(length, cell).orderBy(*order)) - 1)
                .join(starts, [length, cell])
                .withColumn(number, F.col(number) + F.col(before)))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(lengths: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        sequence = np.zeros(len(lengths), np.int64)
        offset = np.zeros(len(lengths), np.int64)
        sizes, n = lengths.to_numpy(), numbers.to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            seg = segments[int(size)]
            s = seg[np.searchsorted(seg[:, 0], n[at], side="right") - 1]
            k = n[at] - s[:, 0]
            sequence[at] = s[:, 2] + k // s[:, 1]
            offset[at] = s[:, 3] + (k % s[:, 1]) * size
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = (numbered.withColumn(spot, place(F.col(length), F.col(number)))
              .select(*pieces.columns, F.col(f"{spot}.sequence_id").alias("sequence_id"), F.col(f"{spot}.offset").alias("offset")))
    unsized = pieces.filter(F.col(length).isNull() | (F.col(length) <= 0))
    return placed.unionByName(unsized.withColumn("sequence_id", F.lit(None).cast("long"))
                              .withColumn("offset", F.lit(None).cast("long")))


def assemble(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``length``, ``ids`` of packed pieces that carry ``ids``.

    A group is one sequence, so at most ``capacity`` tokens.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return (packed.filter(F.col("sequence_id").isNotNull()).groupBy("sequence_id").agg(parts.alias("_parts"))
            .select("sequence_id",
                    F.aggregate("_parts.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("length"),
                    F.aggregate("_parts.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids")))
