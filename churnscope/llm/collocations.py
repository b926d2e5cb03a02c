"""Phrase collocation mining with mergeable Misra-Gries summaries.

First pass: n-grams of one to four words are hashed per language, counted
inside slices of text and dealt to hash partitions.  Each partition merges its
slices' counts into a Misra-Gries summary, whose capacity exceeds the
partition's mass divided by the threshold: whenever it holds more keys, the
count of the first one beyond the capacity is taken from all, so every unit
lost costs more than capacity units of mass.  What a key may have lost is known
and stays below the threshold, so every frequent n-gram survives, in memory
that does not depend on how many different n-grams there are.

Second pass: the n-grams whose hash survived are counted exactly, by their
words.  A collision of hashes only adds a key that the exact count drops, so
many survivors go to the tasks as a Bloom filter, and very many in several
passes; n-grams that did not survive are not shuffled.

Phrases are scored at their weakest cut; parts of a frequent phrase are
frequent, so their counts are at hand.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.llm.common import in_slices, materialize

LONGEST = 4                 # words of a phrase at most
LEAST = 30                  # occurrences of a phrase at least
TOP = 2000                  # phrases reported per language
CONTAINED = (80, 100)       # a phrase goes if a longer one around it has this share of its occurrences
SCALE = 2_000_000
SLICE_WORDS = 500_000       # words whose n-grams are counted together before they are dealt out
CHUNK_BYTES = 1 << 22       # longer texts are cut into words part by part
PARTITION_BYTES = 12 << 20  # text whose n-grams make up one hash partition, on average
SLACK = 4                   # capacity, as a multiple of the least that keeps every frequent n-gram
MERGE_KEYS = 1_000_000      # keys that a summary takes in at a time
BROADCAST_KEYS = 4_000_000  # survivors (8 bytes each) up to this many go to every task; more as a filter of the same size
FILTER_BITS = 16            # of a survivor in the filter: of the n-grams that did not survive 1 in 200 passes it
PASSES = 8                  # over the texts, each with a filter for a range of hash partitions; beyond, survivors are joined by shuffle
SPREAD = 64

_BREAK = b"."
# A-Z lowered; signs that end a piece become the break, tabs spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
_LOW = np.uint64(0xFFFFFF)  # a key's bits: several for every n-gram of a partition, which holds PARTITION_BYTES of text at any size of table
_ESCAPE = 0xFFFF
_PROBES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def _chunks(raw: bytes) -> Iterator[bytes]:
    """The text in parts of about ``CHUNK_BYTES``, cut between words."""
    at = 0
    while len(raw) - at > CHUNK_BYTES:
        cut = raw.rfind(b" ", at, at + CHUNK_BYTES)
        cut = cut if cut > at else raw.find(b" ", at + CHUNK_BYTES)
        if cut < 0:
            break
        yield raw[at:cut]
        at = cut
    yield raw[at:]


@dataclass
class _Slice:
    """Words in order, with breaks between pieces and documents; the first ``seen`` were counted by the slice before."""

    words: list[bytes]
    langs: list[tuple[str, int]]  # language and how many of the words, in order
    seen: int

    def __post_init__(self) -> None:
        from xxhash import xxh64_intdigest

        codes = {word: n for n, word in enumerate(dict.fromkeys(self.words))}
        self.ids = np.fromiter(map(codes.__getitem__, self.words), np.int64, len(self.words))
        self.hashes = np.fromiter(map(xxh64_intdigest, codes), np.uint64, len(codes))[self.ids] if codes else np.empty(0, np.uint64)
        self.is_break = self.ids == codes.get(_BREAK, -1)
        names = list(dict.fromkeys(lang for lang, _ in self.langs))
        number = {lang: n for n, lang in enumerate(names)}
        self.names = names
        self.lang = np.repeat(np.array([number[lang] for lang, _ in self.langs], np.int64), [n for _, n in self.langs])
        self.lang_hash = np.array([xxh64_intdigest(lang.encode(), 1) for lang in names], np.uint64)[self.lang] if names else self.hashes

    def ngrams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, first words' places, hashes) of all n-grams of each size."""
        n_words = len(self.ids)
        breaks = np.where(self.is_break, np.arange(n_words), n_words)
        next_break = np.minimum.accumulate(breaks[::-1])[::-1]
        value = self.lang_hash.copy()
        for size in range(1, longest + 1):
            if size > n_words:
                return
            value = (value[:n_words - size + 1] ^ self.hashes[size - 1:]) * _MIX
            value ^= value >> _STEP
            place = np.flatnonzero((next_break[:len(value)] >= np.arange(len(value)) + size)
                                   & (np.arange(len(value)) + size > self.seen))
            yield size, place, value[place]

    def phrase(self, place: int, size: int) -> str:
        return b" ".join(self.words[place:place + size]).decode()


def _slices(batches: Iterator[pa.RecordBatch], slice_words: int) -> Iterator[_Slice]:
    """Slices of rows (lang, text as UTF-8); a text may go over several."""
    words: list[bytes] = []
    langs: list[tuple[str, int]] = []
    seen = 0
    for batch in in_slices(batches, 200):
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for chunk in _chunks(raw.translate(_FOLD)):
                own = chunk.replace(_BREAK, b" . ").split()
                words += own
                langs.append((lang, len(own)))
                if len(words) + len(langs) >= slice_words:
                    yield _Slice(words, langs, seen)
                    last = words[-(LONGEST - 1):] if LONGEST > 1 else []
                    last = last[max((k + 1 for k, w in enumerate(last) if w == _BREAK), default=0):]
                    words, langs, seen = last, [(lang, len(last))], len(last)
            words.append(_BREAK)
            langs.append((lang, 1))
    if words:
        yield _Slice(words, langs, seen)


def _code(hashes: np.ndarray, partitions: int) -> np.ndarray:
    """Hash partition (from the high bits, never falling as hashes rise) and, as low half, the key in it."""
    return (hashes >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32) << np.uint64(32) | hashes & _LOW


def _packed(keys: np.ndarray) -> bytes:
    """Rising keys as 2-byte steps, larger ones behind escapes; as they are where that is shorter.  The last byte tells which."""
    steps = np.diff(keys.astype(np.int64), prepend=0)
    escapes = steps // _ESCAPE
    if 2 * (len(keys) + int(escapes.sum())) >= 4 * len(keys):
        return keys.astype("<u4").tobytes() + b"k"
    out = np.full(len(keys) + int(escapes.sum()), _ESCAPE, "<u2")
    out[np.cumsum(escapes + 1) - 1] = steps - escapes * _ESCAPE
    return out.tobytes() + b"s"


def _unpacked(raw: bytes) -> np.ndarray:
    if raw[-1:] == b"k":
        return np.frombuffer(raw[:-1], "<u4")
    steps = np.frombuffer(raw[:-1], "<u2")
    return np.cumsum(steps, dtype=np.uint32)[steps != _ESCAPE]


class _Listed:
    """Survivors as sorted codes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes

    def among(self, codes: np.ndarray) -> np.ndarray:
        """Places of those of ``codes`` that are listed."""
        if not len(self.codes):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.flatnonzero(self.codes[at] == codes)


class _Filter:
    """A Bloom filter of the survivors of the hash partitions from ``low`` to below ``high``."""

    def __init__(self, parts: Iterable[np.ndarray], n: int, low: int, high: int) -> None:
        self.low, self.high, self.n_bits = np.uint64(low), np.uint64(high), np.uint64(max(64, FILTER_BITS * n))
        self.bits = np.zeros(int(self.n_bits) // 8 + 1, np.uint8)
        for codes in parts:
            for probe in _PROBES:
                at = self._places(codes, probe)
                np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def _places(self, codes: np.ndarray, probe: np.uint64) -> np.ndarray:
        mixed = (codes ^ codes >> np.uint64(31)) * probe
        mixed = (mixed ^ mixed >> np.uint64(30)) * _PROBES[0]
        return (mixed >> np.uint64(32)) * self.n_bits >> np.uint64(32)

    def among(self, codes: np.ndarray) -> np.ndarray:
        """Places of those of ``codes`` in the range that are survivors, and of few others of the range."""
        part = codes >> np.uint64(32)
        found = np.flatnonzero((part >= self.low) & (part < self.high))
        for probe in _PROBES:
            at = self._places(codes[found], probe)
            found = found[self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) != 0]
        return found


class Summary:
    """A Misra-Gries summary: at most ``capacity`` keys; no count is too high, or too low by more than ``lost``."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        """Takes in another summary (exact counts have lost nothing)."""
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.lost += lost
        if len(self.keys) > self.capacity:
            beyond = len(self.keys) - self.capacity - 1
            taken = int(np.partition(self.counts, beyond)[beyond])
            self.lost += taken
            self.counts = self.counts - taken
            left = self.counts > 0
            self.keys, self.counts = self.keys[left], self.counts[left]

    def possibly(self, least: int) -> np.ndarray:
        """Keys whose true count may reach ``least``: all that do, and some more."""
        return self.keys[self.counts + self.lost >= least]


def survivors(texts: DataFrame, least: int, longest: int, partitions: int, slice_words: int = SLICE_WORDS, slack: int = SLACK) -> DataFrame:
    """``part, n, lost, keys``: per hash partition the keys (sorted, 4 bytes each) of n-grams that may occur ``least`` times."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _slices(batches, slice_words):
            code = np.sort(_code(np.concatenate([np.empty(0, np.uint64), *(h for _, _, h in own.ngrams(longest))]), partitions))
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])[:len(code)])
            counts = np.diff(np.append(first, len(code)))
            code = code[first]
            part, keys = (code >> np.uint64(32)).astype(np.int64), (code & _LOW).astype("<u4")
            parts = np.flatnonzero(np.bincount(part, minlength=1)) if len(part) else np.empty(0, np.int64)
            rows: tuple[list, ...] = ([], [], [])
            for low, high in zip(np.searchsorted(part, parts), np.searchsorted(part, parts, "right"), strict=True):
                once = counts[low:high] == 1
                rows[0].append(_packed(keys[low:high][once]))
                rows[1].append(_packed(keys[low:high][~once]))
                rows[2].append(counts[low:high][~once].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), *(pa.array(r, pa.binary()) for r in rows)],
                                             names=["part", "once", "keys", "counts"])

    def merged(rows: pa.Table) -> pa.Table:
        once, more, counts = (rows[c].to_pylist() for c in ("once", "keys", "counts"))
        mass = sum(len(_unpacked(k)) for k in once) + sum(int(np.frombuffer(c, "<i8").sum()) for c in counts)
        summary = Summary(slack * (mass // least) + 1)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(len(once)):
            single, several = _unpacked(once[n]), _unpacked(more[n])
            waiting += [(single, np.ones(len(single), np.int64)), (several, np.frombuffer(counts[n], "<i8"))]
            if n == len(once) - 1 or sum(len(k) for k, _ in waiting) >= MERGE_KEYS:
                summary.merge(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                waiting = []
        if summary.lost >= least:
            raise ValueError("the summary was too small")
        keys = summary.possibly(least)
        return pa.Table.from_arrays([pa.array([rows["part"][0].as_py()], pa.int32()), pa.array([len(keys)], pa.int64()),
                                     pa.array([summary.lost], pa.int64()), pa.array([keys.astype("<u4").tobytes()], pa.binary())],
                                    names=["part", "n", "lost", "keys"])

    rows = texts.mapInArrow(dealt, "part int, once binary, keys binary, counts binary")
    return rows.groupBy("part").applyInArrow(merged, "part int, n long, lost long, keys binary")


def _counted(texts: DataFrame, longest: int, partitions: int, slice_words: int, known: _Listed | _Filter | None,
             with_words: bool = True) -> DataFrame:
    """``code, lang, phrase, n`` per slice, of the n-grams whose code is in ``known`` (None: of all); a null phrase counts words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _slices(batches, slice_words):
            fresh = (np.arange(len(own.ids)) >= own.seen) & ~own.is_break
            totals = np.bincount(own.lang[fresh], minlength=len(own.names))
            codes, langs, phrases, counts = [np.empty(0, np.int64)], [], [], [np.empty(0, np.int64)]
            if with_words:
                codes, langs, phrases, counts = [np.full(len(own.names), -1)], [*own.names], [None] * len(own.names), [totals]
            for size, place, hashes in own.ngrams(longest):
                code = _code(hashes, partitions)
                if known is not None:
                    found = known.among(code)
                    place, code = place[found], code[found]
                # n-grams are told apart by their words, not by their hash
                key = own.ids[place]
                for k in range(1, size):
                    key = np.unique(key, return_inverse=True)[1] * (own.ids.max() + 1) + own.ids[place + k]
                key = np.unique(key, return_inverse=True)[1] * len(own.names) + own.lang[place]
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                codes.append(code[first].astype(np.int64))
                langs += [own.names[k] for k in own.lang[place[first]]]
                phrases += [own.phrase(p, size) for p in place[first].tolist()]
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(codes), pa.int64()), pa.array(langs, pa.string()), pa.array(phrases, pa.string()),
                 pa.array(np.concatenate(counts), pa.int64())], names=["code", "lang", "phrase", "n"])

    return texts.mapInArrow(run, "code long, lang string, phrase string, n long")


def _blocks(sizes: dict[int, int], partitions: int, most: int) -> list[tuple[int, int, int]]:
    """Ranges of hash partitions (first, beyond the last, survivors) of at most ``most`` survivors, or of one partition."""
    blocks, low, held = [], 0, 0
    for part in range(partitions):
        n = sizes.get(part, 0)
        if held and held + n > most:
            blocks.append((low, part, held))
            low, held = part, 0
        held += n
    return [*blocks, (low, partitions, held)]


def frequent_ngrams(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, slice_words: int = SLICE_WORDS,
                    partition_bytes: int = PARTITION_BYTES, slack: int = SLACK, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``lang, phrase, n``: exact counts of all n-grams of up to ``longest`` words that occur ``least`` times in a language.

    A null phrase tells all words of the language, however rare.  Needs ``lang``
    (null: ``und``) and ``text`` (null: empty); every row counts, repeated ones
    too; other columns are ignored.
    """
    if not 1 <= longest <= LONGEST:
        raise ValueError(f"phrases have 1 to {LONGEST} words")
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.cast("binary").alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(1, -(-n_bytes // partition_bytes))
    kept = materialize(survivors(texts, least, longest, partitions, slice_words, slack))
    sizes = {r["part"]: r["n"] for r in kept.select("part", "n").collect()}

    def codes_of(low: int, high: int) -> Iterator[np.ndarray]:
        for r in kept.filter(F.col("part").between(low, high - 1)).select("part", "keys").sort("part").collect():
            yield np.uint64(r["part"]) << np.uint64(32) | np.frombuffer(bytes(r["keys"]), "<u4").astype(np.uint64)

    blocks = _blocks(sizes, partitions, broadcast_keys * 64 // FILTER_BITS)
    if sum(sizes.values()) <= broadcast_keys:
        codes = _Listed(np.concatenate([np.empty(0, np.uint64), *codes_of(0, partitions)]))
        rows = _counted(texts, longest, partitions, slice_words, codes)
    elif len(blocks) <= PASSES:
        rows = reduce(DataFrame.unionByName, (
            _counted(texts, longest, partitions, slice_words, _Filter(codes_of(low, high), n, low, high), low == 0) for low, high, n in blocks))
    else:
        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_slices(batches, 1):
                part, keys = batch.column(0)[0].as_py(), np.frombuffer(batch.column(1)[0].as_py(), "<u4")
                yield pa.RecordBatch.from_arrays([pa.array((part << 32) + keys.astype(np.int64))], names=["code"])

        codes = kept.select("part", "keys").mapInArrow(listed, "code long")
        every = _counted(texts, longest, partitions, slice_words, None)
        rows = every.filter("phrase is null").unionByName(every.filter("phrase is not null").join(codes, "code", "left_semi").select(*every.columns))
    counts = rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("phrase").isNull() | (F.col("n") >= least))


def _part(first: Column, words: Column) -> Column:
    return F.array_join(F.slice(F.col("words"), first, words), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, **limits: Any) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language.

    Phrases have 2 to ``longest`` words of one piece and ``a >= least``
    occurrences; ``l`` and ``r`` are those of the parts at the cut with the
    lowest score (ties: the earliest), floor(2000000 a / (l + r)); ``n`` counts
    the language's words.  Phrases inside a longer frequent one that has at
    least 80 % of their occurrences are dropped.  Order: score and a falling,
    phrase by its bytes.  Languages without a phrase, and empty tables, have
    no row.  ``docs`` and ``limits``: see :func:`frequent_ngrams`.
    """
    counts = materialize(frequent_ngrams(docs, least, longest, **limits))
    words = counts.filter("phrase is null").select("lang", F.col("n").alias("n"))
    known = counts.filter("phrase is not null")
    phrases = (known.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
               .withColumn("size", F.size("words")).filter("size > 1"))

    at = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = at.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left"),
                     _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    scored = (cuts.withColumn("above", F.lit(SCALE).cast("decimal(10,0)") * exact("a")).withColumn("below", exact("l") + exact("r"))
              .withColumn("score", F.expr("above div below").cast("long"))
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))

    inside = (phrases.filter("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
              .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
              .select("lang", _part(F.col("k"), F.col("m")).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("around")))
    share, whole = (F.lit(x).cast("decimal(3,0)") for x in CONTAINED)
    # a missing longer phrase compares as null, which keeps the phrase
    covered = F.coalesce(whole * exact("around") >= share * exact("a"), F.lit(False))
    left = scored.join(inside, ["lang", "phrase"], "left").filter(~covered)
    rows = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # first in each of SPREAD parts of a language, then over what they leave
    parted = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)))
    for group in (["lang", "part"], ["lang"]):
        parted = parted.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= top)
    return parted.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = LEAST, longest: int = LONGEST, top: int = TOP, table: str = "documents") -> str:
    """The same in DuckDB SQL, every n-gram written out."""
    return f"""
with w as (
  select lang, piece, regexp_extract_all(p, '[^\\x20\\x09]+') as ws from (
    select coalesce(lang, 'und') as lang, row_number() over () as piece,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[.,;:!?\\x0A-\\x0D]')) as p from {table})),
n as (select lang, sum(len(ws))::bigint as n from w group by 1),
g as (select lang, m, unnest([array_to_string(ws[i:i + m - 1], ' ') for i in range(1, len(ws) - m + 2)]) as phrase
      from w, range(1, {longest} + 1) t(m)),
f as (select lang, m, phrase, count(*)::bigint as a from g group by 1, 2, 3 having count(*) >= {least}),
c as (select lang, phrase, a, m, string_split(phrase, ' ') as ws from f where m > 1),
k as (select lang, phrase, a, ws, m, unnest(range(1, m)) as k from c),
s as (select k.lang, k.phrase, k.a, k, x.a as l, y.a as r, ({SCALE}::hugeint * k.a::hugeint // (x.a::hugeint + y.a::hugeint))::bigint as score
      from k join f x on x.lang = k.lang and x.phrase = array_to_string(k.ws[1:k], ' ')
             join f y on y.lang = k.lang and y.phrase = array_to_string(k.ws[k + 1:k.m], ' ')),
b as (select *, row_number() over (partition by lang, phrase order by score, k) as nth from s),
i as (select lang, array_to_string(ws[j:j + q - 1], ' ') as phrase, max(a) as around
      from (select lang, ws, a, m, q, unnest(range(1, m - q + 2)) as j from c, range(2, {longest}) t(q) where q < m) group by 1, 2),
d as (select b.* from b left join i on i.lang = b.lang and i.phrase = b.phrase
      where nth = 1 and not coalesce({CONTAINED[1]}::hugeint * i.around >= {CONTAINED[0]}::hugeint * b.a, false)),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from d)
select o.lang, rank, phrase, a, l, r, n.n, score from o join n on n.lang = o.lang where rank <= {top}"""
