from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from churnscope.llm import packing
from churnscope.llm.common import documents
from tests.conftest import SF_SMALL
from tests.llm import helpers

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def words():
    return packing.WordTokenizer(PATH, known_words=500)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.text(alphabet=st.characters(codec="utf-8"), max_size=40)
       | st.text(alphabet="aÉßΣİKÅ\u0301.,' \n\t\x1c\u00a0<|endoftx>1", max_size=40)
       | st.lists(st.from_regex(r"[A-Za-zÀ-ÿ]{1,9}[.,]{0,2}", fullmatch=True), max_size=6).map(" ".join))
def test_ids_of_words_are_ids_of_the_text(tokenizer, words, text):
    assert words.plain
    got = np.frombuffer(words.text_ids(text), "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_the_given_texts(spark, tokenizer, words):
    for r in documents(spark, SF_SMALL).collect():
        assert np.frombuffer(words.text_ids(r.text), "<u4").tolist() == tokenizer.encode(r.text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), max_size=8))
def test_plan_uses_every_piece_once_and_fills_the_fullest(counts):
    plan = packing.minimum_bin_slack(counts, 20)
    left = dict(counts)
    for combination, times in plan:
        seed, room = max(left), 20 - max(left)
        assert combination[seed] >= 1 and times >= 1
        rest = [n for n, c in left.items() for _ in range(min(c - (n == seed), room // n))]
        best = max(s for s in _sums(rest) if s <= room)
        assert sum(n * c for n, c in combination.items()) == seed + best
        for n, c in combination.items():
            left[n] -= c * times
            assert left[n] >= 0
        left = {n: c for n, c in left.items() if c}
    assert not left


def _sums(items):
    reached = {0}
    for x in items:
        reached |= {r + x for r in reached}
    return reached


def test_lengths_beyond_the_capacity_are_refused():
    with pytest.raises(ValueError):
        packing.minimum_bin_slack({21: 1}, 20)


def test_small_bins_are_as_few_as_possible():
    sizes = [7, 6, 5, 5, 4, 3]  # fits 3 bins of 10 exactly
    plan = packing.minimum_bin_slack({n: sizes.count(n) for n in sizes}, 10)
    assert sum(times for _, times in plan) == 3


def test_documents_are_packed_whole_and_gapless(spark, tokenizer):
    docs = helpers.odd_documents(spark)
    pieces = packing.tokenize_pieces(docs, PATH, capacity=64).withColumn("crc", F.crc32("ids"))
    packed = packing.best_fit_pack(pieces, capacity=64, order=("doc_id", "piece", "crc")).collect()
    want = []
    for row in docs.collect():
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at:at + 64], "<u4").tobytes()
            want.append((row.doc_id, n, at, len(part) // 4, zlib.crc32(part)))
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.crc) for r in packed), key=order) == sorted(want, key=order)
    bins: dict[int, list] = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(w[3] for w in want) // 64) + 1
    sequences = packing.assemble(packing.best_fit_pack(pieces, capacity=64, order=("doc_id", "piece", "crc"))).collect()
    assert sorted(len(s.ids) // 4 for s in sequences) == sorted(sum(n for _, n in p) for p in bins.values())
    assert all(s.length * 4 == len(s.ids) for s in sequences)


def test_many_equal_lengths_are_numbered_in_cells(spark):
    rng = random.Random(2)
    rows = [(k, 0, 5 if k % 3 else rng.randint(1, 9)) for k in range(4000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    packed = packing.best_fit_pack(pieces, capacity=10, order=("doc_id",)).collect()
    places = {(r.sequence_id, r.offset + k) for r in packed for k in range(r.length)}
    assert len(places) == sum(r[2] for r in rows)
    first_fit: list[int] = []
    for size in sorted((r[2] for r in rows), reverse=True):
        at = next((k for k, used in enumerate(first_fit) if used + size <= 10), None)
        if at is None:
            first_fit.append(size)
        else:
            first_fit[at] += size
    assert len({r.sequence_id for r in packed}) <= len(first_fit)


def test_empty_table_and_pieces_without_length(spark):
    assert packing.best_fit_pack(packing.tokenize_pieces(helpers.no_documents(spark), PATH).drop("ids")).collect() == []
    odd = spark.createDataFrame([(1, 0, None), (2, 0, 0), (3, 0, 4)], "doc_id long, piece int, length long")
    got = {r.doc_id: (r.sequence_id, r.offset) for r in packing.best_fit_pack(odd, order=("doc_id",)).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (0, 0)}


def test_columns_named_like_the_operators_own(spark):
    own = ("_cell", "_cells", "_n", "_before", "_p", "_CELL_", "count")
    plain = spark.createDataFrame([(k, 0, k % 7 + 1) for k in range(300)], "doc_id long, piece int, length long")
    pieces = plain.withColumns({c: F.lit(k) for k, c in enumerate(own)} | {"offset": F.lit(-1)})
    packed = packing.best_fit_pack(pieces, capacity=10, order=("doc_id",))
    assert packed.columns == [*plain.columns, *own, "sequence_id", "offset"]  # a caller's offset is replaced
    rows = packed.collect()
    assert all(r[c] == k for r in rows for k, c in enumerate(own))
    want = packing.best_fit_pack(plain, capacity=10, order=("doc_id",)).collect()
    assert sorted((r.doc_id, r.sequence_id, r.offset) for r in rows) == sorted((r.doc_id, r.sequence_id, r.offset) for r in want)


def test_a_piece_repeated_many_times_is_numbered_in_many_cells(spark):
    rows = [(7 if k % 3 else k, 0, 5) for k in range(6000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long").repartition(4)
    packed = packing.best_fit_pack(pieces, capacity=10, order=("doc_id",)).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == 6000 and len({r.sequence_id for r in packed}) == 3000
    cells = packing.numbering_cells(pieces, "length", ("doc_id",), {5: 12}).groupBy("cell").count().collect()
    assert len(cells) == 12 and max(r["count"] for r in cells) < 1000


def test_known_words_are_not_looked_through_again(monkeypatch):
    words = packing.WordTokenizer(PATH, known_words=8)
    texts = ["One two, three.", "one\x1ctwo", "", "three. One", "four FIVE six seven 8", "a b c d e f g h i"]
    expected = [words.chain.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the memory is smaller than the last text's words
        assert [np.frombuffer(ids, "<u4").tolist() for ids in words.texts_ids(texts)] == expected
    words.texts_ids(texts[:1])
    monkeypatch.setattr(words, "_learn", lambda new: pytest.fail("no word is new"))
    assert [np.frombuffer(ids, "<u4").tolist() for ids in words.texts_ids([texts[0], texts[3], ""])] == [expected[0], expected[3], []]
