"""Phrase mining against plain Python, and the summaries' guarantee."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from churnscope.llm import collocations as C
from churnscope.llm import queries
from churnscope.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm import helpers


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def plain(rows, least=30, top=2000):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            words[lang] += len(ws)
            for m in range(1, 5):
                counts[lang].update(tuple(ws[i:i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, every in counts.items():
        known = {p: a for p, a in every.items() if a >= least}
        found = []
        for p, a in known.items():
            if len(p) < 2:
                continue
            around = [b for q, b in known.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in around):
                continue
            score, _, left, right = min((2_000_000 * a // (known[p[:k]] + known[p[k:]]), k, known[p[:k]], known[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, n, p.decode(), -a, left, right, words[lang], -score) for n, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def got(rows):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rows.collect())


def texts(seed, rows=150):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Über", "the", "OF", "x\x00y", "日本", "a\x1cb", "-", " ", *(f"w{int(rng.paretovariate(0.7)) % 40}" for _ in range(3))])
    gap = lambda: rng.choice([" "] * 8 + ["\t", "  ", ". ", ",", "\n", "\x0b", ";x "])
    fixed = ["new york city hall", "as far as", "a b a b a b"]
    out = [(None, "one two. one two"), ("en", None), ("en", ""), (None, None), ("de", " \t .,;")]
    for _ in range(rows):
        parts = [word() + gap() if rng.random() < 0.85 else rng.choice(fixed) + gap() for _ in range(rng.randint(1, 60))]
        out.append((rng.choice(["en", "en", "en", "de", None, "und"]), "".join(parts)))
    return out + out[5:15]


def frame(spark, rows):
    return spark.createDataFrame([(n, t, lang, 3, "p", 1, 2, 3) for n, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, n long, phrase string, part int, a int, k int").repartition(3)


@pytest.mark.parametrize("least,limits", [
    (30, {}), (5, {"slice_words": 40, "partition_bytes": 700}), (3, {"slice_words": 7, "partition_bytes": 200, "slack": 1}),
    (4, {"broadcast_keys": 0, "slice_words": 300, "partition_bytes": 3000}), (1, {"slice_words": 500})])
def test_against_plain(spark, least, limits):
    rows = texts(least)
    assert got(C.collocations(frame(spark, rows), least=least, **limits)) == plain(rows, least) != []


def test_top_and_ties(spark):
    rows = texts(9)
    assert got(C.collocations(frame(spark, rows), least=3, top=7)) == plain(rows, 3, 7)


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BYTES", 50)
    raw = " ".join(t or "" for _, t in texts(11)).encode()
    assert b"".join(C._chunks(raw)) == raw and max(len(c.split()) for c in C._chunks(raw)) < 50
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([raw], pa.binary())], names=["lang", "text"])
    for slice_words in (5, 50, 10_000):
        seen = Counter()
        for own in C._slices(iter([batch]), slice_words):
            for size, place, _ in own.ngrams(4):
                seen.update(own.phrase(p, size) for p in place.tolist())
        want = Counter(" ".join(ws[i:i + m]) for ws in pieces(raw.decode()) for m in range(1, 5) for i in range(len(ws) - m + 1))
        assert seen == want


def test_every_frequent_key_survives():
    rng = np.random.default_rng(3)
    for slack in (1, 4):
        true, mass = Counter(), 0
        slices = []
        for _ in range(30):
            keys, counts = np.unique((rng.pareto(0.6, 3000) * 20).astype(np.int64) % 100_000, return_counts=True)
            slices.append((keys.astype(np.uint32), counts.astype(np.int64)))
            mass += counts.sum()
            true.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        least = 40
        capacity = slack * int(mass // least) + 1
        whole, halves = C.Summary(capacity), [C.Summary(capacity), C.Summary(capacity)]
        for n, part in enumerate(slices):
            whole.merge(*part)
            halves[n % 2].merge(*part)
        halves[0].merge(halves[1].keys, halves[1].counts, halves[1].lost)
        for summary in (whole, halves[0]):
            assert len(summary.keys) <= capacity and summary.lost * (capacity + 1) <= mass and summary.lost < least
            assert {k for k, n in true.items() if n >= least} <= set(summary.possibly(least).tolist())
            for key, n in zip(summary.keys.tolist(), summary.counts.tolist(), strict=True):
                assert n <= true[key] <= n + summary.lost
    assert whole.lost >= 0 and halves[1].lost >= 0


def test_awkward_and_empty_tables(spark):
    odd = helpers.odd_documents(spark)
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert got(C.collocations(odd, least=6)) == plain(rows, 6)
    assert C.collocations(helpers.no_documents(spark)).count() == 0


def test_scores_beyond_64_bits(spark):
    a = 9 * 10 ** 13
    counts = spark.createDataFrame([("en", None, 4 * a), ("en", "x", a + 1), ("en", "y", a), ("en", "x y", a)], "lang string, phrase string, n long")
    original = C.frequent_ngrams
    C.frequent_ngrams = lambda *args, **kw: counts
    try:
        assert got(C.collocations(counts)) == [("en", 1, "x y", a, a + 1, a, 4 * a, 2_000_000 * a // (2 * a + 1))]
    finally:
        C.frequent_ngrams = original


def test_query_against_plain(spark):
    rows = [(r["lang"], r["text"]) for r in table(spark, SF_SMALL, "documents").collect()]
    assert got(queries.QUERIES["op12_phrase_collocations"](spark, SF_SMALL)) == plain(rows)


def test_rising_keys_in_two_byte_steps():
    rng = np.random.default_rng(5)
    for keys in ([], [0], [5, 6], [2 ** 24 - 1], [0, 65534, 65535, 131070, 131071], np.unique(rng.integers(0, 1 << 24, 5000)), np.arange(0, 1 << 24, 65535),
                 np.arange(1000), np.unique(rng.integers(0, 1 << 24, 40))):
        keys = np.array(keys, np.uint32)
        assert C._unpacked(C._packed(keys)).tolist() == keys.tolist()
        assert len(C._packed(keys)) <= min(4 * len(keys), 2 * len(keys) + 512) + 1


def test_filter_keeps_its_range_and_few_others():
    rng = np.random.default_rng(6)
    code = lambda low, high, n: np.unique(rng.integers(low << 32, high << 32, n).astype(np.uint64))
    codes = code(3, 7, 5000)
    own = C._Filter(iter([codes[:2000], codes[2000:]]), len(codes), 3, 7)
    assert own.among(codes).tolist() == list(range(len(codes)))
    others = np.setdiff1d(code(3, 7, 50_000), codes)
    assert len(own.among(others)) < 0.02 * len(others)
    assert len(own.among(code(0, 3, 5000))) == len(own.among(code(7, 9, 5000))) == 0


def test_many_survivors_do_not_bring_the_others(spark, monkeypatch):
    """More survivors than may be listed in every task: only they, and few others, are rows of the second pass."""
    rng = random.Random(2)
    rare = lambda: f"r{rng.randrange(10 ** 9)}"
    rows = [("en", " ".join(f"f{rng.randrange(30)}" if k % 12 < 4 else rare() for k in range(600))) for _ in range(60)] + [(None, "f1 f2")]
    counted, made = C._counted, []
    monkeypatch.setattr(C, "_counted", lambda *args: made.append(counted(*args)) or made[-1])
    limits = {"partition_bytes": 100_000, "broadcast_keys": 100, "slice_words": 3000}
    assert got(C.collocations(frame(spark, rows), least=8, **limits)) == plain(rows, 8) != []
    shuffled = sum(f.filter("phrase is not null").select("phrase").distinct().count() for f in made)
    every = {w[i:i + m] for _, t in rows for w in [tuple(t.split())] for m in range(1, 5) for i in range(len(w) - m + 1)}
    assert len(made) > 1 and shuffled < 0.1 * len(every)
    assert made[0].filter("phrase is null").count() > 0 and not any(f.filter("phrase is null").count() for f in made[1:])
