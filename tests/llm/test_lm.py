from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from churnscope.llm import lm
from churnscope.llm.common import documents
from tests.conftest import SF_SMALL
from tests.llm import helpers


def held(i) -> bool:
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def plain_base(rows):
    words = lambda t: (t or "").encode().lower().split() + [b""]
    counts: Counter = Counter()
    for i, t in rows:
        if not held(i):
            counts.update(words(t))
    n, v = sum(counts.values()), len(counts)
    return n, [(i, held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)),
                sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for i, t in rows]


def check_base(rows, got):
    n, want = plain_base(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[4])
    assert {r.train_tokens for r in got} == {n}
    for a, b in zip(sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score) for r in got), key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)


def test_base_scores_are_exact_whatever_every_task_knows(spark):
    docs = helpers.odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for known in (lm.KNOWN, 40):
        check_base(rows, lm.score_texts(docs, known=known).collect())


def test_the_model_beats_the_counts_on_held_out_texts(spark):
    got = [r for r in lm.score_texts(documents(spark, SF_SMALL)).collect()]
    held_out = [r for r in got if r.held_out]
    assert sum(r.score for r in held_out) > sum(r.base_score for r in held_out)


def network(seed=1, own=200):
    counts = np.zeros(lm.CLASSES * lm.CLASS_WORDS)
    counts[:own] = np.arange(own, 0, -1)
    return lm.Network.start(counts, np.arange(lm.TAIL_CLASSES) + 1.0, seed)


def test_probabilities_sum_to_one():
    net = network()
    states = np.random.default_rng(0).standard_normal((3, lm.HIDDEN)).astype(np.float32)
    tokens = np.arange(lm.CLASSES * lm.CLASS_WORDS + lm.TAIL_CLASSES)
    for s in states:
        logs = net.log_probabilities(np.repeat(s[None], len(tokens), axis=0), tokens)
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_lanes_and_windows_give_each_document_its_own_likelihood():
    net, rng = network(), np.random.default_rng(4)
    docs = [rng.integers(0, 200, n).astype(np.int32) for n in (1, 2, 700, 33, 32, 64, 1500, 5, 90)]
    got = lm.score_documents(net, docs)
    for d, total in zip(docs, got, strict=True):
        h, log = np.zeros((1, lm.HIDDEN), np.float32), 0.0
        for t, token in enumerate(d):
            if t:
                h = net.run(h, d[None, t - 1:t], np.zeros((1, 1), bool))[-1]
            log += net.log_probabilities(h, np.array([token]))[0]
        assert total == pytest.approx(log / math.log(10), rel=1e-4)


def test_gradients_match_differences():
    net, rng = network(), np.random.default_rng(5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    tokens, fresh = rng.integers(0, 200, (6, 3)), np.zeros((6, 3), bool)
    fresh[0, :] = fresh[3, 1] = True
    targets = np.concatenate([rng.integers(0, 200, 16), [lm.CLASSES * lm.CLASS_WORDS + 3, 1]])
    h0 = np.zeros((3, lm.HIDDEN))

    def run64(trace=None):
        out = np.empty((6, 3, lm.HIDDEN))
        h = h0
        for t in range(6):
            own = [] if trace is None else trace
            h = net.run(h, tokens[t:t + 1], fresh[t:t + 1], own)[0].astype(np.float64)
            out[t] = h
        return out

    def loss():
        return -net.log_probabilities(run64().reshape(18, -1), targets).sum()

    trace: list = []
    gradients: dict = {}
    net.log_probabilities(run64(trace).reshape(18, -1), targets, gradients)
    d_recurrent, d_inputs = net.backward(trace, tokens, fresh, gradients["states"].reshape(6, 3, -1))
    for name, at, want in [("recurrent", (2, 5), d_recurrent[2, 5]), ("recurrent", (7, 40), d_recurrent[7, 40]),
                           ("classes", (1, 0), gradients["classes"][1, 0]), ("class_bias", (0,), gradients["class_bias"][0])]:
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()
        net.p[name][at] = old - 1e-3
        down = loss()
        net.p[name][at] = old
        assert (up - down) / 2e-3 == pytest.approx(want, rel=0.05, abs=0.02), name


def test_no_documents_and_no_training_documents(spark):
    assert lm.score_texts(helpers.no_documents(spark)).collect() == []
    only_held = [r for r in helpers.awkward_rows() if held(r[0])]
    got = lm.score_texts(helpers.documents(spark, only_held)).collect()
    assert len(got) == len(only_held) and all(abs(r.base_score) < 1e-9 and r.n_known == 0 and r.train_tokens == 0 for r in got)


def test_the_network_learns_from_every_training_document(spark):
    rows = [(k, f"own{k} text of {k}") for k in range(40) if not held(k)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "cast(text as binary) raw").coalesce(1)
    words = lm.vocabulary(lm.count_words(texts))
    start = lm.Network.start(words.own_counts, words.tail_tokens)
    learned = lm.train_network(texts, words)
    fed = [words.known[f"own{k}".encode()][0] for k, _ in rows]
    assert all((learned.p["inputs"][n] != start.p["inputs"][n]).any() for n in fed)


def test_scores_do_not_depend_on_the_tables_partitions(spark):
    docs = helpers.odd_documents(spark)
    by_split = [sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.base_score), r.score) for r in lm.score_texts(docs.repartition(n)).collect())
                for n in (1, 5)]
    for a, b in zip(*by_split, strict=True):
        assert a[1] == pytest.approx(b[1], rel=1e-6)


def test_exponents_are_taken_for_many_classes_at_once(monkeypatch):
    net, rng = network(own=lm.CLASSES * lm.CLASS_WORDS), np.random.default_rng(6)
    net.p["word_bias"] = rng.standard_normal((lm.CLASSES, lm.CLASS_WORDS)).astype(np.float32)
    targets = np.concatenate([rng.integers(0, 64, 300), rng.integers(0, lm.CLASSES * lm.CLASS_WORDS + lm.TAIL_CLASSES, 500)])
    states, calls, exp = rng.standard_normal((800, lm.HIDDEN)).astype(np.float32), [], np.exp
    monkeypatch.setattr(np, "exp", lambda *a, **k: calls.append(1) or exp(*a, **k))
    gradients: dict = {}
    logs = net.log_probabilities(states, targets, gradients)
    monkeypatch.undo()
    assert len(calls) == 2  # the classes, the words in them
    everything = np.exp(states @ net.p["classes"] + net.p["class_bias"])
    everything /= everything.sum(axis=1, keepdims=True)
    for c in range(lm.CLASSES):
        mine = targets // lm.CLASS_WORDS == c
        inside = np.exp(states[mine] @ net.p["words"][c] + net.p["word_bias"][c])
        inside /= inside.sum(axis=1, keepdims=True)
        own = np.eye(lm.CLASS_WORDS)[targets[mine] % lm.CLASS_WORDS]
        assert logs[mine] == pytest.approx(np.log(everything[mine, c] * (inside * own).sum(axis=1)), abs=1e-4)
        assert gradients["words"][c] == pytest.approx(states[mine].T @ (inside - own), abs=1e-4)
        assert gradients["word_bias"][c] == pytest.approx((inside - own).sum(axis=0), abs=1e-4)


def test_runs_of_classes_hold_every_class_once():
    sizes = [5, 0, 3000, 1, 2047, 0, 2, 2046]
    bounds = np.append(0, np.cumsum(sizes)).tolist()
    runs = list(lm._runs([c for c, n in enumerate(sizes) if n], bounds, 2048))
    assert runs == [[0], [2], [3, 4], [6, 7]]
    assert list(lm._runs([], bounds, 2048)) == []
