from __future__ import annotations

import math

import numpy as np

from churnscope.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, v string, ids string, size int"


def table(spark, rows):
    return ann.usable(spark.createDataFrame([(i, v, 0, "v", "i", 3) for i, v in rows], SCHEMA))


def brute(rows, k):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    good = list({(i, tuple(v)): (i, [float(np.float32(x)) for x in v]) for i, v in good}.values())
    out = {}
    for q, v in good:
        scored = sorted({(-ann.cosine(v, w), i) for i, w in good if i != q and len(w) == len(v)})
        out.setdefault(q, [(i, -s) for s, i in scored][:k])
    return out


def test_full_confidence_is_exact_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(12).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]                      # a crowd of equal vectors
    rows += [(2000, [0.0] * 12), (2001, None), (2002, [float("nan")] + [1.0] * 11), (2003, [None] + [1.0] * 11),
             (2004, [float("inf")] + [1.0] * 11), (2005, []), (None, [1.0] * 12), rows[3], (2006, [1.0, 2.0]), (2007, [2.0, 1.0])]
    vectors = table(spark, rows)
    got: dict = {}
    for r in ann.search(vectors, vectors, 5, confidence=1.1, block_rows=100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, 5)
    assert set(got) == {q for q, found in want.items() if found}
    for q, found in got.items():
        assert [s for _, s in found] == [s for _, s in want[q]] and [i for i, _ in found] == [i for i, _ in want[q]], q


def test_recall_of_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 64))
    rows = [(i, (centres[i % 30] + 0.7 * rng.standard_normal(64)).astype(np.float32).tolist()) for i in range(3000)]
    vectors = table(spark, rows)
    found = ann.search(vectors, vectors.filter("vec_id % 50 = 0")).collect()
    unit = np.array([v for _, v in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        similar = unit @ unit[q]
        similar[q] = -2
        hits += len(set(np.argsort(-similar)[:5].tolist()) & {r.vec_id for r in found if r.query_id == q})
    assert hits / (5 * 60) >= 0.9 and len(found) == 5 * 60


def test_chi_square_and_fewer_candidates_than_asked(spark):
    sample = (np.random.default_rng(3).standard_normal((20_000, 8)) ** 2).sum(axis=1)
    for x in (2.0, 7.3, 15.5):
        assert abs(ann.chi_square(x, 8) - (sample <= x).mean()) < 0.02
    few = table(spark, [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0])])
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.search(few, few.filter("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 3), (0, 2, 50)]
    none = table(spark, [])
    assert ann.search(none, none).collect() == []
