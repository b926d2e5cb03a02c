from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from churnscope.llm import quality
from churnscope.llm.common import documents, table
from tests.conftest import SF_MID
from tests.llm import helpers


def test_held_out_accuracy(spark):
    docs, labels = documents(spark, SF_MID), table(spark, SF_MID, "labels")
    rows = quality.score(docs, quality.fit_quality(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    bad = [r for r in held if r.quality == 0]
    good = [r for r in held if r.quality == 1]
    assert sum(r.predicted for r in good) / len(good) > 0.97 and 1 - sum(r.predicted for r in bad) / len(bad) > 0.9


def test_only_allowed_labels_and_texts_matter(spark):
    docs, labels = documents(spark, SF_MID), table(spark, SF_MID, "labels")
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = quality.score(docs, quality.fit_quality(docs, labels)).collect()
    other = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))
    b = quality.score(other, quality.fit_quality(other, turned)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_ratios_match_counting():
    good, bad = np.array([3, 0, 5]), np.array([1, 2, 0])
    ratios = quality.log_count_ratios(good, bad, 6, 2)
    want = [np.log(((g + 0.75) / 6) / ((b + 0.25) / 2)) for g, b in zip(good, bad, strict=True)]
    assert np.allclose(ratios, want, atol=1e-6)
    assert np.allclose(quality.log_count_ratios(np.zeros(3), np.zeros(3), 6, 2), 0)


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = random.Random(1)
    ratios = np.array([rng.uniform(-1, 1) for _ in range(12)], np.float32)
    rows = [np.array(sorted(rng.sample(range(12), rng.randint(1, 6)))) for _ in range(40)]
    labels = np.array([rng.random() < 0.5 + 0.4 * np.sign(ratios[r].sum()) for r in rows]).astype(int)
    weights, bias = quality.fit_hinge(rows, labels, ratios, c=0.5, epochs=3000)
    sign = np.where(labels == 1, 1, -1)
    cost = 0.5 * len(sign) / (2 * np.where(sign > 0, (sign > 0).sum(), (sign < 0).sum()))

    def loss(w, b):
        margins = np.array([quality.margin(r, ratios, w, b) for r in rows])
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - sign * margins)).sum()

    best = loss(weights, bias)
    for _ in range(300):
        step = np.random.default_rng(rng.randint(0, 10 ** 6)).standard_normal(13) * rng.choice([1e-3, 1e-2, 0.1])
        assert loss(weights + step[:12], bias + step[12]) >= best - 1e-6


def test_shapes():
    assert [quality.word_shape(w) for w in ("Abc,", "ABC!!", "it's", "2024-05", "é", "###")] == ["Aa,", "A!", "a'a", "0-0", "a", "#"]
    assert quality.word_shape("a1" * 40 + "!") == "a0" * 40 + "!"  # no sign is cut


def test_awkward_rows(spark):
    docs = helpers.odd_documents(spark)
    ids = [r.doc_id for r in docs.collect()]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(sorted({i for i in ids if i is not None}))]
                                   + [(0, None), (None, 1), (3, 1), (3, 0)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(ids) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    kept = quality.accept(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in rows)
    nothing = quality.fit_quality(helpers.no_documents(spark), labels)
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}
    one_class = quality.fit_quality(docs, labels.withColumn("quality", F.lit(1)))
    assert all(r.predicted == 1 for r in quality.score(docs, one_class).collect())
    assert quality.score(helpers.no_documents(spark), model).collect() == []
