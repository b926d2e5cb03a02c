from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from churnscope.llm import mixing
from tests.llm import helpers


def test_raked_margins_meet_their_targets(spark):
    rows = [(f"s{i}", f"l{j}", 10 + 7 * i * j + i) for i in range(4) for j in range(3)]
    cells = spark.createDataFrame(rows, "a string, b string, tokens long")
    wanted_a, wanted_b = {"s0": 0.1, "s1": 0.2, "s2": 0.3, "s3": 0.4}, {"l0": 0.5, "l1": 0.25, "l2": 0.25}
    of = lambda d, c: F.element_at(F.create_map(*(F.lit(x) for kv in d.items() for x in kv)), F.col(c))
    raked = mixing.rake(cells.withColumn("ta", of(wanted_a, "a")).withColumn("tb", of(wanted_b, "b")), ["a", "b"], ["ta", "tb"]).collect()
    for wanted, c in ((wanted_a, "a"), (wanted_b, "b")):
        for value, share in wanted.items():
            assert sum(r.weight for r in raked if r[c] == value) == pytest.approx(share, abs=1e-4)


def test_budget_and_sampling(spark):
    docs = helpers.documents(spark)
    rows = mixing.sampled(docs, budget=0.6).collect()
    total = sum(r.tokens for r in rows)
    assert sum(r.tokens * r.probability for r in rows) == pytest.approx(0.6 * total, rel=1e-6)
    assert all(0 <= r.probability <= 1 for r in rows)
    for r in rows:
        u = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) / 16 ** 13
        assert r.kept == (u < r.probability)
    kept = mixing.sample(docs, budget=0.6)
    assert kept.schema.fieldNames() == docs.schema.fieldNames()
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)
    assert {r.tokens for r in kept.collect()} == {"t"}  # a column of the caller's, as it was


def plain_probabilities(cells, margins, budget):
    """Raking with full cells held, in plain Python, the same rounds."""
    total = sum(cells.values())
    wanted = budget * total
    weight = {k: v / total for k, v in cells.items()}
    for _ in range(mixing.ROUNDS):
        for d, margin in enumerate(margins):
            for v, share in margin.items():
                mine = [k for k in cells if k[d] == v]
                have = sum(weight[k] for k in mine)
                for k in mine:
                    weight[k] = min(weight[k] * share / have, cells[k] / wanted) if have else 0.0
    scale = wanted
    for _ in range(5):
        full = [k for k in cells if weight[k] * scale >= cells[k] * (1 - 1e-9)]
        rest = sum(weight[k] for k in cells if k not in full)
        if rest:
            scale = (wanted - sum(cells[k] for k in full)) / rest
    return {k: min(1.0, weight[k] * scale / cells[k]) if cells[k] else 0.0 for k in cells}


def cells_of(rows):
    cells: dict = {}
    for r in rows:
        cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + r.tokens
    return cells


def tempered(cells, d):
    raised = {v: sum(t for k, t in cells.items() if k[d] == v) ** 0.5 for v in {k[d] for k in cells}}
    return {v: t / sum(raised.values()) for v, t in raised.items()}


def test_probabilities_are_those_of_plain_fitting(spark):
    docs = helpers.odd_documents(spark)
    for budget in (0.2, 0.5):
        got = mixing.sampled(docs, budget=budget).collect()
        cells = cells_of(got)
        want = plain_probabilities(cells, [tempered(cells, d) for d in range(3)], budget)
        for r in got:
            assert r.probability == pytest.approx(want[r.source, r.lang, r.topic], rel=1e-6, abs=1e-9)


def test_targets_of_the_caller_and_reached_shares(spark):
    docs = helpers.odd_documents(spark)
    targets = {"lang": {"en": 3, "de": 1, "xx": 5}, "source": {"a": 0.5, "b": 0.25, None: 0.25}}
    options = {"budget": 0.05, "targets": targets}
    got = mixing.sampled(docs, **options).collect()
    cells = cells_of(got)
    margins = [{"a": 0.5, "b": 0.25, "": 0.25}, {"en": 0.75, "de": 0.25, "": 0.0}, tempered(cells, 2)]
    want = plain_probabilities(cells, margins, 0.05)
    for r in got:
        assert r.probability == pytest.approx(want[r.source, r.lang, r.topic], rel=1e-6, abs=1e-9)
    told = {(r.dimension, r.value): (r.wanted, r.reached) for r in mixing.shares(docs, **options).collect()}
    total = sum(r.tokens * r.probability for r in got)
    for d, (name, margin) in enumerate(zip(mixing.DIMENSIONS, margins, strict=True)):
        for v, share in margin.items():
            reached = sum(cells[k] * want[k] for k in cells if k[d] == v) / total
            assert told[name, v] == (pytest.approx(share), pytest.approx(reached, abs=1e-6))
    assert told["lang", ""][1] == 0
    with pytest.raises(ValueError, match="no dimensions"):
        mixing.sampled(docs, targets={"size": {"big": 1}})


def test_sums_joined_back_give_the_weights_of_windows(spark):
    rows = [(f"s{i}", f"l{j}", 10 + 7 * i * j + i, 0.25 * (i + 1) / 2.5, (3 - j) / 6, 0.2) for i in range(4) for j in range(3)]
    cells = spark.createDataFrame(rows, "a string, b string, tokens long, ta double, tb double, room double")
    by = {n: {(r.a, r.b): r.weight for r in mixing.rake(cells, ["a", "b"], ["ta", "tb"], rounds=4, window_cells=n).collect()} for n in (0, 100)}
    assert by[0] == pytest.approx(by[100])
    assert max(by[0].values()) <= 0.2


def test_columns_named_like_the_operators_own(spark):
    extra = {c: F.lit(k) for k, c in enumerate(("_p", "_tokens", "_d0", "d0", "t0", "c0", "tokens", "probability", "weight", "row", "id", "room", "have", "Probability2"))}
    docs = helpers.documents(spark).drop("tokens").withColumns(extra)
    kept = mixing.sample(docs, budget=0.6)
    assert kept.columns == docs.columns
    plain = {r.doc_id for r in mixing.sample(helpers.documents(spark), budget=0.6).collect()}
    rows = kept.collect()
    assert {r.doc_id for r in rows} == plain and all(r[c] == k for r in rows for k, c in enumerate(extra))


def test_a_given_topic_is_used_and_empty_tables_pass(spark):
    docs = helpers.documents(spark)
    assert {r.topic2 for r in mixing.sampled(docs, dimensions=("source", "topic2")).collect()} == {"x"}
    assert mixing.sampled(helpers.no_documents(spark)).collect() == []
    assert mixing.sample(helpers.no_documents(spark)).collect() == []
