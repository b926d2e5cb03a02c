from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from churnscope.llm import line_dedup, mixing, packing, quality, queries, simhash_dedup
from churnscope.llm.common import documents, table
from tests.conftest import SF_SMALL
from tests.llm import helpers
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_simhash_dedup import plain_fingerprint, plain_groups


def test_every_stage_against_plain_python(spark, tmp_path):
    docs = documents(spark, SF_SMALL)
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, SF_SMALL)
        out.write.parquet(path := str(tmp_path / name))
        docs_after = spark.read.parquet(path)
        after = [r.asDict() for r in docs_after.collect()]
        if number < 4:
            assert docs_after.columns == columns and after
        texts = {r["doc_id"]: r["text"] for r in after} if number < 4 else {}
        if name == "quality_classifier":
            model = quality.fit_quality(docs, table(spark, SF_SMALL, "labels"))
            scratch = np.zeros(quality.DIMENSION, bool)
            want = {r["doc_id"] for r in before if model.probability(quality.text_features(r["text"], {}, scratch)) >= 0.5}
            assert set(texts) == want and 0 < len(want) < len(before)
        elif name == "line_dedup":
            left = plain_lines([(r["doc_id"], r["text"]) for r in before], line_dedup.MIN_WORDS)
            want = {i: t for (i, source), t in left.items() if t or not source or t == source}
            assert {i: t for i, t in texts.items() if t} == {i: t for i, t in want.items() if t}
        elif name == "simhash_near_dedup":
            rows = sorted(before, key=lambda r: r["doc_id"])
            groups = plain_groups([plain_fingerprint(r["text"]) for r in rows], simhash_dedup.RADIUS)
            assert sorted(texts) == sorted({rows[g]["doc_id"] for g in groups})
        elif name == "mixing_sources":
            kept = {r.doc_id for r in mixing.sampled(docs, budget=corpus_pipeline.MIX_BUDGET).collect() if r.kept}
            assert set(texts) == kept and len(kept) < len(before)
        else:
            assert sum(r["length"] for r in after) >= len(before)
            by_sequence: dict[int, int] = {}
            for r in after:
                by_sequence[r["sequence_id"]] = by_sequence.get(r["sequence_id"], 0) + r["length"]
            assert max(by_sequence.values()) <= packing.CAPACITY
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
        docs = docs_after


def test_run_returns_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF_SMALL)
    assert rows.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0


@pytest.mark.parametrize("make", [helpers.odd_documents, helpers.no_documents])
def test_stages_take_awkward_and_empty_tables(spark, make, tmp_path):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_SMALL).write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
    assert (docs.count() > 0) == (make is helpers.odd_documents)


def test_registered_queries():
    named = __spark_entry__.queries()
    assert sorted(q for q in named if q.startswith("op")) == sorted(queries.QUERIES) and "pipeline" in named
    assert {int(q[2:].split("_")[0]) for q in queries.QUERIES} == set(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(named)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, duck, name):
    spark_rows = queries.QUERIES[name](spark, SF_SMALL).toPandas()
    sql_rows = duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(spark_rows.columns) == sorted(sql_rows.columns)
    columns = sorted(spark_rows.columns)
    as_rows = lambda frame: sorted(map(tuple, frame[columns].astype(str).to_numpy().tolist()))
    assert as_rows(spark_rows) == as_rows(sql_rows)
