from __future__ import annotations

import random
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from churnscope.llm import line_dedup
from tests.llm import helpers


def plain(rows: list[tuple[int, str | None]], min_words: int) -> dict:
    """All runs of at least min_words words that stand at an earlier place too go: the longest common run with every
    earlier equal line, written out."""
    lines = {(i, t): t.split("\n") for i, t in rows if t is not None}
    order = sorted(lines, key=lambda k: (k[0] is not None, k[0] or 0))
    places = [(key, n) for key in order for n in range(len(lines[key]))]
    equal: dict[str, list[int]] = defaultdict(list)
    for at, (key, n) in enumerate(places):
        equal[lines[key][n]].append(at)
    deleted = {k: set() for k in lines}
    behind: dict[int, int] = {}  # of the next line: lines it has in common from each earlier place on
    for at in range(len(places) - 1, -1, -1):
        key, n = places[at]
        own = lines[key]
        follows = behind if n + 1 < len(own) else {}
        behind = {q: 1 + (follows.get(q + 1, 0) if places[q][1] + 1 < len(lines[places[q][0]]) else 0)
                  for q in equal[own[n]] if q < at}
        longest = max(behind.values(), default=0)
        if sum(len(x.split()) for x in own[n:n + longest]) >= min_words and longest:
            deleted[key] |= set(range(n, n + longest))
    return {k: "\n".join(x for n, x in enumerate(own) if n not in deleted[k]) for k, own in lines.items()}


def check(spark, rows, min_words):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows, min_words)
    got = line_dedup.dedup_lines(docs, min_words).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        source = texts[r.doc_id]
        if source is None:
            assert r.text is None and r.n_lines == 0 and r.n_deleted == 0
            continue
        assert r.text == want[r.doc_id, source], r.doc_id
        assert r.n_lines == len(source.split("\n")) and r.n_deleted == sum(x.end - x.start + 1 for x in r.runs)


@pytest.mark.parametrize("min_words", [1, 4, 9, 50])
def test_awkward_texts_against_brute_force(spark, min_words):
    check(spark, [(r[0], r[1]) for r in helpers.awkward_rows()], min_words)


def test_random_lines_with_runs_inside_and_across_documents(spark):
    rng = random.Random(11)
    pool = ["", "a", "b b", "c c c", "d d d d", "common line here"]
    rows = []
    for k in range(80):
        own = [rng.choice(pool) if rng.random() < 0.7 else f"own {k} {n}" for n in range(rng.randint(1, 25))]
        rows.append((k, "\n".join(own)))
    rows += [(200 + k, rows[k][1]) for k in range(10)] + [(300 + k, "same\nsame\nsame\nsame\nsame") for k in range(3)]
    for min_words in (1, 6, 13):
        check(spark, rows, min_words)


def test_small_cells_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CELL", 3)
    rng = random.Random(12)
    rows = [(k, "\n".join(rng.choice("abcdef") + " x" for _ in range(12))) for k in range(30)]
    check(spark, rows, 5)


def test_suffix_array_orders_suffixes(spark):
    rows = [(0, "a\nb\nc\na\nb\nd"), (1, "b\nc\na"), (2, "a\nb\nc")]
    got = line_dedup.suffix_array(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    lines = {i: t.split("\n") for i, t in rows}
    rank_of_line = {lines[r.doc_id][r.pos]: r.levels[0] for r in got}
    depth = 2 ** (len(got[0].levels) - 1)
    key = {(r.doc_id, r.pos): [rank_of_line[x] for x in lines[r.doc_id][r.pos:r.pos + depth]
                               if x in rank_of_line] for r in got if lines[r.doc_id][r.pos] != "d"}
    ordered = sorted((r for r in got), key=lambda r: r.r)
    keys = [key[r.doc_id, r.pos] for r in ordered]
    assert keys == sorted(keys)


def test_repeated_rows_and_null_ids_fare_alike(spark):
    docs = helpers.odd_documents(spark)
    rows = line_dedup.dedup_lines(docs, 20).collect()
    assert len(rows) == docs.count()
    seen: dict = {}
    first = {r.doc_id: r.text for r in line_dedup.dedup_lines(helpers.documents(spark), 20).collect()}
    for r in rows:
        seen.setdefault((r.doc_id, r.n_lines), set()).add(r.text)
    assert all(len(v) == 1 for v in seen.values())
    without_null = [r for r in rows if r.doc_id is not None and r.doc_id != 90]
    assert all(first[r.doc_id] == r.text for r in without_null)


def test_columns_stay_and_emptied_documents_go(spark):
    docs = helpers.documents(spark)
    kept = line_dedup.without_copies(docs, 20)
    assert kept.schema.fieldNames() == docs.schema.fieldNames()
    rows = {r.doc_id: r for r in kept.collect()}
    told = {r.doc_id: r for r in line_dedup.dedup_lines(docs, 20).collect()}
    gone = {i for i, r in told.items() if r.n_lines and r.n_deleted == r.n_lines}
    assert gone and set(rows) == set(told) - gone
    for i, r in rows.items():
        assert r.text == told[i].text and r.n_chars == (None if r.text is None else len(r.text)) and r.runs == "runs" and r.n == 1


def test_no_documents(spark):
    assert line_dedup.dedup_lines(helpers.no_documents(spark)).collect() == []
    assert line_dedup.without_copies(helpers.no_documents(spark)).collect() == []


def every_run(rows: list[tuple[int, str | None]], min_words: int) -> dict:
    """All runs of at least min_words words at every place, however long, first place kept."""
    lines = {(i, t): t.split("\n") for i, t in rows if t is not None}
    seen, left = set(), {}
    for key in sorted(lines, key=lambda k: (k[0] is not None, k[0] or 0)):
        own, deleted = lines[key], set()
        for start in range(len(own)):
            words = 0
            for end in range(start, len(own)):
                words += len(own[end].split())
                run = tuple(own[start:end + 1])
                if words >= min_words and run in seen:
                    deleted |= set(range(start, end + 1))
                elif words >= min_words:
                    seen.add(run)
        left[key] = "\n".join(x for n, x in enumerate(own) if n not in deleted)
    return left


def test_last_lines_of_a_repeated_run_go_too(spark):
    passage = "\n".join(" ".join(f"w{k}x{n}" for n in range(words)) for k, words in enumerate((60, 20, 15)))
    rows = [(1, passage), (2, f"own line\n{passage}\nanother own line"), (3, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: passage, 2: "own line\nanother own line", 3: ""}
    assert {r.doc_id for r in line_dedup.without_copies(docs).collect()} == {1, 2}


@pytest.mark.parametrize("min_words", [1, 6, 13])
def test_every_run_against_brute_force(spark, min_words):
    rng = random.Random(13)
    pool = ["", "a", "b b", "c c c", "d d d d", "common line here"]
    rows = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"own {k} {n}" for n in range(rng.randint(1, 25)))) for k in range(80)]
    rows += [(200 + k, rows[k][1]) for k in range(10)] + [(300 + k, "same\nsame\nsame\nsame\nsame") for k in range(3)]
    want = every_run(rows, min_words)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words).collect()
    assert {(r.doc_id, r.text) for r in got} == {(i, text) for (i, _), text in want.items()}


def test_windows_over_all_rows_meet_few_cells(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CELL", 3)
    monkeypatch.setattr(line_dedup, "MAX_CELLS", 4)
    cells, count_before = [], line_dedup._count_before

    def counted(rows, group, cell, order, value):
        if not group:
            cells.append(rows.select(cell.alias("cell")).distinct().count())
        return count_before(rows, group, cell, order, value)

    monkeypatch.setattr(line_dedup, "_count_before", counted)
    short = "\n".join(f"short {k}\nown {{0}} {k}" for k in range(60))
    runs = "\n".join(f"own {{0}} run {n}\n" + " ".join(f"w{n}x{k}" for k in range(50)) for n in range(10))
    rows = [(i, f"{short}\n{runs}".replace("{0}", str(i))) for i in (1, 2)]
    assert line_dedup.later_copies(spark.createDataFrame(rows, "doc_id long, text string")).count() == 10
    assert cells and max(cells) <= line_dedup.MAX_CELLS


def test_columns_named_like_the_operators_own(spark):
    own = ("_runs", "_key", "_doc", "_text_key", "_deleted", "_lines", "_id", "row", "pos", "upto", "n_deleted")
    plain = helpers.odd_documents(spark)
    docs = plain.withColumns({c: F.lit(k) for k, c in enumerate(own)})
    kept = line_dedup.without_copies(docs, 20)
    assert kept.columns == docs.columns
    rows = kept.collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "")
    assert sorted(map(key, rows)) == sorted(map(key, line_dedup.without_copies(plain, 20).collect()))
    assert all(r[c] == k for r in rows for k, c in enumerate(own))
