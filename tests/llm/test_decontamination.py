"""Decontamination: index, phrase and proximity matches against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from tests.llm.helpers import SCHEMA, documents, no_documents, odd_documents

from churnscope.llm import decontamination as D
from churnscope.llm import queries
from churnscope.llm.common import table
from tests.conftest import SF_SMALL

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, window=10, near=15):
    """Per document: (n_words, n_hit, item ids, near items), straight from the definition."""
    asked = {}
    for item_id, text in items:
        words = plain_words(text)
        for at in range(max(1, len(words) - window + 1)) if words else ():
            asked.setdefault(tuple(words[at:at + window]), set()).add("" if item_id is None else str(item_id))
    sets = {w: (set(w), ids) for w, ids in asked.items()}
    out = []
    for doc_id, text in docs:
        words = plain_words(text)
        hit, found, close = set(), set(), set()
        for size in {len(w) for w in asked}:
            for at in range(len(words) - size + 1):
                ids = asked.get(tuple(words[at:at + size]))
                if ids:
                    hit.update(range(at, at + size))
                    found |= ids
        for at in range(len(words)):
            here = set(words[at:at + near])
            for own, ids in sets.values():
                if not ids <= close and own <= here:
                    close |= ids
        out.append((doc_id, len(words), len(hit), tuple(sorted(found)), len(close)))
    return sorted(out, key=str)


def got(rows):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), r["n_near"]) for r in rows.collect()), key=str)


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in items], "item_id long, text string, item long, words string").repartition(2)


def case(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "the", "Of", "é", "x1", "日本", *(f"w{k}" for k in range(30))])
    gap = lambda: rng.choice([" ", ", ", "\n", "-", "\x1c", "_"])
    text = lambda n: "".join(word() + gap() for _ in range(n))
    items = [(k, text(rng.randint(1, 25))) for k in range(12)] + [(50, None), (51, ""), (52, " .,"), (53, "w1 w2 w1"), (None, "the of x1 w3")]
    items += [(60, items[0][1]), (61, items[0][1] + " tail"), (1, text(14))]
    docs = [(None, None), (1, ""), (2, "-- ."), (3, "one")]
    for k in range(60):
        parts = [text(rng.randint(0, 40))]
        if rng.random() < 0.6:
            given = items[rng.randrange(12)][1].split(" ")
            rng.random() < 0.4 and rng.shuffle(given)
            parts += [" ".join(given).upper() if rng.random() < 0.3 else " ".join(given), text(rng.randint(0, 10))]
        docs.append((k, " ".join(parts)))
    return docs + docs[5:9] + [(None, docs[10][1])] + [(900 + k, docs[12][1]) for k in range(30)], items


@pytest.mark.parametrize("seed,segment_words,block_words", [(1, 200, 10_000), (2, 100_000, 60), (3, 1, 10_000)])
def test_against_plain(spark, seed, segment_words, block_words):
    docs, items = case(seed)
    frame = documents(spark, [(i, t, "en", "s", None, *([None] * 13)) for i, t in docs])
    rows = D.contamination(frame, items_frame(spark, items), segment_words=segment_words, block_words=block_words)
    assert got(rows) == plain(docs, items)


@pytest.mark.parametrize("window,near", [(1, 1), (2, 3), (4, 4)])
def test_short_windows(spark, window, near):
    docs, items = case(5)
    frame = documents(spark, [(i, t, "en", "s", None, *([None] * 13)) for i, t in docs])
    assert got(D.contamination(frame, items_frame(spark, items), window, near, 300)) == plain(docs, items, window, near)


def test_awkward_and_empty_tables(spark):
    odd = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(1, rows[40][1]), (2, "one two")]
    assert got(D.contamination(odd, items_frame(spark, items))) == plain(rows, items)
    assert got(D.contamination(odd, items_frame(spark, items).limit(0))) == plain(rows, [])
    assert D.contamination(no_documents(spark), items_frame(spark, items)).count() == 0
    extra = odd.select("*", *(odd["r"].alias(c) for c in ("segment", "nth", "item", "terms", "postings", "n_words", "doc_ids")))
    assert len(SCHEMA) and got(D.contamination(extra, items_frame(spark, items))) == plain(rows, items)


def test_spans(spark):
    index = D.build_index(documents(spark, [(5, "x a b c y a b c d", *([None] * 16))]))
    classes, members = D.item_classes(items_frame(spark, [(3, "A b C"), (4, "d c b")]))
    ids = {r["item"]: r["item_id"] for r in members.collect()}
    spans = {ids[r["item"]]: [tuple(s) for s in r["spans"]] for r in D.phrase_matches(index, classes, 3).collect()}
    assert spans == {"3": [(1, 4), (5, 8)]}
    near = {ids[r["item"]]: [tuple(s) for s in r["spans"]] for r in D.proximity_matches(index, classes, 3, 4).collect()}
    assert near == {"3": [(1, 8)], "4": [(6, 9)]}


def test_query_against_plain(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op13_benchmark_decontamination"](spark, SF_SMALL).collect()}
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF_SMALL, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF_SMALL, "benchmark").collect()]
    want = plain(docs, items, near=10)
    assert len(rows) == len(want) and any(w[2] for w in want)
    for doc_id, n_words, n_hit, ids, _ in want:
        r = rows[doc_id]
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n_words, n_hit, len(ids), digest, n_hit > 0)
