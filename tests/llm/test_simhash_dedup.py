from __future__ import annotations

import random

import numpy as np
from xxhash import xxh64_intdigest

from pyspark.sql import functions as F

from churnscope.llm import simhash_dedup
from churnscope.llm.common import connected_components
from tests.llm import helpers


def plain_fingerprint(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {i: " " for i in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints: list[int], radius: int) -> list[int]:
    parent = list(range(len(prints)))

    def top(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(prints))]


def test_every_document_against_brute_force(spark):
    rows = helpers.awkward_rows()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(helpers.documents(spark)).collect()}
    prints = [plain_fingerprint(r[1]) for r in rows]
    groups = plain_groups(prints, 2)
    assert got == {r[0]: (f"{p:016x}", rows[g][0]) for r, p, g in zip(rows, prints, groups, strict=True)}


def test_links_of_random_and_crowded_fingerprints(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    near = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(120)}
    prints = sorted(near | {rng.getrandbits(64) for _ in range(60)} | {0, 1, 3, 7, 15, 2 ** 64 - 1})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for radius in (0, 1, 2):
        want = plain_groups(prints, radius)
        for limit in (2048, 3):  # 3: nearly all buckets take the way for large ones
            roots = {r.node: r.root for r in connected_components(simhash_dedup.fingerprint_links(frame, radius, limit)).collect()}
            got = [roots.get(s, s) for s in signed]
            assert {tuple(i for i in range(len(got)) if got[i] == g) for g in got} \
                == {tuple(i for i in range(len(want)) if want[i] == g) for g in want}


def test_bit_sliced_links_match_all_pairs():
    rng = random.Random(9)
    for radius in (0, 1, 2, 3, 5):
        prints = [rng.getrandbits(64) for _ in range(20)]
        prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for p in prints]
        parent = list(range(len(prints)))
        for i, j in simhash_dedup.near_links(np.array(prints, np.uint64), radius):
            assert (prints[i] ^ prints[j]).bit_count() <= radius
            a, b = parent[i], parent[j]
            parent = [min(a, b) if x in (a, b) else x for x in parent]
        assert len(set(parent)) == len(set(plain_groups(prints, radius)))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(50)] + [(7, 7), (300, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[100 + k] == 100 for k in range(50)) and got[300] == got[200] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each_group_stays(spark):
    docs = helpers.odd_documents(spark)
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    groups = simhash_dedup.near_duplicates(helpers.documents(spark)).collect()
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({r.component_id for r in groups})
    assert sum(r.doc_id is None for r in kept.collect()) == 2
    assert simhash_dedup.near_duplicates(helpers.no_documents(spark)).collect() == []
    assert simhash_dedup.keep_one(helpers.no_documents(spark)).collect() == []


def test_columns_named_like_the_operators_own(spark):
    own = ("_other", "_repeated", "_Other_", "fingerprint", "component_id", "root")
    plain = helpers.odd_documents(spark)
    docs = plain.withColumns({c: F.lit(k) for k, c in enumerate(own)})
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    assert sorted(map(key, rows)) == sorted(map(key, simhash_dedup.keep_one(plain).collect()))
    assert all(r[c] == k for r in rows for k, c in enumerate(own))
