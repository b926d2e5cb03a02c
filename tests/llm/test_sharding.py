from __future__ import annotations

import random
import zlib
from collections import Counter

from churnscope.llm import sharding
from tests.llm import helpers


def test_differencing_balances_and_keeps_every_vector():
    rng = random.Random(3)
    for shards in (2, 3, 8):
        vectors = [[rng.randint(1, 10_000)] + [0] * (shards - 1) for _ in range(200)]
        total, became = sharding.difference(vectors)
        sums = [0] * shards
        for vector, to in zip(vectors, became, strict=True):
            assert sorted(to) == list(range(shards))
            for k, x in enumerate(vector):
                sums[to[k]] += x
        assert sums == total and max(sums) - min(sums) < 200
    assert sharding.difference([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]])[0] in ([16, 14], [14, 16])  # the textbook example
    assert sharding.difference([]) == ([], []) and sharding.difference([[3, 1]]) == ([3, 1], [[0, 1]])


def test_documents_are_sharded_once_with_gapless_slots(spark):
    docs = helpers.odd_documents(spark)
    rows = sharding.shard_documents(docs).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    raw = [(d.doc_id, (d.text or "").encode()) for d in docs.collect()]
    want = sorted(((i, len(t) + 1, zlib.crc32(t)) for i, t in raw), key=key)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=key) == want
    for shard in range(8):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    of_text: dict[int, set] = {}
    for r in rows:
        of_text.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in of_text.values())  # equal texts stay together
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_sizes_are_near_equal_over_levels(spark):
    rng = random.Random(4)
    groups = spark.createDataFrame([(f"g{k}", rng.randint(1, 5000)) for k in range(3000)], "group_key string, weight long")
    weights = {r.group_key: r.weight for r in groups.collect()}
    for a_bucket in (1000, 20):  # 20: three levels
        sums: Counter[int] = Counter()
        placed = sharding.balance_groups(groups, 8, a_bucket).collect()
        for r in placed:
            sums[r.shard] += weights[r.group_key]
        assert len(placed) == 3000 and max(sums.values()) - min(sums.values()) < 5000


def test_no_documents(spark):
    assert sharding.shard_documents(helpers.no_documents(spark)).collect() == []
