from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import xxhash

from churnscope.llm import fingerprints
from tests.llm import helpers


def test_edited_texts_and_likeness_against_plain_python(spark):
    rows = sorted(((r[0], r[1] or "") for r in helpers.awkward_rows()), reverse=True)
    docs = helpers.documents(spark)
    own = {i: fingerprints.text_fingerprint(t.encode(), {}) for i, t in rows}
    for buckets in (1, 7, 50):
        got = {r.doc_id: r for r in fingerprints.edited_likeness(docs, buckets).collect()}
        assert set(got) == {i for i, _ in rows}
        for k, (i, text) in enumerate(rows):
            j, following = rows[(k + 1) % len(rows)]
            edited = (text[:len(text) - len(text) // 2] + following[:len(text) // 2]).encode()
            changed = fingerprints.text_fingerprint(edited, {})
            want = (i, len(text), hashlib.sha256(edited).hexdigest(), own[i].hex(), changed.hex(),
                    fingerprints.likeness(own[i], changed), fingerprints.likeness(own[i], own[j]))
            assert tuple(got[i]) == want


def test_votes_are_weighed_by_term_counts():
    plain = fingerprints.text_fingerprint(b"a b c d e f g h", {})
    assert plain == fingerprints.text_fingerprint(b"A  b\nC d e f g H", {}) and len(plain) == 32
    assert fingerprints.text_fingerprint(b"", {}) == fingerprints.text_fingerprint(b" \n", {}) == bytes(32)
    repeated = fingerprints.text_fingerprint(b"x y " * 200 + b"a b c", {})
    heavy, light = (fingerprints.text_fingerprint(t, {}) for t in (b"x y " * 200, b"a b c"))
    assert fingerprints.likeness(repeated, heavy) > 1.2 * fingerprints.likeness(repeated, light)
    long = " ".join(f"w{k % 20011}" for k in range(40_000)).encode()
    assert len(fingerprints.text_fingerprint(long, {})) == 32


def test_likeness_range():
    zero = bytes(32)
    assert fingerprints.likeness(zero, zero) == 1.0 and fingerprints.likeness(zero, b"\xff" * 32) == 0.0
    one = b"\x01" + bytes(31)
    assert fingerprints.likeness(zero, one) == math.cos(math.pi / 256)


def test_permuted_tables_find_all_within_the_radius(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(256) for _ in range(12)]
    prints = list(base)
    for b in base:
        prints += [b ^ sum(1 << k for k in rng.sample(range(256), rng.randint(0, 11))) for _ in range(15)]
    prints += [0, 0, 0, 1]
    hexed = [f"{p:064x}" for p in prints]
    frame = spark.createDataFrame([(h,) for h in hexed] + [(None,)], "fingerprint string")
    for radius, chunk in ((7, 1024), (7, 3), (0, 5), (3, 2)):
        got = {r.fingerprint: r.n_within for r in fingerprints.count_within(frame, frame, radius, chunk).collect()}
        assert got == {h: sum((p ^ q).bit_count() <= radius for q in prints) for h, p in zip(hexed, prints, strict=True)}


def test_documents_get_the_fingerprint_of_their_text(spark):
    docs = helpers.odd_documents(spark)
    got = sorted(((r.doc_id, r.fingerprint) for r in fingerprints.fingerprint_documents(docs).collect()), key=str)
    want = sorted(((r.doc_id, fingerprints.text_fingerprint((r.text or "").encode(), {}).hex()) for r in docs.collect()), key=str)
    assert got == want


def test_null_and_repeated_ids_and_empty_tables(spark):
    docs = helpers.odd_documents(spark)
    rows = fingerprints.edited_likeness(docs, 5).collect()
    assert len(rows) == docs.count() and sum(r.doc_id is None for r in rows) == 2
    assert fingerprints.edited_likeness(helpers.no_documents(spark)).collect() == []
    lone = helpers.documents(spark, helpers.awkward_rows()[20:21])
    r = fingerprints.edited_likeness(lone).first()
    assert r.near_next == 1.0
    none = helpers.documents(spark, [(None, "a b c d", *helpers.awkward_rows()[0][2:])])
    assert fingerprints.edited_likeness(none).count() == 1


def test_ids_that_a_third_of_the_rows_share_fill_several_buckets(spark):
    rows = [(None, f"none {k} of them") for k in range(200)] + [(7, f"seven {k} of them") for k in range(200)]
    rows += [(2 ** 62 + k, f"own {k}") for k in range(100)] + [(-k, f"below {k}") for k in range(1, 100)] + [(2 ** 63 - 1, "top")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def digest(text):
        unsigned = xxhash.xxh64_intdigest(text.encode(), 42)
        return unsigned - (unsigned >= 2 ** 63) * 2 ** 64

    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), digest(r[1])))
    follows = {r: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
    for buckets in (1, 12):
        placed = fingerprints.neighbour_buckets(docs, buckets).collect()
        sizes = Counter(r.bucket for r in placed)
        assert len(placed) == len(rows) + len(sizes)
        if buckets > 1:
            assert max(sizes.values()) < 120
        got = Counter((r.doc_id, r.edited_sha256) for r in fingerprints.edited_likeness(docs, buckets).collect())
        assert got == Counter((i, hashlib.sha256((text[:len(text) - len(text) // 2] + following[:len(text) // 2]).encode()).hexdigest())
                              for (i, text), following in follows.items())
