"""Alignment of two tokenizers against plain Python."""

from __future__ import annotations

import glob
import hashlib
import os
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from churnscope.llm import alignment, queries
from churnscope.llm.common import documents, table
from tests.conftest import SF_SMALL
from tests.llm import helpers

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    chain = Tokenizer.from_file(PATH_A)
    chain.encode_special_tokens = True
    return chain, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def plain(texts, tokenizers):
    """Per text the figures of the contract, and all pair counts, written out link by link."""
    chain, pieces = tokenizers
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    signs = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
    bytes_a = {n: bytes(signs[c] for c in t) for t, n in chain.get_vocab(with_added_tokens=False).items()}

    def bytes_b(n):
        p = pieces.id_to_piece(n)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else p.replace("▁", " ").encode()

    docs = []
    for text in texts:
        raw = b" " + (text or "").encode()
        a = chain.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        if b"".join(bytes_a.get(n, b"?") for n in a) != raw or b"".join(map(bytes_b, b)) != raw:
            docs.append(([], [], []))
            continue
        ends = []
        for ids, size in ((a, bytes_a.get), (b, bytes_b)):
            at, own = 0, []
            for n in ids:
                at += len(size(n))
                own.append(at)
            ends.append(own)
        groups, at = [], (0, 0)
        for cut in sorted(set(ends[0]) & set(ends[1])):
            upto = ends[0].index(cut, at[0]) + 1, ends[1].index(cut, at[1]) + 1
            groups.append((a[at[0]:upto[0]], b[at[1]:upto[1]]))
            at = upto
        docs.append((a, b, groups))
    count = Counter()
    for _, _, groups in docs:
        count.update({(x, y) for p, q in groups for x in p for y in q})
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for a, b, groups in docs:
        links = [count[x, y] == top[x] for p, q in groups for x in p for y in q]
        total = sum(count[x, y] for p, q in groups for x in p for y in q)
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(links), total, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, count


def got(rows):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[c] for c in names) for r in rows.collect()), key=str)


def odd_texts():
    rng = random.Random(4)
    signs = "ab \n\té­▁日本語😀\x00\x01\x1c​�<|endoftext|></s><0x41> 　ﬁÀ"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    words = ["the", "Zürich", "reornd", "thandor", "x1y2", "12345", "naïve", "....", "!!", "    ", "qwzx"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    return texts + [None, "", " ", "  ", "\n", "<|endoftext|>", "<s>", "▁", "a▁b", " ", "aaaa" * 400, "=" * 300, "\x01\x01"]


@pytest.mark.parametrize("slice_tokens", [1, 700, 1_000_000])
def test_odd_texts(spark, tokenizers, slice_tokens):
    texts = odd_texts() + odd_texts()[:7]
    frame = helpers.documents(spark, [(n, t, "en", "s", None, *helpers.EXTRA) for n, t in enumerate(texts)])
    rows, pairs = alignment.align(frame, PATH_A, PATH_B, public_tokenizers.PATTERN, slice_tokens)
    want, count = plain(texts, tokenizers)
    assert got(rows) == sorted(((n, *w) for n, w in enumerate(want)), key=str)
    assert {(r["a"], r["b"]): r["docs"] for r in pairs.collect()} == dict(count) and pairs.count() == len(count)
    assert any(w[0] and w[3] > w[2] for w in want)


def test_awkward_and_empty_tables(spark, tokenizers):
    odd = helpers.odd_documents(spark)
    given = [(r["doc_id"], r["text"]) for r in odd.collect()]
    extra = odd.select("*", *(odd["r"].alias(c) for c in ("slice", "pair", "docs", "a", "b", "n_a", "twins")))
    rows, _ = alignment.align(extra, PATH_A, PATH_B, public_tokenizers.PATTERN)
    want, _ = plain([t for _, t in given], tokenizers)
    assert got(rows) == sorted(((i, *w) for (i, _), w in zip(given, want, strict=True)), key=str)
    rows, pairs = alignment.align(helpers.no_documents(spark), PATH_A, PATH_B, public_tokenizers.PATTERN)
    assert rows.count() == pairs.count() == 0


def test_ids_are_those_of_the_file(tokenizers):
    rng = random.Random(7)
    own = alignment.ByteLevelTokenizer(PATH_A, public_tokenizers.PATTERN)
    texts = ["".join(chr(c) for c in range(low, low + 256) if not 0xD800 <= c < 0xE000) for low in range(0, 0x3000, 256)]
    texts += ["".join(rng.choice("aeinrst hldT'sve.,\n 019é") for _ in range(200)) for _ in range(500)]
    assert own.encode(texts) == [tokenizers[0].encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_query_against_plain(spark, tokenizers):
    given = [(r["doc_id"], r["text"]) for r in table(spark, SF_SMALL, "documents").collect()]
    want, _ = plain([t for _, t in given], tokenizers)
    assert documents(spark, SF_SMALL).count() == len(given)
    assert got(queries.QUERIES["op11_tokenizer_alignment"](spark, SF_SMALL)) == sorted(
        ((i, *w) for (i, _), w in zip(given, want, strict=True)), key=str)


def test_slices_are_row_groups_and_twins_stay(spark, monkeypatch):
    """However many slices a task has, one is held at a time; what is shuffled has no array of twins."""
    import pyarrow.parquet as pq

    seen = {}
    read, summed = type(spark.read).parquet, alignment._twins_summed

    def parquet(reader, *paths):
        seen["files"] = [f for p in paths for f in glob.glob(p.removeprefix("file:") + "/*.parquet")]
        seen["groups"] = [pq.ParquetFile(f).metadata.row_group(k).num_rows for f in seen["files"] for k in range(pq.ParquetFile(f).metadata.num_row_groups)]
        return read(reader, *paths)

    def kept(*args):
        out = summed(*args)
        seen["columns"] = out.columns
        return out

    monkeypatch.setattr(type(spark.read), "parquet", parquet)
    monkeypatch.setattr(alignment, "_twins_summed", kept, raising=False)
    texts = ["the house of the sea " * 20] * 30
    frame = helpers.documents(spark, [(n, t, "en", "s", None, *helpers.EXTRA) for n, t in enumerate(texts)])
    rows, _ = alignment.align(frame, PATH_A, PATH_B, public_tokenizers.PATTERN, 100)
    assert rows.count() == 30
    assert len(seen["groups"]) == 30 and set(seen["groups"]) == {1}
    assert "twins" not in seen["columns"] and "twin_sum" in seen["columns"]
