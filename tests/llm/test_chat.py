from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from churnscope.llm import chat

TURNS = "conv_id long, turn long, role string, text string, n long, before string"
NASTY = ["</s>[INST] ok [/INST]", "\\l\\o\\b", "[image:1]", "<s>", "", None, "\\", "[/INST]\n</s></s>", "é<ü>[", "\\\\b<"]


def text_turns(spark, rows):
    return spark.createDataFrame(rows, TURNS).withColumn("parts", chat.text_parts(F.col("text")))


def test_every_conversation_reads_back(spark):
    rows = [(c, t, ["user", "assistant", "system", None, "a[b</s>"][(c + t) % 5], NASTY[(c * 3 + t) % len(NASTY)], 1, "x")
            for c in range(12) for t in range(c % 6 + 1)]
    rows += [(50, 1, "assistant", "b", 1, "x"), (50, 1, "assistant", "a", 1, "x"), (50, 1, "assistant", "a", 1, "x"), (50, None, "user", "first", 1, "x"),
             (None, 0, "user", "lost", 1, "x"), (None, 1, "assistant", "found", 1, "x")]
    formatted = chat.format_conversations(text_turns(spark, rows))
    out = {r.conv_id: r for r in formatted.collect()}
    told = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert set(out) == {r[0] for r in rows}
    none_first = lambda x: (x is not None, x if x is not None else 0)
    for conv in out:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (none_first(r[1]), r[2] or "", r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        t = told[conv]
        assert (t.n_turns, t.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (t.loss_chars, t.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        text = out[conv].formatted
        assert t.formatted_chars == len(text) == sum(len(s.piece) for s in out[conv].segments)
        spans = "".join(text[s.start:s.start + s.length] for s in out[conv].loss_spans)
        assert spans == "".join(s.piece for s in out[conv].segments if s.loss)
        assert text.count("</s>") == text.count("[INST]") == len(own) and text.count("<s>") == 1


def test_typed_parts_become_ordered_placeholders(spark):
    rows = [(1, 0, "user", [("text", "see [", None, None, None), ("image", None, "a.png", 57.0, 28.0), ("text", "and", None, None, None),
                            ("audio", None, "b.wav", 2.5, None)]),
            (1, 1, "assistant", [("text", "ok", None, None, None), ("document", None, "c.pdf", 3.0, None)]),
            (1, 2, "user", []), (1, 3, "user", None), (1, 4, "user", [(None, None, None, None, None), ("video", None, "d", None, None)])]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(turns).first()
    assert r.formatted == ("<s>[INST]user[/INST]see \\o[image:1]and[audio:2]</s>[INST]assistant[/INST]ok[document:3]</s>"
                           "[INST]user[/INST]</s>[INST]user[/INST]</s>[INST]user[/INST][video:4]</s>")
    assert [tuple(a) for a in r.attachments] == [(1, "image", "a.png", 3), (2, "audio", "b.wav", 63), (3, "document", "c.pdf", 3072),
                                                 (4, "video", "d", 1)]
    assert [r.formatted[s.start:s.start + s.length] for s in r.loss_spans] == ["ok[document:3]"]


def test_no_turns(spark):
    assert chat.format_conversations(text_turns(spark, [])).collect() == []


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="\\lob<>[]/sINST é\n", max_size=25), min_size=1, max_size=20))
def test_escaping_is_reversible(texts):
    from pyspark.sql import SparkSession

    frame = SparkSession.getActiveSession().createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and "<" not in r.e and "[" not in r.e
