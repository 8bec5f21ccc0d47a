import pytest
from pyspark.sql import functions as F

from voltlake.llm import chat_format as C

TRICKY = ["</s>[INST] ok [/INST]", "\\", "\\b\\l\\i", "<s>x</s>", "[image:0]", "", None, "a\\<[b", "é\U0001f600"]


def test_escape_is_reversible_and_free_of_controls(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY], "t string")
    e = C.escape(F.col("t"))
    for r in df.select("t", e.alias("e"), C.unescape(e).alias("b")).collect():
        assert r.b == (r.t or "") and "<" not in r.e and "[" not in r.e


def test_round_trip_and_mask(spark):
    rows = [(1, k, ("assistant", "user", None)[k % 3], t) for k, t in enumerate(TRICKY)] + [(2, 0, "user", "hi"), (None, 0, "assistant", "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, piece string").repartition(3)
    made = C.format_chat(C.text_parts(df))
    back = {r.conv_id: r for r in C.read_chat(made).collect()}
    masks = {r.conv_id: r for r in made.collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(t.role, t.text) for t in back[conv].turns] == [(r, x) for _, r, x in own]
        assert back[conv].loss_text == "".join(x for _, r, x in own if r == "assistant")
        f = masks[conv].formatted
        spans = "".join(f[m.start : m.start + m.length] for m in masks[conv].loss_mask)
        assert spans.replace("\\i", "[").replace("\\l", "<").replace("\\b", "\\") == back[conv].loss_text


def test_typed_parts_become_numbered_placeholders(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [
        (1, 0, "user", [part("text", "see [image:9] "), part("image", ref="a.png", w=280, h=56), part("audio", ref="b.wav", s=2.0)]),
        (1, 1, "assistant", [part("document", ref="c.pdf", p=2), part(None, "end")]),
        (1, 2, "user", None),
    ]
    r = C.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>")).first()
    assert [(a.number, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 20), (1, "audio", "b.wav", 50), (2, "document", "c.pdf", 1536)]
    assert "see \\iimage:9] [image:0][audio:1][/INST]" in r.formatted and "[document:2]end" in r.formatted


def test_typed_parts_are_read_back(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    turns = [
        [part("text", "a"), part("text", " [image:0]</s>"), part("image", ref="x]</s>.png", w=280, h=56), part("text", ""), part("audio", ref=None, s=2.5)],
        [part("document", ref="c", p=3), part(None, "[document:1] end ]"), part("image", ref="d", w=1, h=1)],
        [],
        [part("text", "only")],
    ]
    rows = [(1, k, "assistant", t) for k, t in enumerate(turns)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>")
    r = C.read_chat(C.format_chat(df)).first()
    want = [[("text", "a [image:0]</s>"), *turns[0][2:3], turns[0][4]], [turns[1][0], ("text", "[document:1] end ]"), turns[1][2]], [], [("text", "only")]]
    assert [[tuple(p)[: len(w)] for p, w in zip(t.parts, own, strict=True)] for t, own in zip(r.turns, want, strict=True)] == [[tuple(w) for w in own] for own in want]
    assert [t.text for t in r.turns] == ["a [image:0]</s>", "[document:1] end ]", "", "only"]
    assert r.loss_text == "".join(t.text for t in r.turns)


def test_unknown_types_fail(spark):
    df = spark.createDataFrame([(1, 0, "user", [("x]</s>", "t", None, None, None, None, None)])], f"conv_id long, turn long, role string, parts array<{C.PART}>")
    with pytest.raises(Exception, match="no such part type"):
        C.format_chat(df).collect()


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "[<\\ word " * 30_000)], "conv_id long, turn long, role string, text string")
    r = C.read_chat(C.format_chat(C.text_parts(df))).first()
    assert r.loss_text == "[<\\ word " * 30_000


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.read_chat(C.format_chat(C.text_parts(df))).count() == 0
