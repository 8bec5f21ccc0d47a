import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voltlake.llm import suffix_dedup as S


def brute(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if d is not None:
            for i in range(len(b) - length + 1):
                if first[b[i : i + length]] < d:
                    gone[i : i + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def result(df):
    got = S.dedup_substrings(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    return sorted(map(tuple, got.collect()), key=str)


def test_against_brute_force(docs, corpus):
    assert result(docs) == brute(corpus)


def test_copies_order_and_null_ids(spark):
    long = "Ünïcode passage that is long enough to matter, and then some more of it to be sure. "
    rows = [(5, long * 3), (3, "x" + long), (9, long * 3), (9, "another text with the same id " + long), (None, long), (1, long[:60])]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_empty(none):
    assert S.dedup_substrings(none).count() == 0


def test_cut_characters_are_left_out(spark):
    """The shared string ends inside a character: its rest isn't text."""
    df = spark.createDataFrame([(1, "x" * 49 + "é"), (2, "x" * 49 + "è end"), (3, None)], "doc_id long, text string")
    assert [r.kept for r in S.dedup_substrings(df, as_text=True).orderBy("doc_id").collect()] == ["x" * 49 + "é", " end", ""]
    assert bytes(S.dedup_substrings(df).filter("doc_id = 2").first().kept) == b"\xa8 end"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.integers(1, 60))
def test_suffix_array_is_sorted_to_its_depth(values, depth):
    text = np.array(values)
    order = S.suffix_array(text, depth)
    keys = [tuple(values[i : i + depth]) for i in order]
    assert sorted(order.tolist()) == list(range(len(values))) and keys == sorted(keys)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=90).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=4))
def test_anchors_depend_on_the_string_only(texts):
    seen = {}
    for t, own in zip(texts, S.anchors(texts, 20, 8), strict=True):
        assert len(own) == max(0, len(t) - 19)
        for i, a in enumerate(own.tolist()):
            assert seen.setdefault(t[i : i + 20], a) == a


def test_five_megabytes_of_one_anchor():
    rng = np.random.default_rng(3)
    middle = rng.integers(97, 123, 24, np.uint8)
    sides = rng.integers(97, 123, (2000, 26), np.uint8)
    n = 66_000
    pieces = np.concatenate([sides[rng.integers(0, 2000, n)], np.tile(middle, (n, 1)), rng.integers(97, 123, (n, 26), np.uint8)], 1)
    pieces[::2, 50:] = sides[rng.integers(0, 2000, n // 2)]
    docs = rng.permutation(n).astype(np.int64)
    got = S.least_documents(pieces.ravel(), np.full(n, 76), docs, 50)
    first, own = {}, [p.tobytes() for p in pieces]
    for d, p in zip(docs.tolist(), own, strict=True):
        for i in range(27):
            w = p[i : i + 50]
            first[w] = min(first.get(w, d), d)
    assert pieces.size > 5_000_000 and got.tolist() == [first[p[i : i + 50]] for p in own for i in range(27)]


def test_crowded_anchors_go_to_no_bucket(spark, docs, corpus, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9)))
    line = " ".join(word() for _ in range(9))
    edges = [" ".join(word() for _ in range(5)) for _ in range(6)]
    rows = [(k % 250, f"{word()} {rng.choice(edges)} {line} {rng.choice(edges)} {word()} {line}") for k in range(300)]
    monkeypatch.setattr(S, "ANCHOR_PIECES", 20)
    inner = S._answers

    def watched(length):
        run = inner(length)

        def counted(key, rows):
            most = max(Counter(rows["tok"].to_pylist()).values())
            assert most <= 20, f"{most} pieces of one anchor"
            return run(key, rows)

        return counted

    monkeypatch.setattr(S, "_answers", watched)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    monkeypatch.setattr(S, "ANCHOR_PIECES", 1)
    assert result(docs) == brute(corpus)
