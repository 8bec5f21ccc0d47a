import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from voltlake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a b\x85c Ünï 'S don't Don'T ... .. x²½ Ǻ é Σίσυφος ΣΑΣ İstanbul", "<|endoftext|> foo<|startoftext|>bar 中文字 \x1c\x0bq zero\x00byte", "a,b. ª º µ ß ÿ ÷ × SS. tab\there\r\nline", "́x é  wide"]


def test_ids_are_the_tokenizers(corpus):
    texts = [t or "" for _, t in corpus] + ODD
    direct = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [a.tolist()[:-1] for a in packing.WordEncoder(PATH).encode(texts)] == direct


def test_ids_of_all_words_of_a_table_are_the_tokenizers():
    """Every stretch that stands in the documents of sf0.1, alone; and some whole texts, the longest among them."""
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()]
    words = sorted({w for t in texts for w in packing.stretches(t)})
    assert len(words) > 10_000
    tokenizer = Tokenizer.from_file(PATH)
    for at in range(0, len(words), 50_000):
        few = words[at : at + 50_000]
        direct = [e.ids for e in tokenizer.encode_batch_fast(few, add_special_tokens=False)]
        assert [a.tolist()[:-1] for a in packing.WordEncoder(PATH).encode(few)] == direct
    some = sorted(texts, key=len)[-20:] + texts[::500]
    assert max(len(t.split()) for t in some) > 10_000
    assert [a.tolist()[:-1] for a in packing.WordEncoder(PATH).encode(some)] == [e.ids for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]


def test_memory_of_words_is_bounded_by_bytes(monkeypatch):
    """A stretch of a megabyte without blanks isn't kept; what is kept is let go beyond the bound."""
    monkeypatch.setattr(packing, "CACHE_BYTES", 2000)
    encoder, direct = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    long = "".join(f"{k:x}ab" for k in range(200_000))
    for texts in (["one " + long + " two", long], [f"word{k} other{k}." for k in range(50)], ["one more", None or ""]):
        assert [a.tolist()[:-1] for a in encoder.encode(texts)] == [e.ids for e in direct.encode_batch(texts, add_special_tokens=False)]
        assert long not in encoder.known and encoder.held < 2000 + 200 * 250
    assert len(encoder.known) <= 4


def check(rows, texts):
    """Every id once, sequences gapless and at most full."""
    ids = {}
    for d, t in texts:
        ids.setdefault(d, []).append([*Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids, 1])
    assert sum(r.length for r in rows) == sum(len(x) for own in ids.values() for x in own)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
        assert any(r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in ids[r.doc_id])
    sizes = []
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.WINDOW_TOKENS
        sizes.append(at)
    return sizes


@pytest.mark.parametrize("max_open", [1024, 3])
def test_whole_and_without_padding(docs, corpus, max_open):
    rows = packing.pack(docs, max_open=max_open).collect()
    sizes = check(rows, corpus)
    assert all(s == packing.WINDOW_TOKENS or s & (s - 1) == 0 for s in sizes)


def test_level_choice_minimises_squares():
    p = packing.SumOfSquares(10, 100, 0)
    ids = np.zeros(10, np.uint32)
    for size in (6, 4):
        list(p.add((1, 0, ids[:size], size)))
    assert p.open == 0  # 4 fills the window at level 6, which lowers the sum of squares most
    for size in (3, 3):
        list(p.add((1, 0, ids[:size], size)))
    assert int((p.count**2).sum()) <= 2


def test_empty(none):
    assert packing.pack(none).count() == 0
