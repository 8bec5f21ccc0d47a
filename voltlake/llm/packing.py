"""Packing: sum-of-squares online packing of documents into windows of a fixed number of tokens.

A document's full windows are cut off first; its rest is placed online: of the fill levels h that have an
open window with room (0: a new one), take the one for which the sum of squares of the counts N(h) of
partially filled windows grows least. Counts and the open windows themselves stand in an array by level.

Each Spark partition packs its own documents, in their order there: no shuffle, and a repeated task gives
the same pieces. Open windows are bounded by ``max_open``: when more are open, or the partition ends, the
fullest ones are filled up with cut pieces of the emptiest, so they close without padding; what remains
at the end of a partition (less than one window) is cut at powers of two, which need no padding.

Null texts count as empty; every document has the end token, so it has at least one piece. Rows are
packed as they come: repeated rows and null ids are packed like others.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm import packed
from voltlake.llm.common import staged, table

WINDOW_TOKENS, END_ID, MAX_OPEN = 2048, 1, 1024
#: Bytes after which a task's memory of encoded words starts afresh (some 150 go with each entry), and the longest stretch that is kept in it.
CACHE_BYTES, ENTRY_BYTES, KEPT_CHARS = 64 << 20, 150, 64
#: Code points of texts that are encoded together.
TOGETHER_CHARS = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Ids (as little-endian unsigned 32-bit bytes) of whole texts by a tokenizer that lower-cases and drops white space.

    Texts are cut at blanks, tabs and line ends only. The tokenizer never joins across these, so each
    stretch between them has the same ids alone as in its text; stretches are remembered. A mark behind
    letters is a stretch of its own. Unknown words of small Latin letters are merged with the tokenizer's
    own vocabulary and merges by ``tiktoken``, several times faster than ``tokenizers`` and with the same
    ids (tests compare both); all else goes to the tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.held = 0
        model = json.loads(self.tokenizer.to_str())["model"]
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token.removesuffix(WORD_END)) + b"\0" * token.endswith(WORD_END)
        first = [bytes([b]) + e for e in (b"", b"\0") for b in range(256)]  # a word's last byte is one with its end
        merged = [raw("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        ranks = {x: k for k, x in enumerate(dict.fromkeys([*first, *merged]))}
        self.words = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.ids, self.ends = np.zeros(len(ranks), "<u4"), np.zeros(len(ranks), bool)
        for token, number in model["vocab"].items():
            if not token.startswith("<|") and (rank := ranks.get(raw(token))) is not None:
                self.ids[rank], self.ends[rank] = number, token.endswith(WORD_END)

    def learn(self, words: list[str]) -> list[str]:
        """Takes in words that aren't known yet; returns the long ones, which are to be dropped after use."""
        tails = {w: (w[:-1], w[-1]) for w in words if w[-1] in MARKS and w[:-1].isalpha()}
        new = {x for pair in tails.values() for x in pair}.union(w for w in words if w not in tails).difference(self.known)
        simple, made = [w for w in new if _SIMPLE.fullmatch(w)], {}
        if simple:
            ranks = np.array(self.words.encode_ordinary("\0".join(simple) + "\0"), np.int64)
            ids, ends = self.ids[ranks].tobytes(), (np.flatnonzero(self.ends[ranks]) + 1).tolist()
            made.update((w, ids[4 * i : 4 * j]) for w, i, j in zip(simple, [0, *ends], ends, strict=False))
        rest = list(new.difference(simple))
        for at in range(0, len(rest), 1000):
            few = rest[at : at + 1000]
            coded = self.tokenizer.encode_batch_fast(few, add_special_tokens=False)
            made.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(few, coded, strict=True))
        self.known.update(made)
        self.known.update((w, self.known[a] + self.known[b]) for w, (a, b) in tails.items())
        both = [*made, *tails]
        self.held += sum(5 * len(w) + ENTRY_BYTES for w in both if len(w) <= KEPT_CHARS)
        return [w for w in both if len(w) > KEPT_CHARS]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Per text its ids and the end id."""
        parts = [stretches(x) for x in texts]
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        new = set(chain.from_iterable(parts)).difference(self.known)
        long = self.learn(list(new)) if new else []
        get, end = self.known.__getitem__, np.array([END_ID], "<u4").tobytes()
        out = [np.frombuffer(b"".join(chain(map(get, p), (end,))), "<u4") for p in parts]
        for w in long:
            self.known.pop(w, None)
        return out


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


WORD_END = "</w>"
_SIMPLE = re.compile("[a-zß-öø-ÿ]+")
MARKS = frozenset(".,;:!?")
#: White space to str.split() that texts aren't cut at: the tokenizer may see it otherwise.
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0]")


def stretches(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        plain = False
    else:
        plain = not _ODD.search(text)
    if plain:  # lower case is the same everywhere there, and so is white space
        return text.lower().split()
    return [x for x in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if x]


class SumOfSquares:
    """Packs (doc_id, start, ids, total) pieces; ``placed`` rows come out as (piece, sequence, offset)."""

    def __init__(self, window: int, max_open: int, first_sequence: int):
        self.window, self.max_open, self.next = window, max_open, first_sequence
        self.count = np.zeros(window + 1, np.int64)  # N(h); levels 0 and window stay 0
        self.at: list[list[list]] = [[] for _ in range(window + 1)]  # open windows by level: lists of pieces
        self.open = 0

    def _close(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for p in pieces:
            yield p, self.next, at
            at += len(p[2])
        self.next += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        size, w, n = len(piece[2]), self.window, self.count
        if size == w:
            yield from self._close([piece])
            return
        # change of the sum of squares for level h: a window leaves h and comes to h + size
        cost = np.where(n[: w - size + 1] > 0, 1 - 2 * n[: w - size + 1], 4 * self.max_open)
        cost[0] = 0
        cost[: w - size] += 2 * n[size:w] + 1
        h = len(cost) - 1 - int(cost[::-1].argmin())  # ties to the fullest
        held = []
        if h:
            held = self.at[h].pop()
            n[h] -= 1
            self.open -= 1
        held.append(piece)
        if h + size == w:
            yield from self._close(held)
            return
        self.at[h + size].append(held)
        n[h + size] += 1
        self.open += 1
        if self.open > self.max_open:
            yield from self.settle(False)

    def settle(self, last: bool) -> Iterator[tuple]:
        """Fills the fullest windows with cut pieces of the emptiest; at most one stays open."""
        windows = [x for level in reversed(self.at) for x in level]
        self.at = [[] for _ in range(self.window + 1)]
        self.count[:] = 0
        self.open = 0
        low = len(windows)
        spare: list = []  # pieces to fill up with, last first
        k = 0
        while k < low:
            held = windows[k]
            k += 1
            room = self.window - sum(len(p[2]) for p in held)
            while room and (spare or k < low):
                if not spare:
                    low -= 1
                    spare = windows[low][::-1]
                doc, start, ids, total = spare.pop()
                held.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:], total))
                room = self.window - sum(len(p[2]) for p in held)
            if room and not last:
                self._hold(held)
            elif room:
                yield from self._powers(held)
            else:
                yield from self._close(held)
        if spare:
            if last:
                yield from self._powers(spare[::-1])
            else:
                self._hold(spare[::-1])

    def _hold(self, held: list) -> None:
        level = sum(len(p[2]) for p in held)
        self.at[level].append(held)
        self.count[level] += 1
        self.open += 1

    def _powers(self, held: list) -> Iterator[tuple]:
        left, rest = sum(len(p[2]) for p in held), held[::-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            cut = []
            while room:
                doc, start, ids, total = rest.pop()
                cut.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    rest.append((doc, start + room, ids[room:], total))
                room -= len(cut[-1][2])
            yield from self._close(cut)


def _packer(path: str, window: int, max_open: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = WordEncoder(path)
        packer = SumOfSquares(window, max_open, TaskContext.get().partitionId() << 40)

        def rows(placed) -> pa.RecordBatch:
            cols = list(zip(*((p[0], p[1], len(p[2]), zlib.crc32(p[2].tobytes()), p[3], s, o) for p, s, o in placed), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in PIECES.split(", ")])

        placed: list = []
        for number, batch in enumerate(batches):
            if number % 16 == 15:
                packed.give_back()
            ids = batch.column(0).to_pylist()
            for few in _few(batch.column(1)):
                texts = [x or "" for x in few[1].to_pylist()]
                for doc, tokens in zip(ids[few[0] : few[0] + len(texts)], encoder.encode(texts), strict=True):
                    total = len(tokens)
                    for at in range(0, total, window):
                        placed.extend(packer.add((doc, at, tokens[at : at + window], total)))
                if len(placed) > 2000:
                    yield rows(placed)
                    placed = []
        placed.extend(packer.settle(True))
        del encoder
        packed.give_back()
        if placed:
            yield rows(placed)

    return run


def _few(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of at most 200 texts and, but for single longer ones, TOGETHER_CHARS code points."""
    sizes = pc.utf8_length(texts).fill_null(0).to_pylist()
    at, held = 0, 0
    for k, size in enumerate(sizes):
        if k > at and (k - at == 200 or held + size > TOGETHER_CHARS):
            yield at, texts.slice(at, k - at)
            at, held = k, 0
        held += size
    if at < len(sizes):
        yield at, texts.slice(at)


def pack(docs: DataFrame, doc_id="doc_id", text="text", tokenizer: str | None = None, window: int = WINDOW_TOKENS, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_packer(tokenizer, window, max_open), PIECES)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return staged(pack(table(spark, sf_dir, "documents")), "packed")  # written in small batches


QUERIES = {"op3_packing": op3_packing}
ORACLE: dict[str, str] = {}
