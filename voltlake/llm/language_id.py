"""Language ID of mixed texts: script ranges narrow candidates, Viterbi over per-word scores labels spans.

Learning: one pass counts letter trigrams (hashed to 2^16 buckets, word borders included) and the script of
each word, per language, over all training rows; counts are summed by Spark and become arrays by language and range of
buckets, of 2^16 + 64 counts a language. What reaches the driver and is broadcast is languages x these, whatever the input. More than
MAX_LANGUAGES languages (dirty labels, as a rule) are kept sparse, some 12 bytes for each bucket that a language has; what they
score is the same, and paths are then found for one text at a time, in windows of words with a bit per word and language to go back by.

Scripts are ranges of code points; dashes, quotes, symbols and emoji are no letters. Bytes that aren't UTF-8 can't occur in Spark's strings.

Labelling: a word's score for a language is the sum of its trigrams' log probabilities; languages in which
fewer than ``rare`` of the words have the word's script are no candidates for it (unless none is left).
A Viterbi path over the words, paying ``penalty`` per switch, gives spans. The text's language is the one
with most letters on the path; ``score`` is its share of the letters.

Null or letterless texts are ``und`` with score 0 and no spans; so is every text if nothing was learned.
Ties go to the alphabetically first language. Repeated rows are labelled each for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import table

BUCKETS, SCRIPTS, PENALTY, RARE = 1 << 16, 64, 12.0, 0.001
MAX_LANGUAGES, PART_SLOTS = 200, 4096
#: Languages whose counts a worker holds before it hands them on; scores that a window of words holds.
HELD_LANGUAGES, WINDOW_SCORES = 64, 2_000_000
BATCH_BYTES, GROUP = 4 << 20, 256

_letter = np.zeros(256, np.uint8)  # what a byte counts as: 0 for no letter, else the small letter or the byte itself
_letter[0x80:] = np.arange(0x80, 0x100)
_letter[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_letter[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
#: Fixed values, by Unicode blocks: where ranges of code points start, and what script (0: no letters) they hold.
RANGES = (
    (0x00, 1), (0xA0, 0), (0xAA, 1), (0xAB, 0), (0xB5, 1), (0xB6, 0), (0xBA, 1), (0xBB, 0), (0xC0, 1), (0xD7, 0), (0xD8, 1), (0xF7, 0), (0xF8, 1),
    (0x2B9, 0), (0x300, 1), (0x370, 2), (0x37E, 0), (0x37F, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x60C, 0), (0x610, 6), (0x61B, 0), (0x620, 6), (0x66A, 0), (0x66E, 6), (0x700, 7), (0x750, 6), (0x780, 8),
    (0x7C0, 9), (0x800, 10), (0x8A0, 6), (0x900, 11), (0x964, 0), (0x966, 11), (0x980, 12), (0xA00, 13), (0xA80, 14), (0xB00, 15), (0xB80, 16), (0xC00, 17), (0xC80, 18), (0xD00, 19), (0xD80, 20),
    (0xE00, 21), (0xE80, 22), (0xF00, 23), (0x1000, 24), (0x10A0, 25), (0x1100, 26), (0x1200, 27), (0x13A0, 28), (0x1400, 29), (0x1680, 30), (0x1780, 31), (0x1800, 32), (0x18B0, 29), (0x1900, 33),
    (0x1AB0, 1), (0x1B00, 33), (0x1C80, 3), (0x1C90, 25), (0x1CC0, 33), (0x1D00, 1), (0x1F00, 2), (0x2000, 0), (0x2071, 1), (0x2080, 0), (0x2090, 1), (0x20A0, 0), (0x2C00, 34), (0x2C60, 1), (0x2C80, 35), (0x2D00, 25), (0x2D30, 36),
    (0x2D80, 27), (0x2DE0, 3), (0x2E00, 0), (0x3005, 37), (0x3008, 0), (0x3041, 38), (0x30A0, 39), (0x3100, 40), (0x3130, 26), (0x3190, 0), (0x31A0, 40), (0x31C0, 0), (0x31F0, 39), (0x3200, 0), (0x3400, 37), (0x4DC0, 0), (0x4E00, 37),
    (0xA000, 41), (0xA4D0, 42), (0xA640, 3), (0xA6A0, 43), (0xA700, 0), (0xA720, 1), (0xA800, 44), (0xA8E0, 11), (0xA900, 44), (0xA960, 26), (0xA980, 44), (0xA9E0, 24), (0xAA00, 44), (0xAB00, 27), (0xAB30, 1), (0xAB70, 28), (0xABC0, 44), (0xAC00, 26),
    (0xD800, 0), (0xF900, 37), (0xFB00, 1), (0xFB13, 4), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFEFF, 0), (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1), (0xFF5B, 0), (0xFF66, 39), (0xFFA0, 26), (0xFFDD, 0),
    (0x10000, 45), (0x1D000, 0), (0x1E000, 45), (0x1F000, 0), (0x20000, 37), (0x40000, 0),
)
_range_starts, _range_scripts = (np.array(c) for c in zip(*RANGES, strict=True))


def scripts_of(points: np.ndarray) -> np.ndarray:
    return _range_scripts[np.searchsorted(_range_starts, points, "right") - 1]


def code_points(data: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the UTF-8 characters of several bytes that begin at ``lead``, and their numbers of bytes."""
    first = data[lead].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = first & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
    for k in (1, 2, 3):
        point = np.where(size > k, point << 6 | data[np.minimum(lead + k, len(data) - 1)] & 0x3F, point)
    return point, size


class Words:
    """Letters, words and texts of some UTF-8 texts laid end to end."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        code = _letter[data].astype(np.uint32)
        script = np.ones(len(data), np.int64)  # of the letter that begins at a byte
        wide = np.flatnonzero(data >= 0xC0)
        if len(wide):
            point, size = code_points(data, wide)
            script[wide] = scripts_of(point)
            none = script[wide] == 0
            for k in range(4):
                code[wide[none & (size > k)] + k] = 0
        self.at = np.flatnonzero(code)  # places of letters
        mixed = code[self.at - 1] * np.uint32(0x9E3779B1) ^ code[self.at] * np.uint32(0x85EBCA77) ^ code[np.minimum(self.at + 1, len(code) - 1)] * np.uint32(0xC2B2AE3D)
        self.bucket = ((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.int64)
        first = code[self.at - 1] == 0
        self.start = np.flatnonzero(first)  # of each word, among the letters
        self.script = script[self.at[self.start]]
        lead = (data[self.at] & 0xC0) != 0x80
        self.letters = np.add.reduceat(lead.astype(np.int64), self.start) if len(self.start) else self.start
        ends = np.cumsum([len(t) + 1 for t in texts]) + 1
        self.text = np.searchsorted(ends, self.at[self.start], "right")  # of each word
        self.per_text = np.bincount(self.text, minlength=len(texts))


def _batches(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """Row number and texts of stretches of a batch with at most ``limit`` bytes (or one text)."""
    texts = batch.column(column).cast(pa.binary())
    held, size, at = [], 0, 0
    for k in range(batch.num_rows):
        t = texts[k].as_py() or b""
        if held and size + len(t) > limit:
            yield at, held
            held, size, at = [], 0, k
        held.append(t)
        size += len(t)
    if held:
        yield at, held


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for at, texts in _batches(batch, 0, BATCH_BYTES):
            by: dict[str, list[bytes]] = {}
            for t, lang in zip(texts, langs[at : at + len(texts)], strict=True):
                by.setdefault(lang, []).append(t)
            for lang, own in by.items():
                w = Words(own)
                grams, scripts = found.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(SCRIPTS, np.int64)))
                grams += np.bincount(w.bucket, minlength=BUCKETS)
                scripts += np.bincount(w.script, minlength=SCRIPTS)
            if len(found) > HELD_LANGUAGES:
                yield from _sparse(found)
                found.clear()
    yield from _sparse(found)


def _sparse(found: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, counts in found.items():
        both = np.concatenate(counts)
        slot = np.flatnonzero(both)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(slot), pa.string()), "slot": pa.array(slot.astype("i4")), "n": pa.array(both[slot])})


def _dense(key: tuple, rows: pa.Table) -> pa.Table:
    """Counts of a language's slots in one range as an array."""
    counts = np.zeros(PART_SLOTS, "<i8")
    counts[rows["slot"].to_numpy() % PART_SLOTS] = rows["n"].to_numpy()
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "part": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())})


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, rare: float = RARE):
        grams, scripts = counts[:, :BUCKETS] + 0.5, counts[:, BUCKETS:]
        self.langs = langs
        self.logp = np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32)
        self.barred = barred_scripts(scripts, rare)

    def scores(self, w: Words, a: int, b: int) -> np.ndarray:
        """Of words a to b, by language."""
        end = w.start[b] if b < len(w.start) else len(w.bucket)
        own, start = w.bucket[w.start[a] : end], w.start[a:b] - w.start[a]
        return np.stack([np.add.reduceat(p[own], start) for p in self.logp], 1) + self.barred[:, w.script[a:b]].T


def barred_scripts(scripts: np.ndarray, rare: float) -> np.ndarray:
    """By language and script: what a word in it loses."""
    barred = scripts / np.maximum(1, scripts.sum(1, keepdims=True)) < rare
    barred[:, barred.all(0)] = False
    return np.where(barred, np.float32(-1e6), np.float32(0))


class SparseModel:
    """The same of many languages: a language's log probability of an unseen trigram, and what seen ones have more, by bucket."""

    def __init__(self, langs: list[str], lang: np.ndarray, slot: np.ndarray, n: np.ndarray, rare: float = RARE):
        self.langs = langs
        of, gram = lang.astype(np.int64), slot < BUCKETS
        scripts = np.zeros((len(langs), SCRIPTS))
        scripts[of[~gram], slot[~gram] - BUCKETS] = n[~gram]
        self.barred = barred_scripts(scripts, rare)
        total = np.bincount(of[gram], n[gram], len(langs)) + 0.5 * BUCKETS
        self.base = np.log(0.5 / total)
        order = np.lexsort((of[gram], slot[gram]))
        self.lang, self.more = of[gram][order].astype(np.int32), (np.log(n[gram] + 0.5) - np.log(0.5))[order].astype(np.float32)
        self.place = np.searchsorted(slot[gram][order], np.arange(BUCKETS + 1))

    def scores(self, w: Words, a: int, b: int) -> np.ndarray:
        end, k = w.start[b] if b < len(w.start) else len(w.bucket), len(self.langs)
        own, grams = w.bucket[w.start[a] : end], np.diff(np.append(w.start[a:b], end))
        word, many = np.repeat(np.arange(b - a), grams), self.place[own + 1] - self.place[own]
        at = np.repeat(self.place[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        more = np.bincount(np.repeat(word, many) * k + self.lang[at], self.more[at], (b - a) * k).reshape(b - a, k)
        return more + grams[:, None] * self.base + self.barred[:, w.script[a:b]].T


def learn(docs: DataFrame, text="text", lang="lang", rare: float = RARE) -> Model | SparseModel:
    """Counts all rows of ``docs`` with a language."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    found = rows.select("lang").distinct().count()
    sums = rows.mapInArrow(_count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    if found > MAX_LANGUAGES:
        got = sums.toArrow()
        names = pc.unique(got["lang"]).to_pylist()
        names.sort()
        lang = pc.index_in(got["lang"], pa.array(names, pa.string())).to_numpy()
        return SparseModel(names, lang, got["slot"].to_numpy(), got["n"].to_numpy(), rare)
    sums = sums.withColumn("part", F.floor(F.col("slot") / PART_SLOTS).cast("int"))
    got = sums.groupBy("lang", "part").applyInArrow(_dense, "lang string, part int, counts binary").collect()
    langs = sorted({r.lang for r in got})
    counts = np.zeros((len(langs), -(-(BUCKETS + SCRIPTS) // PART_SLOTS), PART_SLOTS))
    for r in got:
        counts[langs.index(r.lang), r.part] = np.frombuffer(r.counts, "<i8")
    return Model(langs, counts.reshape(len(langs), counts.shape[1] * PART_SLOTS)[:, : BUCKETS + SCRIPTS], rare)


def viterbi(score: np.ndarray, length: np.ndarray, penalty: float) -> np.ndarray:
    """Best label per word of several texts: score is (word, text, language), padded; length the words of each text."""
    steps, texts, _ = score.shape
    best, rows = score[0].copy(), np.arange(texts)
    back = np.zeros(score.shape, np.int16)
    own = np.arange(score.shape[2], dtype=np.int16)
    for t in range(1, steps):
        top = best.argmax(1)
        jump = best[rows, top][:, None] - penalty
        stay = best >= jump
        back[t] = np.where(stay, own, top[:, None])
        # texts that have ended keep their scores
        best = np.where((t < length)[:, None], np.where(stay, best, jump) + score[t], best)
    path = np.zeros((steps, texts), np.int16)
    last = best.argmax(1)
    for t in range(steps - 1, -1, -1):
        path[t] = last
        last = np.where(t < length, back[t][rows, last], last) if t else last
    return path


def path_of(model: Model | SparseModel, w: Words, first: int, last: int, penalty: float) -> np.ndarray:
    """Best label of each of a text's words, as ``viterbi`` finds it, in windows: what is kept is a bit per word and language, and each word's best language."""
    k = len(model.langs)
    size, best, stays, tops = max(1, WINDOW_SCORES // k), None, [], []
    for a in range(first, last, size):
        for row in model.scores(w, a, min(last, a + size)):
            if best is None:
                best = row
                continue
            top = int(best.argmax())
            stay = best >= best[top] - penalty
            best = np.where(stay, best, best[top] - penalty) + row
            stays.append(np.packbits(stay))
            tops.append(top)
    path = np.empty(last - first, np.int64)
    path[-1] = best.argmax()
    for t in range(last - first - 1, 0, -1):
        own = path[t]
        path[t - 1] = own if stays[t - 1][own >> 3] >> (7 - (own & 7)) & 1 else tops[t - 1]
    return path


def label(model: Model | SparseModel, texts: list[bytes], penalty: float) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """Language, score and spans (start and end word, lang) of each text."""
    w, k = Words(texts), len(model.langs)
    names, share = ["und"] * len(texts), np.zeros(len(texts))
    spans: list[list[dict]] = [[] for _ in texts]
    if not k or not len(w.start):
        return names, share, spans
    begin = np.concatenate([[0], np.cumsum(w.per_text)])
    order = np.argsort(w.per_text, kind="stable")
    order = order[w.per_text[order] > 0]
    path = np.zeros(len(w.start), np.int64)
    at = len(order)
    if isinstance(model, SparseModel):
        for d in order.tolist():
            path[begin[d] : begin[d + 1]] = path_of(model, w, int(begin[d]), int(begin[d + 1]), penalty)
        at = 0
    else:
        score = model.scores(w, 0, len(w.start))
    while at:  # longest first; as many texts as keep the padded block small
        steps = int(w.per_text[order[at - 1]])
        few = order[max(0, at - max(1, min(GROUP, 2_000_000 // (steps * k)))) : at]
        at -= len(few)
        n = w.per_text[few]
        t = np.arange(steps)[:, None]
        inside = t < n
        block = np.where(inside[..., None], score[np.minimum(begin[few] + t, len(score) - 1)], 0)
        got = viterbi(block, n, penalty)
        path[(begin[few] + t)[inside]] = got[inside]
    total = np.bincount(w.text, w.letters, len(texts))
    for d in np.flatnonzero(total):
        x = texts[d]
        if x.isascii() or _ASCII_LETTER.search(x) or any(c.isalpha() for c in x.decode()):  # marks and digits of other scripts alone are no letters
            own = path[begin[d] : begin[d + 1]]
            weight = np.bincount(own, w.letters[begin[d] : begin[d + 1]])
            names[d], share[d] = model.langs[int(weight.argmax())], weight.max() / total[d]
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            spans[d] = [{"start": i, "end": j, "lang": model.langs[own[i]]} for i, j in zip(cuts, cuts[1:], strict=False)]
    return names, share, spans


_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def label_languages(docs: DataFrame, model: Model, doc_id="doc_id", text="text", penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, spans (array of start word, end word, lang)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = max(1 << 16, BATCH_BYTES // max(1, min(MAX_LANGUAGES, len(held.value.langs)) // 4))
        for batch in batches:
            for at, texts in _batches(batch, 1, limit):
                names, share, spans = label(held.value, texts, penalty)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(names), pa.array(share), pa.array(spans, _SPANS)], names=["doc_id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id's text modulo 3 is 1; also rows without id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    return label_languages(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
ORACLE: dict[str, str] = {}
