"""Suffix-array dedup: removes bytes covered by strings of ``length`` bytes that start in an earlier document too.

A suffix array over every byte of a corpus would move about sixteen bytes per byte of text through each
of several sorts. So the text is first cut, without loss, into pieces that must meet:

0. Equal texts become one, with the smallest doc_id that has it; a later copy is covered from end to end.
1. A string of 50 bytes contains 27 strings of 24 bytes; the one with the smallest hash is its anchor. Equal
   strings have equal anchors. Runs of strings with one anchor are a piece of about 60 bytes.
2. All anchors meet once, packed (see ``packed``); only pieces whose anchor stands in two different texts can
   hold a repeated string. Only these are made, next to their documents, and staged.
3. Equal pieces become one with its smallest document: a passage that a third of all documents hold is
   one piece from here on. Pieces are dealt by anchor into bounded buckets. An anchor with more than ANCHOR_PIECES
   distinct pieces (at the edges of such a passage each document has its own) goes to no bucket: its strings are
   dealt by their own digests, and grouped by them.
4. In each bucket the difference-cover algorithm sorts all suffixes of its pieces: suffixes at places 1 and 2 modulo 3
   are named by sorted triples, names recur (up to the depth that covers ``length`` bytes), the remaining third is
   sorted by its first byte and the rank behind, and merged. Adjacent suffixes with equal prefixes of ``length`` bytes form
   a group, whose smallest document is what counts.
5. Each piece's places take that answer (a join that Spark splits where a piece is frequent), and documents
   get their covered ranges.

Null and short texts lose nothing. Rows with a null id neither remove nor lose anything. Rows with one id
are one document: its rows don't remove from each other. Overlaps and repeats inside a document don't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlake.llm import packed
from voltlake.llm.common import bounded, discard, staged, table

LENGTH, ANCHOR = 50, 24
BLOCK_PAIRS, BATCH_BYTES, PIECE_STRINGS, BUCKET_BYTES = 1_000_000, 1 << 18, 64, 1 << 20
ANCHOR_PIECES = 1 << 13  # of some hundred bytes each
TASK_BYTES = 8 << 20  # of pieces that a task sorts; it holds some twenty bytes for each
BROADCAST_ROWS = 1_000_000  # of one number
KEY = 12  # bytes of a text's digest


def anchors(texts: list[bytes], length: int, anchor: int) -> Iterator[np.ndarray]:
    """Per text the anchor (48 bits) of each string of ``length`` bytes, by start."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    total = packed.prefix_hash(packed.BYTE_VALUES[data])
    _, down = packed.powers(len(data))
    n = max(0, len(data) - anchor + 1)
    low = packed.mixed((total[anchor : anchor + n] - total[:n]) * down[:n]) >> np.uint64(64 - packed.TOKEN_BITS)
    span, wide = length - anchor + 1, 1
    while wide * 2 <= span:  # minima over doubled spans, then two that overlap
        low = np.minimum(low[:-wide], low[wide:]) if len(low) > wide else low[:0]
        wide *= 2
    if wide < span:
        low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :]) if len(low) > span - wide else low[:0]
    low = packed.mixed(low) >> np.uint64(64 - packed.TOKEN_BITS)  # minima crowd near 0; spread again
    at = 0
    for t in texts:
        yield low[at : at + max(0, len(t) - length + 1)]
        at += len(t)


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    texts, held, size, at = column.cast(pa.binary()), [], 0, 0
    for k in range(len(texts)):
        t = texts[k].as_py() or b""
        if held and size + len(t) > BATCH_BYTES:
            yield at, held
            held, size, at = [], 0, k
        held.append(t)
        size += len(t)
    if held:
        yield at, held


def _pairs(length: int, anchor: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = packed.Flush(blocks, TaskContext.get().partitionId())
        for batch in batches:
            for _, texts in _texts(batch.column(0)):
                for k, own in enumerate(anchors(texts, length, anchor)):
                    if len(own):
                        flush.add(hashlib.md5(texts[k]).digest()[:KEY], np.unique(own))
                    if flush.full() and (rows := flush.rows()):
                        yield rows
        if rows := flush.rows():
            yield rows
        packed.give_back()

    return run


def _shared(key: tuple, rows: pa.Table) -> pa.Table:
    out = packed.shared(rows)
    packed.give_back()
    return out


def _per_text(key: tuple, rows: pa.Table) -> pa.Table:
    """Of a flush: the shared anchors of each text, sorted."""
    records, idx, tok, _ = packed.at_home(rows, KEY)
    order = np.lexsort((tok, idx))
    tok = tok[order].astype("<u8")
    return pa.Table.from_batches([packed.arrow([(records[i].tobytes(), tok[own].tobytes()) for i, own in packed.runs(idx[order])], "th binary, toks binary")])


PIECE = "tok long, piece binary, doc_id long, th binary, pos long"


def _pieces(length: int, anchor: int):
    """Pieces of a document with shared anchors: runs of strings with one anchor, at most PIECE_STRINGS long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, texts in _texts(batch.column(1)):
                tok, piece, row, pos = [], [], [], []
                for k, own in enumerate(anchors(texts, length, anchor)):
                    if not len(own):
                        continue
                    shared = np.frombuffer(batch.column(3)[at + k].as_buffer(), "<u8")
                    place = np.minimum(np.searchsorted(shared, own), len(shared) - 1)
                    new = np.append(True, own[1:] != own[:-1])
                    first = np.flatnonzero(new)
                    since = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
                    start = np.flatnonzero(since % PIECE_STRINGS == 0)
                    end = np.append(start[1:], len(own))
                    keep = shared[place[start]] == own[start]
                    for a, b in zip(start[keep].tolist(), end[keep].tolist(), strict=True):
                        piece.append(texts[k][a : b + length - 1])
                        pos.append(a)
                    tok.append(own[start[keep]])
                    row.append(np.full(int(keep.sum()), at + k))
                if piece:
                    row = np.concatenate(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tok).astype(np.int64)), pa.array(piece, pa.binary()), pa.array(ids[row]), batch.column(2).take(pa.array(row)), pa.array(pos, pa.int64())], names=["tok", "piece", "doc_id", "th", "pos"])

    return run


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of ``text`` (positive integers), in the order of their first ``depth`` symbols at least.

    The difference cover is {1, 2} modulo 3: its suffixes are named by the rank of their triples, the string of names is
    sorted the same way with a third of the depth, and the suffixes at multiples of 3 are merged in.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate([text.astype(np.uint64), np.zeros(3, np.uint64)])
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    bits = np.uint64(21)
    if int(text.max()) < 1 << 7:  # bytes of few kinds: counting instead of sorting
        key = (t[sample] << np.uint64(14) | t[sample + 1] << np.uint64(7) | t[sample + 2]).astype(np.int64)
        used = np.zeros(1 << 21, np.int64)
        used[key] = 1
        number = np.cumsum(used)[key] - 1
        kinds = int(used.sum())
    elif int(text.max()) < 1 << 21:
        names, number = np.unique((t[sample] << bits | t[sample + 1]) << bits | t[sample + 2], return_inverse=True)
        kinds = len(names)
    else:
        order = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
        rows = np.stack([t[sample + k] for k in range(3)])[:, order]
        new = np.append(True, (rows[:, 1:] != rows[:, :-1]).any(0))
        number = np.empty(len(sample), np.int64)
        number[order] = np.cumsum(new) - 1
        kinds = int(new.sum())
    if kinds == len(sample) or depth <= 3:
        order = np.argsort(number, kind="stable")
    else:
        order = suffix_array(number + 1, -(-depth // 3))
    ranked = sample[order]
    rank = np.zeros(n + 3, np.uint64)
    rank[ranked] = np.arange(1, len(ranked) + 1, dtype=np.uint64)
    wide = np.uint64(32)
    rest = np.arange(0, n, 3)
    key = t[rest] << wide | rank[rest + 1]
    rest = rest[np.argsort(key, kind="stable")]
    ranked = ranked[ranked < n]
    one, two = ranked[ranked % 3 == 1], ranked[ranked % 3 == 2]
    # how many sampled suffixes of either kind stand before each of the rest
    before = np.searchsorted(t[one] << wide | rank[one + 1], t[rest] << wide | rank[rest + 1])
    if int(t.max()) < 1 << 21 and len(sample) < 1 << 21:  # symbols and ranks fit in 21 bits
        pair = lambda i: ((t[i] << bits | t[i + 1]) << bits) | rank[i + 2]
    else:
        pair = _pair_ranks(t, rank, two, rest)
    before = before + np.searchsorted(pair(two), pair(rest))
    out = np.empty(n, np.int64)
    place = np.maximum.accumulate(before) + np.arange(len(rest))  # suffixes equal up to the depth may stand in any order
    mask = np.ones(n, bool)
    mask[place] = False
    out[place] = rest
    out[mask] = ranked
    return out


def _pair_ranks(t: np.ndarray, rank: np.ndarray, two: np.ndarray, rest: np.ndarray):
    """A key for (symbol, symbol, rank) where symbols or ranks are too large to pack: the first two by rank."""
    places = np.concatenate([two, rest])
    order = np.lexsort((t[places + 1], t[places]))
    a, b = t[places][order], t[places + 1][order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    key = np.zeros(len(t), np.uint64)
    key[places[order]] = np.cumsum(new).astype(np.uint64)
    return lambda i: key[i] << np.uint64(32) | rank[i + 2]


def least_documents(data: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For each string of ``length`` bytes of pieces laid end to end, by piece and start, the smallest document of any piece that holds it."""
    kinds = np.zeros(256, np.int64)
    kinds[data] = 1
    code = np.cumsum(kinds) + 1  # bytes in their order, densely; 1 stands between pieces
    owner = np.repeat(np.arange(len(sizes)), sizes)
    text = np.ones(len(data) + len(sizes), np.int64)
    raw = np.zeros(len(text) + length, np.uint8)
    place = np.arange(len(data)) + owner
    text[place] = code[data]
    raw[place] = data
    ends = np.cumsum(sizes + 1) - 1  # where each piece's separator stands
    order = suffix_array(text, length)
    own = np.searchsorted(ends, order, "left")
    whole = order + length <= ends[own]
    order, own = order[whole], own[whole]
    views = np.lib.stride_tricks.sliding_window_view(raw, length)
    same = np.zeros(len(order), bool)
    for at in range(1, len(order), 1 << 15):  # adjacent prefixes
        stop = min(len(order), at + (1 << 15))
        rows = views[order[at - 1 : stop]]
        same[at:stop] = (rows[1:] == rows[:-1]).all(1)
    first = np.flatnonzero(~same)
    least = np.minimum.reduceat(docs[own], first)
    by_place = np.empty(len(text), np.int64)
    starts = np.zeros(len(text), bool)
    by_place[order] = np.repeat(least, np.diff(np.append(first, len(order))))
    starts[order] = True
    return by_place[starts]


ANSWER = "tok long, h long, least array<long>, runs array<long>"


def _answers(length: int):
    """Of a bucket: for pieces in which some string has a smaller document than the piece's largest, runs of their strings' smallest documents."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["tok"].to_numpy(), kind="stable")
        tok, low, high, h = (rows[c].to_numpy()[order] for c in ("tok", "low", "high", "h"))
        pieces = rows["piece"].combine_chunks()
        pieces = (pieces.chunk(0) if isinstance(pieces, pa.ChunkedArray) else pieces).take(pa.array(order))
        bounds = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1, pieces.offset * 4)
        data = np.frombuffer(pieces.buffers()[2], np.uint8)
        sizes = np.diff(bounds).astype(np.int64)
        strings = sizes - length + 1
        least = np.repeat(low, strings)
        at = np.concatenate([[0], np.cumsum(strings)])
        anchor = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
        many = np.diff(np.append(anchor, len(tok)))
        # an anchor's only piece has no other to share with; the others are sorted, whole anchors at a time
        several, held, size = np.flatnonzero(many > 1), [], 0

        def sort() -> None:
            k = np.concatenate([np.arange(anchor[g], anchor[g] + many[g]) for g in held])
            own = np.concatenate([data[bounds[anchor[g]] : bounds[anchor[g] + many[g]]] for g in held])
            found = least_documents(own, sizes[k], low[k], length)
            least[np.repeat(at[k] - np.concatenate([[0], np.cumsum(strings[k])[:-1]]), strings[k]) + np.arange(len(found))] = found

        for g in several.tolist():
            held.append(g)
            size += int(bounds[anchor[g] + many[g]] - bounds[anchor[g]])
            if size >= BUCKET_BYTES:
                sort()
                held, size = [], 0
        if held:
            sort()
        keep = np.minimum.reduceat(least, at[:-1]) < high
        owner = np.repeat(np.arange(len(tok)), strings)
        own = keep[owner]
        least, owner = least[own], owner[own]
        new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (least[1:] != least[:-1]))[: len(owner)])
        runs = np.diff(np.append(new, len(owner)))
        per = np.bincount(owner[new], minlength=len(tok))[keep]
        packed.give_back()
        offsets = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
        return pa.table({"tok": pa.array(tok[keep]), "h": pa.array(h[keep]), "least": pa.ListArray.from_arrays(offsets, pa.array(least[new])), "runs": pa.ListArray.from_arrays(offsets, pa.array(runs))})

    return run


def _covered(length: int):
    """Ranges of a piece's place that strings with a smaller document cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pos = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            least, runs = batch.column(3), batch.column(4)
            n = np.diff(least.offsets.to_numpy())
            row = np.repeat(np.arange(len(ids)), n)
            least, runs = least.flatten().to_numpy(), runs.flatten().to_numpy()
            before = np.cumsum(runs) - runs
            first = np.cumsum(n) - n
            start = pos[row] + before - before[first[row]]
            hit = np.flatnonzero(least < ids[row])
            row, start, end = row[hit], start[hit], (start + runs)[hit] + length - 1
            new = np.append(True, (row[1:] != row[:-1]) | (np.diff(hit) > 1))[: len(hit)]  # adjacent runs are one range
            row, start, end = row[new], start[new], end[np.append(new[1:], True)[: len(hit)]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), batch.column(1).take(pa.array(row)), pa.array(start), pa.array(end)], names=["doc_id", "th", "start", "end"])

    return run


def text_key(text: Column) -> Column:
    """The first bytes of the text's digest; equal texts are known by them."""
    return F.unhex(F.substring(F.md5(text.cast("binary")), 1, 2 * KEY))


def crowded_anchors(pieces: DataFrame) -> DataFrame:
    """tok of the anchors with more than ANCHOR_PIECES distinct pieces, staged; at most one for so many rows of ``pieces``."""
    cells = max(1, 4 * pieces.count() // ANCHOR_PIECES)
    cell = F.pmod(F.xxhash64("tok"), F.lit(cells)).alias("cell")
    # such an anchor fills its cell of hashes by itself; few other cells are full, and only theirs are counted by anchor
    full = staged(pieces.groupBy(cell).count().filter(F.col("count") > ANCHOR_PIECES).select("cell"), "full")
    kinds = pieces.select("tok", "h", cell).join(bounded(full, BROADCAST_ROWS), "cell", "left_semi").select("tok", "h").distinct()
    out = staged(kinds.groupBy("tok").count().filter(F.col("count") > ANCHOR_PIECES).select("tok"), "crowded")
    discard(full)
    return out


def _string_answers(kinds: DataFrame, length: int) -> DataFrame:
    """What ``_answers`` finds, by grouping strings by their digests, so that no task needs all pieces of an anchor."""
    cuts = F.expr(f"transform(sequence(1, octet_length(piece) - {length - 1}), i -> substring(piece, i, {length}))")
    strings = kinds.select("tok", "h", "low", "high", F.posexplode(cuts).alias("at", "string"))
    strings = strings.select("tok", "h", "low", "high", "at", text_key(F.col("string")).alias("sh"))
    least = strings.groupBy("sh").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = strings.join(least, "sh", "left").withColumn("least", F.coalesce("least", "low"))
    per = found.groupBy("tok", "h").agg(F.max("high").alias("high"), F.array_sort(F.collect_list(F.struct("at", "least"))).alias("own"))
    per = per.withColumn("least", F.col("own.least")).filter(F.array_min("least") < F.col("high"))
    return per.select("tok", "h", "least", F.array_repeat(F.lit(1).cast("long"), F.size("least")).alias("runs"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, th (key of the text), start, end: byte ranges covered by strings that an earlier document holds; ``docs`` is doc_id, text, th."""
    rows = docs.filter((F.octet_length("text") >= length) & F.col("doc_id").isNotNull())
    texts = staged(rows.groupBy("th").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min(F.octet_length("text")).alias("size")), "texts")
    size = texts.agg(F.sum("size")).first()[0] or 0
    blocks = max(12, -(-size // (BLOCK_PAIRS * 14)))
    meet = rows.select("text").mapInArrow(_pairs(length, anchor, blocks), packed.SCHEMA).repartitionById(blocks, F.col("block")).groupBy("block")
    shares = meet.applyInArrow(_shared, packed.RETURNED)
    shared = shares.groupBy("flush").applyInArrow(_per_text, "th binary, toks binary")
    shared = shared.dropDuplicates(["th"])  # copies in several flushes came back with the same anchors
    shared = staged(shared.join(texts.select("th", F.col("low").alias("doc_id")), "th"), "anchors")
    found = rows.join(shared, ["doc_id", "th"]).select("doc_id", "text", "th", "toks").mapInArrow(_pieces(length, anchor), PIECE)
    pieces = staged(found.withColumn("h", F.xxhash64("piece")), "pieces")
    discard(shared)
    kinds = pieces.groupBy("tok", "h").agg(F.first("piece").alias("piece"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    held = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0  # pieces overlap, so they are several times the texts
    buckets = max(12, -(-held // TASK_BYTES))
    crowded = crowded_anchors(pieces)
    several = not crowded.isEmpty()
    apart = bounded(crowded, BROADCAST_ROWS)
    few = kinds.join(apart, "tok", "left_anti") if several else kinds
    few = few.withColumn("bucket", F.pmod(F.xxhash64("tok"), F.lit(buckets)).cast("int")).repartitionById(buckets, F.col("bucket"))
    answers = few.groupBy("bucket").applyInArrow(_answers(length), ANSWER)
    own = staged(kinds.join(apart, "tok", "left_semi"), "kinds") if several else crowded
    if several:
        answers = answers.unionByName(_string_answers(own, length))
    answers = staged(answers, "answers")
    discard(crowded, own)
    joined = pieces.select("tok", "h", "doc_id", "th", "pos").join(answers, ["tok", "h"]).select("doc_id", "th", "pos", "least", "runs")
    ranges = joined.mapInArrow(_covered(length), "doc_id long, th binary, start long, end long")
    # later copies of a text
    copies = rows.select("doc_id", "th").join(texts.filter("low < high"), "th").filter("doc_id > low")
    ranges = staged(ranges.unionByName(copies.select("doc_id", "th", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end"))), "ranges")
    discard(pieces, texts, answers)
    return ranges


def _cut(text: bytes, starts, ends) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes went, and in how many ranges."""
    if not starts:
        return text, 0, 0
    mask = np.zeros(len(text) + 1, np.int32)
    np.add.at(mask, np.array(starts), 1)
    np.add.at(mask, np.array(ends), -1)
    gone = np.cumsum(mask[:-1]) > 0
    spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def dedup_substrings(docs: DataFrame, doc_id="doc_id", text="text", length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """All columns of ``docs`` with kept (remaining bytes), n_bytes, n_removed, n_spans; columns of these names are replaced.

    With ``as_text`` kept is text, and bytes of characters that a cut went through are left out.
    """
    added = {"kept": T.StringType() if as_text else T.BinaryType(), "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType()}
    docs = docs.drop(*added)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), text_key(F.col(text)).alias("th"))
    ranges = repeated_ranges(rows, length)
    by = ranges.distinct().groupBy(F.col("doc_id").alias("_i"), F.col("th").alias("_h")).agg(F.collect_list("start").alias("_starts"), F.collect_list("end").alias("_ends"))
    joined = docs.join(by, (F.col(doc_id).cast("long") == F.col("_i")) & (text_key(F.col(text)) == F.col("_h")), "left").drop("_i", "_h")
    place, n = docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                few = batch.slice(at, 500)
                texts = few.column(place).cast(pa.binary()).to_pylist()
                out = [_cut(t or b"", s, e) for t, s, e in zip(texts, few.column(n).to_pylist(), few.column(n + 1).to_pylist(), strict=True)]
                sizes = [len(t or b"") for t in texts]
                kept = pa.array([o[0].decode("utf-8", "ignore") for o in out], pa.string()) if as_text else pa.array([o[0] for o in out], pa.binary())
                cols = [kept, *(pa.array(c, pa.int64()) for c in (sizes, [o[1] for o in out], [o[2] for o in out]))]
                yield pa.RecordBatch.from_arrays([*few.columns[:n], *cols], names=[*few.schema.names[:n], *added])

    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in added.items())]))


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLE: dict[str, str] = {}
