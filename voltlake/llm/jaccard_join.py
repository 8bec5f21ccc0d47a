"""N-gram Jaccard join of sets of word shingles, with skipping by position and derived answers.

1. Each text becomes its set of distinct shingles (hashed) and a 96-bit digest of the set; equal sets are one
   from here on, represented by their digest, whatever number of copies there is.
2. All (shingle, set) pairs meet by shingle once, packed (see ``packed``), which tells each set which of its
   shingles any other set holds, and how many do. A set with fewer shared ones than the threshold asks of
   its size links with nothing and is done; these are nearly all sets of different texts.
3. The others are indexed: shingles by rarity, unshared ones first, and of those only the prefix that any
   linked set must meet.
4. Each index list's pivot (the set in which the shingle stands foremost) is solved first: its intersections with the
   list's sets are counted, and linked ones are joined to one component. So a group of near copies costs about one
   verification per set.
5. Only lists that still hold different components go on, cut into chunks of at most CHUNK entries. Such a list is an array sorted by set
   size, in blocks of SKIP entries with the block's least size and its greatest remainder behind the position; an entry skips the
   blocks whose sizes, or whose remainder and its own, can't reach the required intersection.
6. Answers of pairs that are left are derived from their most similar solved set, where both were counted against the same pivot p:
   bounds of the two known intersections decide most; the rest is |p| - |(p-a) + (p-b)| + |(a-p) & (b-p)| of the stored
   differences. Only sets without a common pivot, or very different from it, are compared as a whole.
7. Components by smallest label: neighbours, then jumps, until nothing changes.

A link is 100 * intersection >= 80 * union. Null, empty and wordless texts have an empty set and no links.
Repeated rows are copies like others; a doc_id that occurs with several texts has one row per row.
Shingles are compared by 48-bit hashes: two sets of n different shingles share some n * n / 2^48 by mistake, one in a thousand pairs of
500,000 shingles each; a pair is decided wrongly only if it also is that close to the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm import packed
from voltlake.llm.common import discard, staged, table

SHINGLE, PERCENT = 5, 80
KEY, RECORD = 12, 16  # bytes of a set's digest; with its size behind
BLOCK_PAIRS, BATCH_BYTES = 1_000_000, 1 << 18
CHUNK, SKIP, BUCKET_ENTRIES = 4096, 64, 400_000

_low = np.arange(256, dtype=np.uint8)
_low[ord("A") : ord("Z") + 1] += 32
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_FACTORS = packed.mixed(np.arange(1, 65, dtype=np.uint64))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (48 bits) of each text; the whole word sequence is one if it is shorter."""
    data = _low[np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)]
    word = ~_space[data]
    edge = np.flatnonzero(np.diff(word)) + 1
    start, end = edge[::2], edge[1::2]
    total = packed.prefix_hash(packed.BYTE_VALUES[data])
    _, down = packed.powers(len(data))
    words = packed.mixed((total[end] - total[start]) * down[start])
    bounds = np.searchsorted(start, np.cumsum([1, *(len(t) + 1 for t in texts)]))
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        rolled += words[k : len(words) - size + 1 + k] * _FACTORS[k]
    rolled = packed.mixed(rolled) >> np.uint64(64 - packed.TOKEN_BITS)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = (words[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(packed.mixed(np.array([whole])) >> np.uint64(64 - packed.TOKEN_BITS))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    texts, held, size, at = batch.column(column).cast(pa.binary()), [], 0, 0
    for k in range(batch.num_rows):
        t = texts[k].as_py() or b""
        if held and size + len(t) > BATCH_BYTES:
            yield at, held
            held, size, at = [], 0, k
        held.append(t)
        size += len(t)
    if held:
        yield at, held


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=KEY).digest()


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _texts(batch, 1):
                sets = shingle_sets(texts, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary())], names=["doc_id", "n", "key"])
        packed.give_back()

    return run


def _pairs(size: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = packed.Flush(blocks, TaskContext.get().partitionId())
        for batch in batches:
            for _, texts in _texts(batch, 0):
                for s in shingle_sets(texts, size):
                    if len(s):
                        flush.add(_digest(s) + len(s).to_bytes(4, "little"), s)
                    if flush.full() and (rows := flush.rows()):
                        yield rows
        if rows := flush.rows():
            yield rows
        packed.give_back()

    return run


def _need(n: int, percent: int) -> int:
    """Fewest shingles of a set of n that a linked set must share."""
    return -(-n * percent // 100)


def _shared(key: tuple, rows: pa.Table) -> pa.Table:
    out = packed.shared(rows)
    packed.give_back()
    return out


def _survivors(percent: int):
    """Of the sets of a flush: those that share enough; tokens by rarity."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        records, idx, tok, n = packed.at_home(rows, RECORD)
        order = np.lexsort((tok, n, idx))
        idx, tok = idx[order], tok[order]
        keep = []
        for k, own in packed.runs(idx):
            raw = records[k].tobytes()
            size, found = int.from_bytes(raw[KEY:], "little"), tok[own]
            if len(found) >= _need(size, percent):
                keep.append((raw[:KEY], size, len(found), found.astype("<u8").tobytes()))
        return pa.Table.from_batches([packed.arrow(keep, "key binary, n int, shared int, toks binary")])

    return run


def _prefixes(percent: int):
    """Index entries of the shared part of each set's prefix: tok, key, n, pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tok, row, pos = [], [], []
            n, shared = batch.column("n").to_numpy(), batch.column("shared").to_numpy()
            for r in range(batch.num_rows):
                lone = int(n[r] - shared[r])
                prefix = int(n[r]) - _need(int(n[r]), percent) + 1 - lone
                tok.append(np.frombuffer(batch.column("toks")[r].as_buffer(), "<u8", prefix))
                row.append(np.full(prefix, r))
                pos.append(np.arange(lone, lone + prefix, dtype=np.int32))
            if row:
                row = np.concatenate(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tok).astype(np.int64)), batch.column("key").take(pa.array(row)), pa.array(n[row]), pa.array(np.concatenate(pos))], names=["tok", "key", "n", "pos"])

    return run


def _tokens(column, r: int) -> np.ndarray:
    return np.frombuffer(column[r].as_buffer(), "<u8")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intersection of a with b, and both differences unless they are larger than half of a."""
    for batch in batches:
        a, b, n, m = (batch.column(c) for c in ("a_toks", "b_toks", "a_n", "b_n"))
        both, less, more, size = [], [], [], []
        for r in range(batch.num_rows):
            x, y = np.sort(_tokens(a, r)), np.sort(_tokens(b, r))
            got = np.intersect1d(x, y, True)
            both.append(len(got))
            size.append(len(y))
            near = n[r].as_py() + m[r].as_py() - 2 * len(got) <= n[r].as_py() // 2
            # these are shared shingles only; the unshared ones of a set are in no intersection
            less.append(np.setdiff1d(y, got, True).tobytes() if near else None)
            more.append(np.setdiff1d(x, got, True).tobytes() if near else None)
        cols = [batch.column(c) for c in ("a", "b", "a_n", "b_n")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(both, pa.int32()), pa.array(less, pa.binary()), pa.array(more, pa.binary()), pa.array(size, pa.int32())], names=["a", "b", "a_n", "b_n", "both", "less", "more", "b_shared"])


VERIFIED = "a binary, b binary, a_n int, b_n int, both int, less binary, more binary, b_shared int"


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intersection of a with b from their differences to the same pivot: both hold what it holds but for what either lacks, and what both have besides."""
    for batch in batches:
        lack_a, lack_b, own_a, own_b, size = (batch.column(c) for c in ("a_less", "b_less", "a_more", "b_more", "pivot_n"))
        both = [
            size[r].as_py() - len(np.union1d(_tokens(lack_a, r), _tokens(lack_b, r))) + len(np.intersect1d(_tokens(own_a, r), _tokens(own_b, r), True))
            for r in range(batch.num_rows)
        ]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "a_n", "b_n")), pa.array(both, pa.int32())], names=["a", "b", "a_n", "b_n", "both"])


def _reach(n, m, percent: int):
    """Fewest shared shingles of linked sets of n and m."""
    return -(-percent * (n + m) // (100 + percent))


def skipping_pairs(n: np.ndarray, pos: np.ndarray, left: np.ndarray, percent: int, skip: int = SKIP) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (entry of ``left``, entry) of an index list that size and position admit; blocks of a list in order of size are skipped as a whole."""
    order = np.argsort(n, kind="stable")
    size, rest = n[order], (n - pos)[order]  # rest: this shingle and those behind it
    starts = np.arange(0, len(order), skip)
    least, most = size[starts], np.maximum.reduceat(size, starts)
    behind = np.maximum.reduceat(rest, starts)
    own_n, own_rest = n[left][:, None], (n - pos)[left][:, None]
    open_ = (100 * most >= percent * own_n) & (100 * own_n >= percent * least) & (np.minimum(own_rest, behind) >= _reach(own_n, least, percent))
    row, block = np.nonzero(open_)
    at = starts[block][:, None] + np.arange(skip)
    row, at = np.repeat(row, skip), at.ravel()
    there = at < len(order)
    row, at = left[row[there]], order[at[there]]
    fits = (100 * n[at] >= percent * n[row]) & (100 * n[row] >= percent * n[at]) & (np.minimum((n - pos)[row], (n - pos)[at]) >= _reach(n[row], n[at], percent))
    return row[fits], at[fits]


PAIR = "a binary, b binary, a_n int, b_n int, pivot binary, pivot_n int, sure boolean"


def _open_pairs(percent: int):
    """Of the lists (or chunks of long ones) of a bucket: pairs of different components that may link."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        named = ("key", "comp", "main", "pivot")
        every = pa.chunked_array([c for name in named for c in rows[name].chunks], pa.binary()).combine_chunks().dictionary_encode()
        order = pc.sort_indices(every.dictionary)
        rank = np.empty(len(order) + 1, np.int64)
        rank[order.to_numpy()], rank[-1] = np.arange(len(order)), -1  # numbers in the order of keys, so that both cells of a pair agree
        keys, comp, main, pivot = rank[pc.fill_null(every.indices, -1).to_numpy(zero_copy_only=False)].reshape(4, -1)
        n, pos, side, known, pivot_n = (rows[c].to_numpy().astype(np.int64) for c in ("n", "pos", "side", "both", "pivot_n"))
        by = np.argsort(rows["list"].to_numpy(), kind="stable")
        found = [np.zeros((0, 2), np.int64)]
        for _, own in packed.runs(rows["list"].to_numpy()[by]):
            e = by[own]
            left = np.flatnonzero((side[e] != RIGHT) & (comp[e] != main[e]))
            for at in range(0, len(left), 256):
                a, b = skipping_pairs(n[e], pos[e], left[at : at + 256], percent)
                a, b = e[a], e[b]
                # outside the main component both ends are on the left; such a pair counts once
                fits = (side[b] != LEFT) & (comp[a] != comp[b]) & ((comp[b] == main[b]) | (keys[a] < keys[b]))
                a, b = a[fits], b[fits]
                most = np.minimum(known[a], known[b]) + np.minimum(n[a] - known[a], n[b] - known[b])
                maybe = ~alike(a, b, pivot, known) | (most >= _reach(n[a], n[b], percent))
                found.append(np.stack([a[maybe], b[maybe]], 1))
        a, b = np.concatenate(found).T
        _, once = np.unique(keys[a] * (len(order) + 1) + keys[b], return_index=True)
        a, b = a[once], b[once]
        same = alike(a, b, pivot, known)
        sure = same & (known[a] + known[b] - pivot_n[a] >= _reach(n[a], n[b], percent))
        values = every.dictionary.take(order)
        name = lambda i, there=None: values.take(pa.array(i, pa.int64(), mask=None if there is None else ~there))
        cols = [name(keys[a]), name(keys[b]), pa.array(n[a], pa.int32()), pa.array(n[b], pa.int32()), name(pivot[a], same), pa.array(pivot_n[a], pa.int32()), pa.array(sure)]
        return pa.table(dict(zip((f.split()[0] for f in PAIR.split(", ")), cols, strict=True)))

    return run


def alike(a: np.ndarray, b: np.ndarray, pivot: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether entries a and b were counted against the same set."""
    return (pivot[a] == pivot[b]) & (known[a] >= 0) & (known[b] >= 0)


WHOLE, LEFT, RIGHT = 0, 1, 2  # of a list's cell: all entries, those outside the main component, those to compare them with


def _enough(both, n, m, percent: int):
    return 100 * both >= percent * (n + m - both)


def _possible(percent: int):
    """Size and position bounds of a pair of index entries a, b."""
    n, m = F.col("a_n"), F.col("b_n")
    most = 1 + F.least(n - 1 - F.col("a_pos"), m - 1 - F.col("b_pos"))
    return (100 * n >= percent * m) & (100 * m >= percent * n) & _enough(most, n, m, percent)


def _named(df: DataFrame, side: str, *columns: str) -> list:
    return [F.col(c).alias(f"{side}_{c}" if c != "key" else side) for c in columns]


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """key, comp: the smallest key that edges (a, b) reach; every vertex has a row. ``edges`` and the result are staged."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    labels = staged(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("c")).select("key", F.least("key", "c").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "comp"), "b").groupBy(F.col("a").alias("key")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "key").select("key", "comp", F.least("comp", "near").alias("to"))
        jump = labels.select(F.col("key").alias("to"), F.col("comp").alias("far"))
        step = staged(step.join(jump, "to", "left").select("key", F.least("to", F.coalesce("far", "to")).alias("comp"), (F.least("to", F.coalesce("far", "to")) != F.col("comp")).alias("new")), "labels")
        discard(labels)
        labels = step
        if step.filter("new").isEmpty():
            break
    out = staged(vertices.select("key").join(labels.select("key", "comp"), "key", "left").select("key", F.coalesce("comp", "key").alias("comp")), "components")
    discard(labels)
    return out


def open_cells(entries: DataFrame) -> DataFrame:
    """Entries (with ``tok``, ``outside``) with list, side and bucket: lists of up to CHUNK entries whole, longer ones in cells of a chunk
    of those outside the main component and a chunk of all, so that no task holds a frequent shingle's whole list."""
    sizes = entries.groupBy("tok").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("outside").cast("long")).alias("out"))
    spread = lambda c: F.ceil(F.col(c) / CHUNK).cast("int")
    sizes = sizes.filter(F.col("all") > CHUNK).select("tok", spread("all").alias("rights"), spread("out").alias("lefts"))
    joined = entries.join(sizes, "tok", "left")
    chunk = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    cell = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    zero = F.lit(0)
    left = F.when(F.col("outside"), F.transform(F.sequence(zero, F.col("rights") - 1), lambda j: cell(LEFT, chunk("lefts"), j))).otherwise(F.array().cast("array<struct<side:int,i:int,j:int>>"))
    right = F.transform(F.sequence(zero, F.col("lefts") - 1), lambda i: cell(RIGHT, i, chunk("rights")))
    cells = F.when(F.col("rights").isNull(), F.array(cell(WHOLE, zero, zero))).otherwise(F.concat(left, right))
    return joined.withColumn("cell", F.explode(cells)).select("*", "cell.side", F.xxhash64("tok", "cell.i", "cell.j").alias("list")).drop("cell", "rights", "lefts")


def linked_sets(docs: DataFrame, sets: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """key, comp: component of each set that shares enough with others to link at all."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    blocks = max(12, -(-total // BLOCK_PAIRS))
    rows = docs.select(F.col(text).alias("text")).filter("text is not null")
    meet = rows.mapInArrow(_pairs(size, blocks), packed.SCHEMA).repartitionById(blocks, F.col("block")).groupBy("block")
    shares = meet.applyInArrow(_shared, packed.RETURNED)
    kept = shares.groupBy("flush").applyInArrow(_survivors(percent), "key binary, n int, shared int, toks binary")
    kept = staged(kept.dropDuplicates(["key"]), "survivors")
    index = staged(kept.mapInArrow(_prefixes(percent), "tok long, key binary, n int, pos int"), "index")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(kept.select(*_named(kept, "a", "key", "n", "toks")), "a").join(kept.select(*_named(kept, "b", "key", "n", "toks")), "b")
        return staged(pairs.mapInArrow(_verify, VERIFIED), "verified")

    linked = _enough(F.col("both"), F.col("a_n"), F.col("b_n"), percent)
    # with the pivot of each list
    pivot = index.groupBy("tok").agg(F.min(F.struct("pos", "key", "n")).alias("p"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    star = index.join(pivot, "tok").select("tok", *_named(index, "a", "key", "n", "pos"), F.col("p.key").alias("b"), F.col("p.n").alias("b_n"), F.col("p.pos").alias("b_pos"))
    first = verified(star.filter("a <> b").filter(_possible(percent)).select("a", "b").distinct())
    comps = components(kept, first.filter(linked))
    edges = across(kept, index, first, comps, percent, verified)
    discard(index, first, kept)
    if edges.isEmpty():
        discard(edges)
        return comps
    groups = components(comps.select(F.col("comp").alias("key")).distinct(), edges)
    out = staged(comps.join(groups.select(F.col("key").alias("comp"), F.col("comp").alias("top")), "comp").select("key", F.col("top").alias("comp")), "components")
    discard(edges, groups, comps)
    return out


def across(kept: DataFrame, index: DataFrame, first: DataFrame, comps: DataFrame, percent: int, verified) -> DataFrame:
    """a, b: staged links between components, from the lists that hold several."""
    of = index.join(comps, "key")
    main = of.groupBy("tok").agg(F.min(F.struct("pos", "key", "comp")).alias("p"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    main = staged(main.filter("low <> high").select("tok", F.col("p.comp").alias("main")), "lists")
    # each set's most similar solved set; a pivot is its own
    nearest = first.select(F.col("a").alias("key"), F.struct("both", F.col("b").alias("pivot"), F.col("b_shared").alias("pivot_n")).alias("v"))
    itself = first.select(F.col("b").alias("key"), F.struct(F.col("b_shared").alias("both"), F.col("b").alias("pivot"), F.col("b_shared").alias("pivot_n")).alias("v"))
    best = nearest.union(itself).groupBy("key").agg(F.max("v").alias("v"))
    entries = of.join(main, "tok").join(best, "key", "left")
    entries = entries.select("tok", "key", "n", "pos", "comp", "main", (F.col("comp") != F.col("main")).alias("outside"), "v.pivot", F.coalesce("v.pivot_n", F.lit(0)).alias("pivot_n"), F.coalesce("v.both", F.lit(-1)).alias("both"))
    entries = staged(entries, "open")
    cells = open_cells(entries)
    buckets = max(12, -(-entries.count() // BUCKET_ENTRIES))
    cells = cells.withColumn("bucket", F.pmod("list", F.lit(buckets)))
    pairs = staged(cells.groupBy("bucket").applyInArrow(_open_pairs(percent), PAIR).distinct(), "pairs")
    discard(entries, main)
    # by differences to the same pivot where these are known, else whole
    solved = first.filter("less is not null").select("a", F.col("b").alias("pivot"), "less", "more")
    solved = solved.unionByName(first.select(F.col("b").alias("a"), F.col("b").alias("pivot"), F.lit(b"").alias("less"), F.lit(b"").alias("more")).distinct())
    of_side = lambda x: solved.select(F.col("a").alias(x), "pivot", F.col("less").alias(f"{x}_less"), F.col("more").alias(f"{x}_more"))
    unsure = pairs.filter("not sure").join(of_side("a"), ["a", "pivot"], "left").join(of_side("b"), ["b", "pivot"], "left")
    unsure = staged(unsure, "unsure")
    derivable = F.col("a_less").isNotNull() & F.col("b_less").isNotNull()
    derived = unsure.filter(derivable).mapInArrow(_derive, "a binary, b binary, a_n int, b_n int, both int")
    whole = verified(unsure.filter(~derivable).select("a", "b"))
    linked = _enough(F.col("both"), F.col("a_n"), F.col("b_n"), percent)
    more = pairs.filter("sure").select("a", "b").union(derived.filter(linked).select("a", "b")).union(whole.filter(linked).select("a", "b"))
    name = lambda side: comps.select(F.col("key").alias(side), F.col("comp").alias(f"{side}_comp"))
    edges = staged(more.join(name("a"), "a").join(name("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).distinct(), "edges")
    discard(pairs, unsure, whole)
    return edges


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included) for every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = staged(rows.mapInArrow(_sets(size), "doc_id long, n long, key binary"), "sets")
    comps = linked_sets(rows, sets, "text", size, percent)
    classes = sets.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    joined = staged(classes.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key")), "classes")
    discard(comps)
    found = joined.groupBy("comp").agg(F.min("least").alias("component_id"))
    # only classes of several rows, or in a component with a smaller id, need another id than the document's own
    by_key = joined.join(found, "comp").filter("copies > 1 or not component_id <=> least").select("key", "component_id")
    return sets.join(by_key, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_ngram_jaccard": op6_ngram_jaccard}
ORACLE = {
    "op6_ngram_jaccard": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS t FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS v, doc_id AS u FROM d UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.m AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(u) AS m FROM r GROUP BY v) c ON c.v = d.doc_id"""
}
