"""Merkle manifest of a dataset: leaves get their places by rank in bitmaps, slot arrays reduce the levels.

Each row is a leaf, H(doc_id, source, lang, n_chars, text). The leaves of a source ascend by doc_id; runs of three
consecutive nodes become their hash until one is left, the subroot; subroots, by source, reduce alike to the root.

**Ranks without sorting.** Per source, doc_ids are a bitmap kept as its non-empty 64-bit words, merged by ``bit_or`` with partial
aggregation. A popcount directory stands over the words: counts of 1024 neighbouring words add up to a node of the next level, and a
prefix runs over the children of one node only, so no window holds more than 1024 rows, however many ids a source has. The rank of an
id is its word's offset plus the ones below its bit.

**Levels.** ``DEPTH`` levels are reduced at a time: nodes meet by (key, rank div 3^DEPTH) in an array whose slot is the rank's
remainder, at most 243 of them, and are hashed level by level inside the row. Paths come back from the top, a block's own siblings in
front of its parents'. A source with any share of the rows is many such arrays.

Nulls are written ``-``; a null source is a source of its own (first in order), null doc_ids come before all others and aren't tampered
with. Rows that repeat a doc_id in a source are ordered by their leaf; equal rows are leaves of their own beside each other. Ids that
repeat are found by their word's count and placed by slots of their leaves' first bits, so one id with any number of rows is many
windows. Texts may be of any length; further columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltlake.llm.common import CRC_TABLE_SQL, bounded, crc_sql, discard, staged, table

FAN, DEPTH = 3, 5
BLOCK = FAN**DEPTH
#: Bits of a child's number in the popcount directory; words up to which their table is broadcast.
CHILD_BITS, BROADCAST_WORDS = 10, 50_000
#: Rows of one repeated id that a window orders, copies of a row that are unpacked at once, sources that a task numbers.
SLOT_ROWS, COPIES, SOURCES = 8192, 65_536, 50_000
PATH = "array<struct<left:string,right:string>>"
#: What a leaf holds, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*values: Column) -> Column:
    """SHA-256 (lower-case hex) of the values in order, each as its bytes' number, a colon and itself, null as a dash."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[part(v.cast("string")) for v in values]), 256)


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _node(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def _ones_below(bits: Column, bit: Column) -> Column:
    return F.bit_count(bits.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))))


def _directory(words: DataFrame) -> DataFrame:
    """Adds ``before``, the rows in front of each word of its key. words (staged): key, word, rows and more."""
    levels = [words.withColumn("node", F.col("word"))]
    while True:
        at = staged(levels[-1].groupBy("key", F.shiftright("node", CHILD_BITS).alias("node")).agg(F.sum("rows").alias("rows")), "directory")
        levels.append(at)
        if at.groupBy("key").count().filter("count > 1").isEmpty():
            break
    before = levels[-1].select("key", "node", F.lit(0).cast("long").alias("before"))
    inside = F.coalesce(F.sum("rows").over(Window.partitionBy("key", "up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    for level in levels[-2::-1]:
        parents = before.select("key", F.col("node").alias("up"), F.col("before").alias("_parent"))
        inner = level.withColumn("up", F.shiftright("node", CHILD_BITS)).withColumn("_inside", inside)
        before = inner.join(parents, ["key", "up"]).withColumn("before", F.col("_inside") + F.col("_parent")).drop("up", "_inside", "_parent")
    out = staged(before.drop("node"), "words")
    discard(*levels[1:])
    return out


def _repeated(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """The rows of repeated ids with ``within``, their place among the rows of their id. repeats: key, word, bit, extra."""
    place = ["key", "word", "bit"]
    held = rows.join(repeats, place).groupBy(*place, "extra", *[c for c in rows.columns if c not in place]).agg(F.count(F.lit(1)).alias("copies"))
    depth = F.greatest(F.lit(0), F.ceil(F.log2((F.col("extra") + 1) / SLOT_ROWS))).cast("int")
    first = F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long")
    held = staged(held.withColumn("slot", F.call_function("shiftright", first, 60 - depth)), "repeated")
    totals = held.groupBy(*place, "slot").agg(F.sum("copies").alias("n"))
    ahead = lambda keys, order, n: F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*place, "slot", ahead(place, "slot", "n").alias("_base"))
    held = held.withColumn("_in", ahead([*place, "slot"], "leaf", "copies")).join(totals, [*place, "slot"])
    runs = held.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("copies") - 1, COPIES)))).repartition("key", "leaf", "run")
    copy = F.explode(F.sequence(F.col("run") * COPIES, F.least((F.col("run") + 1) * COPIES, F.col("copies")) - 1))
    return runs.withColumn("_copy", copy).withColumn("within", F.col("_base") + F.col("_in") + F.col("_copy")).select(*rows.columns, "within")


def ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with ``rank`` (place in their key by doc_id) and ``n`` (rows of the key), and the keys with n.

    rows: key (never null), doc_id, leaf and more.
    """
    word = F.coalesce(F.shiftright("doc_id", 6) + ((1 << 57) + 1), F.lit(0))  # null ids have the word before all others
    rows = rows.withColumn("word", word).withColumn("bit", F.coalesce(F.col("doc_id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    words = staged(rows.groupBy("key", "word").agg(F.bit_or(one).alias("bits"), F.count(F.lit(1)).alias("rows")), "bitmap")
    sizes = staged(words.groupBy("key").agg(F.sum("rows").alias("n")), "sizes")
    out, crowded, extras = _directory(words), words.filter("rows > bit_count(bits)").select("key", "word"), None
    if not crowded.isEmpty():
        repeats = rows.join(crowded, ["key", "word"]).groupBy("key", "word", "bit").agg((F.count(F.lit(1)) - 1).alias("extra")).filter("extra > 0")
        repeats = staged(repeats, "repeats")
        extras = repeats.groupBy("key", "word").agg(F.collect_list(F.struct("bit", "extra")).alias("extras"))
        out = out.join(extras, ["key", "word"], "left")
    else:
        out = out.withColumn("extras", F.lit(None).cast("array<struct<bit:int,extra:long>>"))
    out = bounded(staged(out.join(bounded(sizes, BROADCAST_WORDS), "key").select("key", "word", "bits", "before", "extras", "n"), "ranks"), BROADCAST_WORDS)
    below = F.aggregate(F.filter(F.coalesce("extras", F.array()), lambda x: x["bit"] < F.col("bit")), F.lit(0).cast("long"), lambda s, x: s + x["extra"])
    rank = F.col("before") + _ones_below(F.col("bits"), F.col("bit")) + below
    if extras is not None:
        single = rows.join(bounded(repeats.select("key", "word", "bit"), BROADCAST_WORDS), ["key", "word", "bit"], "left_anti").withColumn("within", F.lit(0).cast("long"))
        rows = single.unionByName(_repeated(rows, repeats))
    else:
        rows = rows.withColumn("within", F.lit(0).cast("long"))
    placed = rows.join(out, ["key", "word"]).withColumn("rank", rank + F.col("within"))
    return placed.drop("word", "bit", "bits", "before", "extras", "within"), sizes


def _run_of(level: str):
    return lambda i: _node(F.slice(level, i * FAN + 1, F.lit(FAN)))


def _reduced(blocks: DataFrame) -> DataFrame:
    """Adds l0, ..., lDEPTH: the hashes of a block's nodes, level by level, as far as its key has levels."""
    out = blocks.withColumn("l0", F.transform("slots", lambda s: s["h"]))
    for k in range(DEPTH):
        runs = F.sequence(F.lit(0), _div(F.size(f"l{k}") - 1, FAN).cast("int"))
        made = F.transform(runs, _run_of(f"l{k}"))
        out = out.withColumn(f"l{k + 1}", F.when(F.col("n") > FAN**k, made).otherwise(F.col(f"l{k}")))
    return out


def _siblings(slot: Column) -> Column:
    """What stands left and right of the slot's node in its run, level by level inside the block."""
    steps = []
    for k in range(DEPTH):
        at = _div(slot, FAN**k).cast("int")
        own = (at % FAN).cast("int")
        left = F.array_join(F.slice(f"l{k}", at - own + 1, own), "")
        right = F.array_join(F.slice(f"l{k}", at + 2, FAN - 1 - own), "")
        steps.append(F.when(F.col("n") > FAN**k, F.struct(left.alias("left"), right.alias("right"))))
    return F.array_compact(F.array(*steps)).cast(PATH)


def _step(nodes: DataFrame, *further: str) -> DataFrame:
    """nodes (key, rank, n, h and further columns) as blocks: key, block, n, slots, l0, ..., lDEPTH."""
    slot = F.struct((F.col("rank") % BLOCK).cast("int").alias("slot"), "h", *further)
    blocks = nodes.groupBy("key", _div(F.col("rank"), BLOCK).alias("block")).agg(F.sort_array(F.collect_list(slot)).alias("slots"), F.first("n").alias("n"))
    return _reduced(blocks)


def reduce(nodes: DataFrame, largest: int, *further: str) -> tuple[list[DataFrame], DataFrame]:
    """The staged blocks of each step from the leaves up, and key, root. largest: the most nodes of a key."""
    steps = []
    while True:
        steps.append(staged(_step(nodes, *(further if not steps else ())), "blocks"))
        top = steps[-1].select("key", "block", "n", F.get(f"l{DEPTH}", F.lit(0)).alias("h"))
        largest = -(-largest // BLOCK)
        if largest <= 1:
            return steps, top.select("key", F.col("h").alias("root"))
        nodes = top.select("key", F.col("block").alias("rank"), _div(F.col("n") + BLOCK - 1, BLOCK).alias("n"), "h")


def paths(steps: list[DataFrame], top: DataFrame) -> DataFrame:
    """key, block, up: for each block of leaves the siblings above it. top: key, up for what stands above the roots."""
    up = top.select("key", F.lit(0).cast("long").alias("block"), "up")
    for blocks in steps[:0:-1]:
        own = F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), F.concat(_siblings(s["slot"]), F.col("up")).alias("up")))
        held = blocks.join(up, ["key", "block"]).select("key", "block", F.explode(own).alias("x"))
        up = staged(held.select("key", (F.col("block") * BLOCK + F.col("x.slot")).alias("block"), "x.up"), "paths")
    return up


def _ordered(keys: DataFrame) -> DataFrame:
    """key, rank: bytewise order of the keys, numbered range by range."""
    ranges = max(1, -(-keys.count() // SOURCES))
    dealt = staged(keys.select("key").repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return dealt.withColumn("_in", inside).join(counts, "part").select("key", (F.col("_before") + F.col("_in")).alias("rank"))


def manifest(docs: DataFrame, tampered: Column, tampered_text: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of docs (doc_id, source, lang, n_chars, text).

    ``tampered`` says which rows hold ``tampered_text`` now: their leaf is hashed again and folded with the original siblings.
    """
    fields = [F.col(c) for c in FIELDS]
    again = F.when(tampered & F.col("text").isNotNull(), leaf_hash(*fields[:-1], tampered_text))
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"), leaf_hash(*fields).alias("leaf"), again.alias("again"))
    placed, sizes = ranked(rows.withColumn("doc_id", F.col("doc_id").cast("long")))
    largest = sizes.agg(F.max("n")).first()[0]
    sources, nodes = sizes.count(), placed.withColumnRenamed("leaf", "h")
    steps, subroots = reduce(nodes, largest or 1, "doc_id", "again")
    subroots = staged(subroots, "subroots")
    tops = subroots.join(_ordered(sizes), "key").select(F.lit("").alias("key"), F.col("key").alias("source"), "rank", F.lit(sources).cast("long").alias("n"), F.col("root").alias("h"))
    heads, root = reduce(tops, sources, "source")
    none = root.select("key", F.array().cast(PATH).alias("up"))
    above = heads[0].join(paths(heads, none), ["key", "block"]).join(root.select("key", "root"), "key")
    own = F.transform("slots", lambda s: F.struct(s["source"].alias("key"), s["h"].alias("subroot"), F.concat(_siblings(s["slot"]), F.col("up")).alias("up")))
    above = staged(above.select(F.explode(own).alias("x"), "root").select("x.*", "root"), "tops")
    blocks = steps[0].join(paths(steps, above.select("key", "up")), ["key", "block"]).join(bounded(above.select("key", "subroot", "root"), BROADCAST_WORDS), "key")

    def leaf(s: Column) -> Column:
        return F.struct(s["doc_id"].alias("doc_id"), s["h"].alias("leaf"), F.coalesce(s["again"], s["h"]).alias("now"), F.concat(_siblings(s["slot"]), F.col("up")).alias("path"))

    fold = lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256)
    out = blocks.select(F.explode(F.transform("slots", leaf)).alias("x"), "subroot", "root").select("x.*", "subroot", "root")
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), F.aggregate("path", F.col("now"), fold).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return manifest(table(spark, sf_dir, "documents"), even, F.replace("text", F.lit("\n"), F.lit("")))


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLE = {
    "op13_merkle_manifest": f"""
WITH RECURSIVE {CRC_TABLE_SQL},
parts AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') ||
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM documents),
leaves AS MATERIALIZED (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS again,
    {crc_sql('CAST(doc_id AS VARCHAR)')} AS crc,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM parts CROSS JOIN crc_of),
nodes AS (SELECT source, 0 AS lv, pos, n, leaf AS h FROM leaves
  UNION ALL SELECT source, lv + 1, pos // 3, CAST(ceil(min(n) / 3.0) AS BIGINT), sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY source, lv, pos // 3),
subs AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lv, pos, n, subroot AS h FROM subs
  UNION ALL SELECT lv + 1, pos // 3, CAST(ceil(min(n) / 3.0) AS BIGINT), sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lv, pos // 3),
own AS (SELECT l.doc_id, l.source, n.lv, string_agg(n.h, '' ORDER BY n.pos) FILTER (WHERE n.pos < l.pos // CAST(pow(3, n.lv) AS BIGINT)) AS a,
    string_agg(n.h, '' ORDER BY n.pos) FILTER (WHERE n.pos > l.pos // CAST(pow(3, n.lv) AS BIGINT)) AS b
  FROM leaves l JOIN nodes n ON l.source IS NOT DISTINCT FROM n.source AND n.n > 1 AND n.pos // 3 = l.pos // CAST(pow(3, n.lv + 1) AS BIGINT) GROUP BY ALL),
top AS (SELECT s.source, n.lv, string_agg(n.h, '' ORDER BY n.pos) FILTER (WHERE n.pos < s.pos // CAST(pow(3, n.lv) AS BIGINT)) AS a,
    string_agg(n.h, '' ORDER BY n.pos) FILTER (WHERE n.pos > s.pos // CAST(pow(3, n.lv) AS BIGINT)) AS b
  FROM subs s JOIN tops n ON n.n > 1 AND n.pos // 3 = s.pos // CAST(pow(3, n.lv + 1) AS BIGINT) GROUP BY ALL),
steps AS (SELECT doc_id, source, lv, coalesce(a, '') AS a, coalesce(b, '') AS b FROM own
  UNION ALL SELECT l.doc_id, l.source, 100 + t.lv, coalesce(t.a, ''), coalesce(t.b, '') FROM leaves l JOIN top t ON l.source IS NOT DISTINCT FROM t.source),
path AS (SELECT doc_id, list({{'a': a, 'b': b}} ORDER BY lv) AS p FROM steps GROUP BY doc_id),
done AS (SELECT l.doc_id, l.leaf, s.subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(coalesce(array_to_string(list_transform(p.p, lambda x: x.a || x.b), ''), '')) AS proof_sha256,
    list_reduce(list_prepend(CASE WHEN l.crc % 2 = 0 THEN l.again ELSE l.leaf END, list_transform(coalesce(p.p, []), lambda x: x.a || '|' || x.b)),
      lambda h, x: sha256(string_split(x, '|')[1] || h || string_split(x, '|')[2])) AS folded_root
  FROM leaves l JOIN subs s ON l.source IS NOT DISTINCT FROM s.source LEFT JOIN path p ON l.doc_id = p.doc_id)
SELECT *, folded_root = root AS verified FROM done"""
}
