"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

A window is ten consecutive words of an item (a shorter item is one window). Its tokens are its shingles of three
consecutive words (all its words, if it has fewer). All of them must be in a document, so the prefix that must be joined is one
token: the rarest, by its count over all documents.

1. One pass over the documents unpacks their shingles and keeps the places (document key, position, hash) of those that
   some window has; their table is broadcast if it has at most ``known_rows`` hashes, else the narrow places are shuffled.
2. Counts of these places order each window's tokens by rarity; a window with a token that no document has can't occur.
3. Places of a window's rarest token give candidates; positional bound: the window must start inside the document.
4. A candidate stays if all the window's tokens stand at their offsets (a join with the same places, not with texts; length bound: the last one ends
   inside the document).
5. What is left is compared word by word with the texts of these documents only. Their keys are broadcast if there are at
   most ``broadcast_rows``, else that join is shuffled.

So a text moves only if it holds a window, or is a candidate in a join too large to broadcast, and never beside each of its words.
Null and empty texts have no words. Repeated rows are reported once each. A null item_id contaminates
but isn't listed. Other columns of either table aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltlake.llm.common import bounded, canonical, discard, staged, table

WINDOW_WORDS, SHINGLE = 10, 3


def _words(text: Column) -> Column:
    canon = canonical(text)
    return F.when(canon == "", F.array().cast("array<string>")).otherwise(F.split(canon, " "))


def row_key(doc_id: str, text: str) -> Column:
    """Hash of id and text: tells apart rows with the same id."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def shingles(words: Column, size: int) -> Column:
    """Hash of each ``size`` consecutive words."""
    one = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), one)).otherwise(F.array().cast("array<bigint>"))


def windows_of(items: DataFrame, item_id: str, item_text: str, size: int) -> DataFrame:
    """One row per distinct window, staged: t (its words), len, ids (items that hold it), tokens (hashes of its shingles), s (words of a shingle)."""
    item = items.select(F.col(item_id).cast("string").alias("id"), _words(F.col(item_text)).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    wins = item.select("id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("w"))
    wins = wins.groupBy("w").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    tokens = shingles(F.col("w"), SHINGLE)
    for s in range(SHINGLE - 1, 0, -1):
        tokens = F.when(F.size("w") == s, shingles(F.col("w"), s)).otherwise(tokens)
    return staged(wins.select(F.array_join("w", " ").alias("t"), F.size("w").alias("len"), "ids", tokens.alias("tokens"), F.least(F.size("w"), F.lit(SHINGLE)).alias("s")), "windows")


def places(docs: DataFrame, known: DataFrame, sizes: list[int], doc_id: str, text: str, known_rows: int) -> DataFrame:
    """k, pos, h of the documents' shingles that are among the known ones, staged; equal rows of documents count once."""
    words = docs.select(row_key(doc_id, text).alias("k"), _words(F.col(text)).alias("words"))
    if len(sizes) == 1:
        seen = words.select("k", F.posexplode(shingles(F.col("words"), sizes[0])).alias("pos", "h"))
    else:  # items of one or two words have tokens of their own
        placed = F.concat(*[F.transform(shingles(F.col("words"), s), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for s in sizes])
        seen = words.select("k", F.explode(placed).alias("x")).select("k", "x.*")
    return staged(seen.join(bounded(known, known_rows), "h", "left_semi").distinct(), "places")


def candidates(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, size: int, broadcast_rows: int, known_rows: int) -> DataFrame:
    """k, start, t, len, ids of the places where all of a window's shingles stand, staged."""
    wins = windows_of(items, item_id, item_text, size)
    known = staged(wins.select(F.explode("tokens").alias("h")).distinct(), "vocabulary")
    sizes = sorted(r.s for r in wins.select("s").distinct().collect()) or [SHINGLE]
    seen = places(docs, known, sizes, doc_id, text, known_rows)
    rarity = seen.groupBy("h").count()
    ranked = wins.select("t", "len", "ids", "tokens", F.posexplode("tokens").alias("off", "h")).join(rarity, "h")
    ranked = ranked.groupBy("t").agg(*[F.first(c).alias(c) for c in ("len", "ids", "tokens")], F.min(F.struct("count", "h", "off")).alias("r"), F.count(F.lit(1)).alias("there"))
    prefixes = staged(ranked.filter(F.col("there") == F.size("tokens")).select("t", "len", "ids", "tokens", "r.h", "r.off"), "prefixes")
    found = seen.join(bounded(prefixes, broadcast_rows), "h").select("k", (F.col("pos") - F.col("off")).alias("start"), "t").filter("start >= 0").distinct()
    found = staged(found, "candidates")
    tokens = prefixes.select("t", F.posexplode("tokens").alias("off", "h"), F.size("tokens").alias("all"))
    asked = found.join(tokens, "t").select("k", "t", "start", (F.col("start") + F.col("off")).alias("pos"), "h", "all")
    whole = asked.join(seen, ["k", "pos", "h"]).groupBy("k", "t", "start", "all").count().filter(F.col("count") == F.col("all"))
    out = staged(whole.join(prefixes.select("t", "len", "ids"), "t").select("k", "start", "t", "len", "ids"), "occurrences")
    discard(wins, known, seen, prefixes, found)
    return out


def hits(docs: DataFrame, items: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text", size=WINDOW_WORDS, broadcast_rows=200_000, known_rows=2_000_000) -> DataFrame:
    """doc_id, k, start, len, ids: each occurrence of a window in a document."""
    found = candidates(docs, items, doc_id, text, item_id, item_text, size, broadcast_rows, known_rows)
    keys = bounded(staged(found.select("k").distinct(), "keys"), broadcast_rows)
    own = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("k"), F.col(text).alias("text"))
    own = own.join(keys, "k", "left_semi").select("doc_id", "k", _words(F.col("text")).alias("words"))
    same = F.array_join(F.slice("words", F.col("start") + 1, F.col("len")), " ") == F.col("t")
    return own.join(found, "k").filter(same).select("doc_id", "k", "start", "len", "ids").distinct()


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, k, n_words, n_hit, items (sorted array of item ids as strings) for every row of ``docs``."""
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    by = Window.partitionBy("k", "doc_id").orderBy("start", "len")
    before = F.max(F.col("start") + F.col("len")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("len")
    new = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    per = (
        hits(docs, items, **options)
        .select("doc_id", "k", "ids", new.alias("new"))
        .groupBy("k", "doc_id")
        .agg(F.sum("new").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
    )
    per = per.select(F.col("k").alias("k_"), F.col("doc_id").alias("doc_id_"), "n_hit", "items")
    canon = canonical(F.col(text))
    n_words = F.when(canon == "", 0).otherwise(F.length(canon) - F.length(F.replace(canon, F.lit(" "))) + 1)
    base = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("k"), n_words.cast("long").alias("n_words"))
    joined = base.join(per, (F.col("k") == F.col("k_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_")), "left")
    return joined.select(
        "doc_id", "k", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLE = {
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
i AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
       lambda s: array_to_string(w[s:s + 9], ' '))) AS t FROM i WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM iw),
dp AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM dp),
h AS (SELECT DISTINCT dw.doc_id, dw.n, dw.s, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.t = iw.t),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""
}
