import hashlib
import random
import zlib

from pyspark.sql import functions as F

from voltlake.llm import merkle_manifest as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def fold(nodes):
    """Root and, for each node, what stands left and right of it level by level."""
    sides, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(place):
            run = p - p % 3
            sides[k].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + 3])))
            place[k] = p // 3
        nodes = [h(*nodes[a : a + 3]) for a in range(0, len(nodes), 3)]
    return nodes[0], sides


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees.append(fold([leaf(r, r[4]) for r in groups[s]]))
    root, tops = fold([t[0] for t in trees])
    out = []
    for s, (subroot, sides), above in zip(order, trees, tops, strict=True):
        for r, own in zip(groups[s], sides, strict=True):
            path = own + above
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            now = leaf(r, r[4].replace("\n", "") if tampered else r[4])
            for a, b in path:
                now = h(a, now, b)
            out.append((r[0], leaf(r, r[4]), subroot, root, h(*(a + b for a, b in path)), now, now == root))
    return sorted(out, key=str)


def made(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, key string, rank int, leaf int").repartition(3)
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return sorted(map(tuple, M.manifest(df, even, F.replace("text", F.lit("\n"), F.lit(""))).collect()), key=str)


def some(rng, n, sources, ids):
    return [(d, rng.choice(sources), rng.choice(["en", "de", None]), rng.choice([1, 20, None]), rng.choice(["", None, "one", "two\nlines", "Ünï\n", "x" * 3000])) for d in ids[:n]]


def test_against_plain_python(spark):
    """A hot source with more leaves than a block, sources with one, nulls, negative and far ids."""
    rng = random.Random(1)
    ids = [*range(0, 900), -5, -(1 << 62), 1 << 62, (1 << 62) + 1, *range(10**9, 10**9 + 40)]
    rows = some(rng, len(ids), ["hot"] * 30 + [f"s{k}" for k in range(12)] + [None, "", "é", "z"], ids)
    rows.append((5000, "alone", "en", 3, "a\n" * 100_000))
    assert made(spark, rows) == brute(rows)


def test_repeated_ids_and_rows(spark, monkeypatch):
    """A third of the rows have no id, another third one id, and some are equal altogether."""
    monkeypatch.setattr(M, "SLOT_ROWS", 16)
    monkeypatch.setattr(M, "COPIES", 8)
    monkeypatch.setattr(M, "BROADCAST_WORDS", 3)
    rng = random.Random(2)
    rows = [(None, rng.choice(["a", None]), None, k, f"{k}\n") for k in range(200)] + [(66, "a", None, k // 2, f"{k // 3}\n") for k in range(200)]
    rows += some(rng, 200, ["a", "b"], list(range(200))) + [(7, "a", "en", 1, "same\n")] * 50 + [(None, None, None, None, None)] * 20
    assert made(spark, rows) == brute(rows)


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(M, "SOURCES", 40)
    rows = [(k, f"s{k % 260}", "en", 1, "t\n") for k in range(300)]
    assert made(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert made(spark, []) == []
    assert made(spark, [(3, None, None, None, None)]) == brute([(3, None, None, None, None)])
