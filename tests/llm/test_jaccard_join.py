import random
import re

import numpy as np

from voltlake.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(UPPER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                group[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((rows[i][0], len(sets[i]), least[top(i)]) for i in range(len(rows)))


def test_against_brute_force(docs, corpus):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(docs).collect())
    assert got == brute(corpus)


def test_chains_of_links_without_a_common_pivot(spark):
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(12):  # each differs from the next in a word or two, the ends by far more
        rows.append((100 - k, " ".join(f"x{i}" if i < 2 * k else w for i, w in enumerate(base))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(df).collect())
    assert got == brute(rows)


def test_frequent_shingles_and_many_near_copies(spark):
    base = [f"v{k}" for k in range(60)]
    rows = [(k, " ".join([*base[: k % 60], f"u{k}", *base[k % 60 + 1 :]])) for k in range(150)]
    rows += [(1000 + k, " ".join([*base[:20], *(f"y{k}_{i}" for i in range(30))])) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(df).collect())
    assert got == brute(rows)


def test_lists_in_chunks_blocks_and_many_components(spark, monkeypatch):
    """Frequent prefix shingles, sets without a common pivot, and lists longer than a chunk."""
    monkeypatch.setattr(J, "CHUNK", 7)
    monkeypatch.setattr(J, "BUCKET_ENTRIES", 50)
    rng = random.Random(2)
    lines = [" ".join(f"l{k}_{i}" for i in range(rng.randint(5, 9))) for k in range(14)]
    rows = [(k, " ".join(rng.sample(lines, rng.randint(3, 6)))) for k in range(160)]
    base = [f"c{k}" for k in range(100)]
    for k in range(60):  # chains through a common core
        own = list(base)
        for i in range(k // 6):
            own[(7 * i + k % 3) % 100] = f"z{i}_{k % 4}"
        rows.append((500 - k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(df).collect())
    assert got == brute(rows)


def test_skipping_loses_no_pair():
    rng = np.random.default_rng(4)
    for _ in range(20):
        n = rng.integers(1, 120, 300)
        pos = (rng.random(300) * (n - J._need(n, 80) + 1)).astype(np.int64)
        left = np.flatnonzero(rng.random(300) < 0.4)
        want = {(a, b) for a in left.tolist() for b in range(300) if 100 * n[a] >= 80 * n[b] and 100 * n[b] >= 80 * n[a] and 180 * min(n[a] - pos[a], n[b] - pos[b]) >= 80 * (n[a] + n[b])}
        a, b = J.skipping_pairs(n, pos, left, 80, skip=8)
        assert len(a) == len(want) and set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_derived_intersections_are_exact():
    import pyarrow as pa

    rng = random.Random(3)
    cell = lambda x: np.array(sorted(x), "<u8").tobytes()
    for _ in range(50):
        p, a, b = (set(rng.sample(range(60), rng.randint(20, 50))) for _ in range(3))
        batch = pa.RecordBatch.from_pydict({"a": [b"a"], "b": [b"b"], "a_n": [len(a)], "b_n": [len(b)], "pivot_n": [len(p)], "a_less": [cell(p - a)], "b_less": [cell(p - b)], "a_more": [cell(a - p)], "b_more": [cell(b - p)]})
        assert next(J._derive(iter([batch])))["both"].to_pylist() == [len(a & b)]


def test_empty_and_null_ids(spark, none):
    assert J.near_duplicates(none).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, J.near_duplicates(df).collect()), key=str) == [(4, 2, 4), (None, 0, None), (None, 2, 4)]
