import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.llm import topk_search as K


def brute(rows, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in ok:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("dim", [3, 8, 64])
def test_against_brute_force(spark, monkeypatch, dim):
    monkeypatch.setattr(K, "BLOCK_ROWS", 64)
    rng = random.Random(dim)
    rows = [(k, [rng.choice([0.5, -0.25, rng.gauss(0, 1)]) for _ in range(dim)]) for k in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, [None] * dim), (350, [float("nan")] * dim), (400, [float("inf")] * dim), (500, []), (None, rows[1][1]), (50, rows[7][1]), (7, rows[7][1]), (600, [1.0] * (dim + 1)), (601, [2.0] * (dim + 1))]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    assert sorted(map(tuple, K.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())) == brute(rows, 5)


def test_large_values_stay_exact(spark):
    rows = [(0, [3.0e5, 1.0]), (1, [3.0e5, 2.0]), (2, [3.0e5, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, K.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())) == brute(rows, 5)


def test_scores_beyond_doubles_stay_exact(spark, monkeypatch):
    """Scores that differ by one at 2^60, in blocks with enough rows to prune, and random ones near 2^62, against Python integers."""
    monkeypatch.setattr(K, "BLOCK_ROWS", 64)
    rng, dim = random.Random(3), 24
    small = lambda total: [total / 256] + [0.0] * 15 if rng.random() < 0.5 else [0.0] * 15 + [total / 256]
    rows = [(0, [2.0**22] + [0.0] * 7 + [1 / 256] * 16)] + [(k, [2.0**22] + [0.0] * 7 + small(129 if k != 77 else 130)) for k in range(1, 200) if k % 50]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, K.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()))
    assert got == brute(rows, 5) and got[0][2:] == (77, 2**60 + 130)
    rows = [(k, [rng.uniform(1, 1.6) * 2.0**20.5 for _ in range(dim)]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, K.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()))
    assert got == brute(rows, 5) and max(r[3] for r in got) > 2**61


def test_rows_of_one_id_are_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 32)
    rng = random.Random(4)
    df = spark.createDataFrame([(7, [rng.gauss(0, 1) for _ in range(4)]) for _ in range(1000)], "vec_id long, embedding array<double>")
    rows = df.select("vec_id", K.scaled(F.col("embedding")).alias("v"))
    dealt = rows.groupBy(F.pmod(F.xxhash64("vec_id", "v"), F.lit(32))).count().collect()
    assert len(dealt) == 32 and max(r["count"] for r in dealt) < 100
    assert K.top_k(df, F.col("vec_id") % 7 == 0, 5).count() == 0  # rows with a query's own id never answer it


def test_repeated_query_ids_and_many_ties(spark, monkeypatch):
    """A third of all rows have one query's id, another third one vector."""
    monkeypatch.setattr(K, "BLOCK_ROWS", 32)
    monkeypatch.setattr(K, "QUERY_ROWS", 1)
    rng = random.Random(1)
    rows = [(100, [rng.gauss(0, 1) for _ in range(16)]) for _ in range(100)] + [(1000 + k, [0.5] * 16) for k in range(100)] + [(k, [rng.gauss(0, 1) for _ in range(16)]) for k in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, K.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()))
    assert got == brute(rows, 5)


def test_floors_prune_without_loss():
    rng = np.random.default_rng(0)
    ids, cols = np.arange(200), rng.integers(-300, 300, (24, 200)).astype(float)
    tails = [np.sqrt((cols[at:] ** 2).sum(0)) for at in range(K.STEP, 24, K.STEP)]
    for q in rng.integers(-300, 300, (20, 24)).astype(float):
        score = q @ cols
        order = np.lexsort((ids, -score))
        for floor in (K.NO_FLOOR, int(score[order[3]]), int(score[order[0]]), int(score.max()) + 1):
            got, values = K.best(ids, cols, -1, q, 5, tails, floor)
            want = [i for i in order[:5] if score[i] >= floor]
            assert got.tolist() == want and values.tolist() == score[want].tolist()


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert K.top_k(df, F.col("vec_id") % 50 == 0).count() == 0
