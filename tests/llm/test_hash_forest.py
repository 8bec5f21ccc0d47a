import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.llm import hash_forest as H


def brute(rows, k, asks):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ok = [(i, np.array(v)) for i, v in {(i, tuple(v + 0.0)) for i, v in ok}]
    queries = {}
    for i, v in ok:
        if i % asks == 0:
            queries[i] = min(queries.get(i, v), v, key=tuple)
    return {q: sorted((-float((w * v).sum()), i) for i, w in ok if i != q and len(w) == len(v))[:k] for q, v in queries.items()}


def answers(df, k, asks, **more):
    out = defaultdict(list)
    for r in H.near(df, F.col("vec_id") % asks == 0, k, **more).collect():
        out[r["query_id"]].append((r["rank"], -r["score"], r["vec_id"]))
    return {q: [(s, i) for _, s, i in sorted(found)] for q, found in out.items() if [r for r, _, _ in sorted(found)] == list(range(1, len(found) + 1))}


def share(got, want):
    assert got.keys() == {q for q, w in want.items() if w}
    for q, found in got.items():
        known = dict((i, s) for s, i in want[q])
        assert found == sorted(found) and len(found) == len(want[q])
        assert all(abs(known[i] - s) < 1e-9 for s, i in found if i in known)
    return np.mean([len({i for _, i in got[q]} & {i for _, i in w}) / len(w) for q, w in want.items() if w])


def test_all_vectors_where_there_are_few(spark):
    """Copies, ties, odd values and vectors of another length."""
    rng = random.Random(1)
    rows = [(k, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)]) for k in range(60)]
    rows += [(100, [0.0] * 4), (120, None), (140, [None] * 4), (160, [float("nan"), 1.0, 1.0, 1.0]), (180, []), (None, [1.0] * 4), (200, [1.0] * 5), (201, [2.0] * 5), (20, rows[3][1]), (7, rows[3][1]), (220, [-0.0, 0.0, 3.0, 1.0]), (300, [7.0]), rows[5]]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, v string").repartition(3)
    want = brute(rows, 6, 20)
    got = answers(df, 6, 20, recall=1.0)
    assert {q: [i for _, i in w] for q, w in got.items()} == {q: [i for _, i in w] for q, w in want.items() if w}
    assert share(got, want) == 1.0


@pytest.mark.parametrize("scale", [0.0, 1.0])
def test_recall(spark, monkeypatch, scale):
    """Many blocks, with and without norms that differ; the share asked for is reached, most candidates aren't looked at."""
    monkeypatch.setattr(H, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 24))
    vectors = centres[rng.integers(0, 40, 3000)] + 0.4 * rng.standard_normal((3000, 24))
    vectors *= np.exp(scale * rng.standard_normal((3000, 1)) / 4)
    rows = [(k, v.astype("f4").tolist()) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    assert share(answers(df, 20, 20), brute([(k, np.float32(v).tolist()) for k, v in rows], 20, 20)) >= 0.9


def test_hot_vector_and_near_copies(spark, monkeypatch):
    """A third of the rows are one vector, another third copies of it but for a billionth: they share their whole string."""
    monkeypatch.setattr(H, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    rows = [(k, base.tolist()) for k in range(300)] + [(300 + k, (base * (1 + k * 1e-10)).tolist()) for k in range(300)] + [(600 + k, rng.standard_normal(16).tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got, want = answers(df, 20, 20), brute(rows, 20, 20)
    assert share({q: w for q, w in got.items() if q < 600}, {q: w for q, w in want.items() if q < 600}) == 1.0
    assert share(got, want) >= 0.9


def test_shared_bits():
    rng = random.Random(4)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(200)] + [(5, 5), (0, 1 << 62)]
    pairs += [(a, a ^ (1 << rng.randrange(63))) for a, _ in pairs]
    want = [63 - (a ^ b).bit_length() for a, b in pairs]
    assert H.shared_bits(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])).tolist() == want


def test_fewest_candidates_are_chosen():
    profiles = {1: [100, 60, 30, 5], 2: [100, 50, 20, 10]}
    levels = {1: [3, 2, 2, 1], 2: [3, 3, 2, 0]}
    for wanted in (5, 10, 20, 30, 50, 60, 100):
        reached = [sum(x >= H.reach(profiles[q], wanted) for x in levels[q]) / 4 for q in (1, 2)]
        assert H.fitted(profiles, levels, 1, sum(reached) / 2) <= wanted
    assert H.fitted({}, {}, 7, 0.9) == 7


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert H.near(df, F.col("vec_id") % 20 == 0).count() == 0
