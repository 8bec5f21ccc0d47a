import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from voltlake.llm import toxicity as T

DATA = "/root/testdata/sf0.1"  # the smaller tables have some fifty toxic labels, too few to learn words of four languages


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = T.train(docs, labels.filter("doc_id % 3 <> 0"), T.CHAIN)
    got = T.score_toxicity(docs, chain).withColumnRenamed("toxic", "said").join(labels.filter("doc_id % 3 = 0"), "doc_id")
    r = got.agg(F.avg((F.col("said") == (F.col("toxic") == 1)).cast("int")).alias("right"), F.sum(F.when((F.col("toxic") == 0) & F.col("said"), 1).otherwise(0)).alias("wrong"), F.count(F.lit(1)).alias("n")).first()
    assert r.right > 0.97 and r.wrong <= 0.005 * r.n


def test_held_out_recall_and_false_alarms(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = T.train(docs, labels.filter("doc_id % 3 <> 0"), T.CHAIN)
    assert chain.threshold != T.THRESHOLD
    got = T.score_toxicity(docs, chain).withColumnRenamed("toxic", "said").join(labels.filter("doc_id % 3 = 0"), "doc_id")
    r = got.agg(*[F.sum(F.expr(f"int(toxic = {t} and {said})")).alias(n) for n, t, said in (("found", 1, "said"), ("toxic", 1, "true"), ("wrong", 0, "said"), ("clean", 0, "true"))]).first()
    assert r.found >= 0.86 * r.toxic and r.wrong <= 0.006 * r.clean, r


def test_threshold_weighs_missed_and_wrong_rows():
    y = np.array([1] * 4 + [0] * 100 + [1])
    p = np.concatenate([[0.9, 0.8, 0.4, 0.3], np.linspace(0.2, 0.01, 100), [0.35]])
    assert 0.2 < T.best_threshold(p, y, 0.01) < 0.3
    p[4] = 0.5  # one clean row stands among them
    assert 0.2 < T.best_threshold(p, y, 0.01) < 0.3 and 0.5 < T.best_threshold(p, y, 0.0) < 0.8
    assert T.best_threshold(p, y * 0, 0.01) == T.best_threshold(p[:0], y[:0], 0.01) == T.THRESHOLD


def test_edge_cases(spark, docs, corpus, none):
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(20)] + [(3, None, 1), (None, 1, 1)], "doc_id long, low_quality int, toxic int")
    chain = T.train(docs, labels, T.CHAIN)
    got = T.score_toxicity(docs, chain)
    assert got.count() == len(corpus) and got.filter("toxic is null or p_toxic is null").count() == 0
    assert T.score_toxicity(none, chain).count() == 0
    nothing = T.train(docs, labels.limit(0), T.CHAIN)
    assert T.score_toxicity(docs, nothing).filter("toxic").count() == 0


def test_repeated_ids_and_labels_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(k, f"other words {k}") for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1)] * 500 + [(1, 0, 0)] + [(k, 0, k % 2) for k in range(2, 40)], "doc_id long, low_quality int, toxic int")
    seen = []
    fit = T.Chain.fit

    def watched(self, x, y, **options):
        seen.append(len(x))
        return fit(self, x, y, **options)

    T.Chain.fit = watched
    try:
        T.train(docs, labels, T.CHAIN)
    finally:
        T.Chain.fit = fit
    assert seen == [40]


def test_later_label_reads_earlier_probability():
    rng = np.random.default_rng(0)
    x = np.hstack([(rng.random((400, 1)) < 0.5).astype(np.float32), np.zeros((400, 4), np.float32)])
    y = np.hstack([x[:, :1], x[:, :1]]).astype(float)
    chain = T.Chain(["w"], ["a", "b"]).fit(x, y)
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1 and chain.weights[1][-2] > 0
    p = chain.predict(x)
    assert ((p[:, 1] > 0.5) == (y[:, 1] == 1)).all()


def test_newton_steps_find_the_minimum_of_the_loss():
    """Against plain gradient descent on the same penalised loss, written anew."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3))
    y = (x @ [1.5, -2.0, 0.0] + rng.normal(size=120) > 0.3).astype(float)
    got = T.fit_logistic(x, y, 0.7)
    w = [0.0] * 4
    for _ in range(20_000):
        slope = [0.7 * w[0], 0.7 * w[1], 0.7 * w[2], 1e-3 * w[3]]
        for row, label in zip(x.tolist(), y.tolist(), strict=True):
            z = sum(a * b for a, b in zip(w, [*row, 1.0], strict=True))
            e = 1 / (1 + math.exp(-z)) - label
            slope = [s + e * v for s, v in zip(slope, [*row, 1.0], strict=True)]
        w = [a - 0.02 * s for a, s in zip(w, slope, strict=True)]
        if max(map(abs, slope)) < 1e-6:
            break
    assert np.abs(got - np.array(w)).max() < 1e-4


def test_chain_of_three_reads_all_before():
    rng = np.random.default_rng(1)
    x = np.hstack([(rng.random((900, 2)) < 0.5).astype(np.float32), rng.random((900, 4)).astype(np.float32)])
    a, b = x[:, 0], x[:, 1]
    y = np.stack([a, b, a * b], 1).astype(float)
    chain = T.Chain(["u", "v"], ["a", "b", "both"]).fit(x, y)
    assert [len(w) for w in chain.weights] == [7, 8, 9]
    p = chain.predict(x)
    assert ((p[:, 2] >= chain.threshold) == (y[:, 2] == 1)).mean() > 0.99 and p.shape == (900, 3)


def plain_scores(chain, text):
    """Probabilities of a text with a chain's weights, in plain Python."""
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", text.lower())
    own = set(words) | {"^" + w[:n] for w in words for n in (5, 7) if len(w) > n}
    letters, n = sum(len(w) for w in words), max(1, len(words))
    shape = [math.log(1 + len(words)), len(set(words)) / n, letters / n / 10, 1 - letters / max(1, len(text))]
    x = [1.0 if w in own else 0.0 for w in chain.index] + [(v - m) / s for v, m, s in zip(shape, chain.mean, chain.scale, strict=True)]
    out = []
    for w in chain.weights:
        z = sum(a * b for a, b in zip(x, w, strict=False)) + w[-1]
        out.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        x.append(out[-1])
    return out


def test_whole_query_against_plain_python(spark):
    """Chosen words and every document's probabilities, on a small corpus with a repeated id, an empty, a null and a very long text."""
    rng = random.Random(3)
    bad, fine = "idiotic rotten vileness stupidly".split(), [f"word{k}" for k in range(40)]
    rows, labels = [], []
    for k in range(400):
        toxic = k % 5 == 0
        words = [rng.choice(fine) for _ in range(rng.randint(3, 30))] + ([rng.choice(bad), rng.choice(bad)] if toxic else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 5 == 0 or k % 7 == 0), int(toxic)))
    rows += [(1000, ""), (1001, None), (1002, "fine word1 " * 20_100), (3, "idiotic " * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    chain = T.train(docs, spark.createDataFrame(labels, "doc_id long, low_quality int, toxic int"), T.CHAIN, words=12)
    assert set(bad) <= chain.index.keys()
    got = T.score_toxicity(docs, chain).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain_scores(chain, r.text or "")
        assert abs(r.p_low_quality - want[0]) < 1e-5 and abs(r.p_toxic - want[1]) < 1e-5 and r.toxic == (r.p_toxic >= chain.threshold)
    assert sum(r.toxic for r in got if r.doc_id < 400 and r.doc_id % 5 == 0) >= 78
