"""Toxicity by a classifier chain: labels are predicted one after the other, each linear model also reading the
probabilities of the labels before it, which were predicted out of fold while it was trained.

Training reads at most about ``sample_rows`` labelled rows (taken by a hash of the id, so the bound is a
parameter and the choice is repeatable); they alone are joined with the documents, by a broadcast of that
bounded id list. Spark counts in how many of them each word stands, per label; the ``words`` words per label
that tell most (likelihood ratio) are the features, with four shape figures. The chain is fitted by
Newton steps on these few columns.

Prediction is one pass over whole texts without a shuffle. Null texts count as empty. A document is toxic
if the last label's probability reaches ``threshold``, by default the one that suits its out-of-fold probabilities best. Without labelled rows nothing is toxic. Repeated
rows are judged each for itself; different labels of one id count each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlake.llm.common import SEPARATORS, table

SAMPLE_ROWS, WORDS, FOLDS, LEAST, THRESHOLD = 20_000, 192, 3, 4, 0.5
#: For the choice of the threshold: clean rows that may be found wrongly, and how many of them a missed row outweighs.
FALSE_ALARMS, MISS = 0.004, 3
#: Each label takes the one with the least out-of-fold loss.
RIDGES = (0.2, 0.6, 1.5)
#: Lengths of the word beginnings that count as features besides whole words.
PREFIXES = (5, 7)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text: str, index: dict[str, int], out: np.ndarray) -> None:
    """Presence of the words and word beginnings (^) of ``index``, then log of words, share of distinct words, letters per word, share of other characters."""
    words = _WORD.findall(text.lower())
    own = set(words)
    for n in PREFIXES:
        own.update([f"^{w[:n]}" for w in own if len(w) > n and w[0] != "^"])
    for w in own & index.keys():
        out[index[w]] = 1
    letters = sum(map(len, words))
    n = max(1, len(words))
    out[len(index) :] = np.log1p(len(words)), len(set(words)) / n, letters / n / 10, 1 - letters / max(1, len(text))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.2, steps: int = 12) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + keep * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def best_threshold(p: np.ndarray, y: np.ndarray, share: float) -> float:
    """The threshold with the least missed and wrongly found rows, a missed one counting MISS times, that finds at most
    ``share`` of the clean rows wrongly; ties to the highest. THRESHOLD where no row is of either kind."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hit, wrong = np.cumsum(y), np.cumsum(1 - y)
    if not len(y) or not 0 < hit[-1] < len(y):
        return THRESHOLD
    last = np.append(p[1:] < p[:-1], True) & (wrong <= share * wrong[-1])  # equal probabilities go together
    if not last.any():
        return THRESHOLD
    cost = np.where(last, MISS * (hit[-1] - hit) + wrong, np.inf)
    k = int(np.argmin(cost))
    return float((p[k] + p[k + 1]) / 2) if k + 1 < len(p) else float(p[k])


class Chain:
    """Linear models of ``labels`` in order."""

    def __init__(self, words: list[str], labels: list[str]):
        self.index, self.labels = {w: k for k, w in enumerate(words)}, labels
        self.weights: list[np.ndarray] = []
        self.mean = self.scale = None
        self.threshold = THRESHOLD

    def width(self) -> int:
        return len(self.index) + 4

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        shape = slice(len(self.index), None)
        out = x.astype(float)
        out[:, shape] = (out[:, shape] - self.mean) / self.scale
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, folds: int = FOLDS) -> Chain:
        shape = x[:, len(self.index) :].astype(float)
        self.mean, self.scale = shape.mean(0), shape.std(0) + 1e-9
        x = self._scaled(x)
        fold = np.arange(len(x)) % folds
        for k in range(len(self.labels)):
            tried = []
            for ridge in RIDGES:
                out_of_fold = np.zeros(len(x))
                for f in range(folds):
                    if (fold == f).any() and (fold != f).any():
                        w = fit_logistic(x[fold != f], y[fold != f, k], ridge)
                        out_of_fold[fold == f] = sigmoid(x[fold == f] @ w[:-1] + w[-1])
                tried.append((-np.log(np.clip(np.where(y[:, k] == 1, out_of_fold, 1 - out_of_fold), 1e-12, 1)).sum(), ridge, out_of_fold))
            _, ridge, out_of_fold = min(tried, key=lambda t: t[:2])
            self.weights.append(fit_logistic(x, y[:, k], ridge))
            if k + 1 < len(self.labels):
                x = np.hstack([x, out_of_fold[:, None]])
        self.threshold = best_threshold(out_of_fold, y[:, -1], FALSE_ALARMS)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros((len(x), len(self.labels)))
        x = self._scaled(x)
        for w in self.weights:
            x = np.hstack([x, sigmoid(x @ w[:-1] + w[-1])[:, None]])
        return x[:, -len(self.labels) :]


def _matrix(texts: list, index: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(index) + 4), np.float32)
    for k, t in enumerate(texts):
        features(t or "", index, x[k])
    return x


def train(docs: DataFrame, labels: DataFrame, names: list[str], doc_id="doc_id", text="text", sample_rows=SAMPLE_ROWS, words=WORDS) -> Chain:
    """A chain for the 0/1 columns ``names`` of ``labels``, in that order; rows with a null label aren't used.

    Equal label rows count once, and of several documents with a labelled id the one with the smallest text, so what is broadcast and
    what comes to the driver is bounded by ``sample_rows`` whatever repeats.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), *names).dropna().distinct()
    share = min(1.0, sample_rows / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id", *names).agg(F.min("text").alias("text")).persist()
    try:
        total = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names]).first()
        if not total["n"]:
            return Chain([], names)
        own = F.array_distinct(F.split(F.lower("text"), SEPARATORS))
        begun = [F.transform(F.filter(own, lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.lit("^"), F.left(w, F.lit(n)))) for n in PREFIXES]
        counts = rows.select(F.explode(F.array_distinct(F.concat(own, *begun))).alias("word"), *names).filter("word != ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names])
        counts = counts.filter(F.col("n") >= LEAST)
        chosen: dict[str, None] = {}
        for c in names:
            rate = F.lit(float(total[c] or 0) / total["n"])
            cell = lambda seen, expected: F.when(seen > 0, seen * F.ln(seen / F.greatest(expected, F.lit(1e-9)))).otherwise(0.0)
            gain = cell(F.col(c), F.col("n") * rate) + cell(F.col("n") - F.col(c), F.col("n") * (1 - rate))
            chosen |= dict.fromkeys(r.word for r in counts.orderBy(gain.desc(), "word").limit(words).collect())
        chain = Chain(list(chosen), names)
        index = chain.index

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1).to_pylist(), index)
                ys = [batch.column(2 + k) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), *[pa.array(v.to_pylist(), pa.float64()) for v in ys]], names=["doc_id", "x", *names])

        got = rows.select("doc_id", "text", *names).mapInArrow(run, "doc_id long, x binary, " + ", ".join(f"{c} double" for c in names)).toArrow()
        got = got.sort_by([("doc_id", "ascending")])
        x = np.frombuffer(b"".join(v.as_py() for v in got["x"]), np.float32).reshape(-1, chain.width())
        return chain.fit(x, np.stack([got[c].to_numpy() for c in names], 1))
    finally:
        rows.unpersist()


def score_toxicity(docs: DataFrame, chain: Chain, text: str = "text", threshold: float | None = None) -> DataFrame:
    """All columns of ``docs`` with p_<label> for each label and toxic; columns of these names are replaced."""
    least = chain.threshold if threshold is None else threshold
    held = docs.sparkSession.sparkContext.broadcast(chain)
    added = [f"p_{c}" for c in chain.labels] + ["toxic"]
    kept = docs.drop(*added)
    place = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                few = batch.slice(at, 500)
                p = model.predict(_matrix(few.column(place).to_pylist(), model.index))
                cols = [pa.array(p[:, k]) for k in range(p.shape[1])]
                yield pa.RecordBatch.from_arrays([*few.columns, *cols, pa.array(p[:, -1] >= least)], names=[*few.schema.names, *added])

    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, T.DoubleType()) for c in added[:-1]], T.StructField("toxic", T.BooleanType())])
    return kept.mapInArrow(run, schema)


#: The labels table's columns, as a chain: low quality first, then toxic.
CHAIN = ["low_quality", "toxic"]


def chain_for(spark, docs: DataFrame, sf_dir: str) -> Chain:
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))
    return train(docs, labels, CHAIN)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, chain_for(spark, docs, sf_dir)).select("doc_id", "p_low_quality", "p_toxic", "toxic")


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE: dict[str, str] = {}
