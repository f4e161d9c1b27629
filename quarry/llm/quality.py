"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Words are runs of letters, of digits or of other signs. Each has a sparse ternary index vector drawn from
its hash; a word's context vector sums the index vectors of the words within two places of it, over
the sample. A word also has a shape (kind, case, length), which is a word of its own at the same place.
A document is the mean of its words' vectors, the mean product of neighbours' vectors (high where words
repeat), the shares of words equal to the one or two before, and the log of its length. A tanh layer and a logistic one, trained by stochastic gradient
descent, give a logit, and a temperature fitted on rows held out from training makes it a probability.

The network is fitted on a bounded, documented sample of labelled rows, evenly from both classes; the
logit is then moved back to the classes' true shares. All rows are scored on their whole texts, in chunks.
A null text scores as an empty one. Without labels of both classes every score is 0.5, or the share of
the class there is. Rows whose id has several labels use each; labels without an id are not used. A row
with a null id is in no fold: it is not held out. Columns named like the results are replaced; others pass
through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, least_draws, spread, table, written
from .vectext import chunks, run_hashes, runs

WORDS, SHAPES, DIM, NONZERO = 1 << 15, 64, 32, 4
HIDDEN = 32
#: The bounds of the sample: so many labelled rows, half of each class; the context vectors are made from a run of so many characters of each.
SAMPLE, CHARS = 6000, 20_000
_KIND = np.array([0 if c in b" \t\n\r\x0b\x0c" else 1 if c >= 128 or chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], np.uint8)
_UPPER = np.array([65 <= c <= 90 for c in range(256)], np.int64)


def word_ids(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Word and shape numbers of the words of one chunk."""
    raw, b = np.frombuffer(part, np.uint8), np.frombuffer(part.lower(), np.uint8)
    starts, ends = runs(_KIND[b])
    upper = np.concatenate(([0], np.cumsum(_UPPER[raw])))
    n, u = ends - starts, upper[ends] - upper[starts]
    case = np.where(u == 0, 0, np.where(u == n, 2, np.where((u == 1) & (_UPPER[raw[starts]] == 1), 1, 3)))
    length = np.minimum(3, np.log2(np.maximum(n, 1)).astype(np.int64))
    return (run_hashes(b, starts, ends) >> np.uint64(49)).astype(np.int64), WORDS + _KIND[b[starts]].astype(np.int64) * 16 + case * 4 + length


def index_vectors(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, the places of its index vector that aren't 0, and their signs."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (WORDS + SHAPES, NONZERO)), rng.choice([-1.0, 1.0], (WORDS + SHAPES, NONZERO))


def word_vectors(texts: list[str], seed: int) -> np.ndarray:
    """Context vectors of length 1; words not in the sample keep their index vectors."""
    where, sign = index_vectors(seed)
    n = WORDS + SHAPES
    flat = np.zeros(n * DIM)
    for text in texts:
        for part in chunks(text.encode()):
            both = word_ids(part)
            for mine in both:
                for theirs in both:
                    for offset in (1, 2):
                        for a, b in ((mine[:-offset], theirs[offset:]), (mine[offset:], theirs[:-offset])):
                            for k in range(NONZERO):
                                np.add.at(flat, a * DIM + where[b, k], sign[b, k])
    out = flat.reshape(n, DIM)
    unseen = ~out.any(axis=1)
    rows = np.flatnonzero(unseen)
    for k in range(NONZERO):
        np.add.at(out, (rows, where[rows, k]), sign[rows, k])
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(text: str, vectors: np.ndarray) -> np.ndarray:
    mean, product, same, n, pairs = np.zeros(DIM), np.zeros(DIM), np.zeros(2), 0, 0
    for part in chunks(text.encode("utf-8", "surrogatepass")):
        words, shapes = word_ids(part)
        for at in range(0, len(words), 1 << 15):
            v = vectors[words[at : at + (1 << 15)]] + vectors[shapes[at : at + (1 << 15)]]
            mean += v.sum(axis=0, dtype=np.float64)
            product += np.einsum("ij,ij->j", v[:-1], v[1:])
            w = words[at : at + (1 << 15)]
            same += [(w[:-1] == w[1:]).sum(), (w[:-2] == w[2:]).sum()]
            n, pairs = n + len(v), pairs + len(v) - 1
    return np.concatenate((mean / max(n, 1), product / max(pairs, 1), same / max(pairs, 1), [product.sum() / max(pairs, 1), np.log1p(n) / 10]))


@dataclass
class Model:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)
    shift: float = 0.0
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, text: str | None) -> float:
        z = self.logits(pooled(text or "", self.vectors)[None])[0] / self.temperature + self.shift if self.layers else self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def fit(texts: list[str], labels: list[int], share: float, features: Callable[[np.ndarray], np.ndarray] | None = None, epochs: int = 60, batch: int = 64, rate: float = 0.1, seed: int = 5) -> Model:
    """share: of label 1 among all labelled rows; features: the pooled rows from word vectors, if texts are only runs of them. Every fifth text calibrates and doesn't train."""
    logit = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1 - 1e-6)))
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return Model(np.zeros((0, DIM)), np.zeros(0), np.ones(0), shift=logit)
    rng, held = np.random.default_rng(seed), np.arange(len(y)) % 5 == 0
    vectors = word_vectors([t for t, h in zip(texts, held, strict=True) if not h], seed)
    x = features(vectors) if features else np.stack([pooled(t, vectors) for t in texts])
    model = Model(vectors, x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-6)
    w1, b1 = rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
    w2, b2 = rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())
    xs, ys = (x[~held] - model.centre) / model.scale, y[~held]
    speed = [np.zeros_like(p) for p in (w1, b1, w2, b2)]
    for epoch in range(epochs):
        step, order = rate * (1 - epoch / epochs), rng.permutation(len(ys))
        for at in range(0, len(order), batch):
            k = order[at : at + batch]
            hidden = np.tanh(xs[k] @ w1 + b1)
            d = (1 / (1 + np.exp(-(hidden @ w2 + b2))) - ys[k]) / len(k)
            dh = np.outer(d, w2) * (1 - hidden**2)
            grads = (xs[k].T @ dh + 1e-4 * w1, dh.sum(axis=0), hidden.T @ d + 1e-4 * w2, d.sum())
            for p, v, g in zip((w1, b1, w2, b2), speed, grads, strict=True):
                v *= 0.9
                v -= step * g
                p += v
    model.layers = [w1, b1, w2, b2]
    z = model.logits(x[held])
    # The sample's classes are even; weights and a shift bring back their true shares.
    taken = y.mean()
    model.shift = logit - float(np.log(taken / (1 - taken)))
    weight = np.where(y[held] == 1, share / taken, (1 - share) / (1 - taken))
    grid = np.exp(np.linspace(np.log(0.5), np.log(20), 120))
    model.temperature = float(min(grid, key=lambda t: float((weight * np.logaddexp(0, -(2 * y[held] - 1) * (z / t + model.shift))).sum())))
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, rows: int = SAMPLE) -> Model:
    """A model from a bounded sample of labelled rows; learn, on doc_id, says which labels may be seen.

    Labels are drawn by a hash of their id, then documents by a hash of id and text, both bounded for each
    class. The driver gets runs of CHARS characters for the context vectors, and of each document, whatever
    its length, the pooled features that the tasks make of its whole text.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(F.lit(True) if learn is None else learn).select("doc_id", "quality")
    n = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return fit([], [], 1.0 * n.get(1, 0) / sum(n.values()) if n else 0.5)
    chosen = least_draws(known, "quality", F.xxhash64("doc_id", F.lit("sample")), rows // 2)
    draw = F.xxhash64("doc_id", "text", F.lit("sample"))
    got = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `rows` labels at most
    got = written(least_draws(got, "quality", draw, rows // 2).withColumn("draw", draw), "quality-sample")
    run = F.substring("text", (F.pmod("draw", F.greatest(F.lit(1), F.length("text") - CHARS + 1)) + 1).cast("int"), F.lit(CHARS))
    texts = sorted(got.select("draw", "quality", run.alias("text")).collect())

    def features(vectors: np.ndarray) -> np.ndarray:
        shared = docs.sparkSession.sparkContext.broadcast(vectors)

        @F.pandas_udf("array<double>")
        def pool(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for whole in parts:
                yield pd.Series([pooled(t, shared.value) for t in whole])

        return np.array([r["x"] for r in sorted(got.select("draw", "quality", run.alias("text"), pool("text").alias("x")).collect())])

    return fit([r["text"] for r in texts], [int(r["quality"]) for r in texts], n.get(1, 0) / sum(n.values()), features)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (WORDS + SHAPES) x DIM floats, whatever the input

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in parts:
            yield pd.Series([m.score(t) for t in texts], dtype=float)

    return docs.withColumn("score", score(F.col("text"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 3, 1)
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return scored(spread(docs), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
