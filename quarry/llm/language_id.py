"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are the byte 2-, 3- and 4-grams of lower-cased words (letters only, with a mark at each end),
hashed into BUCKETS embeddings. A text's vector is the mean over all of its subwords; a linear layer and
a softmax give the languages' probabilities. Both layers are trained by stochastic gradient descent in
numpy, on segments of a bounded, documented sample of labelled rows. As both layers are linear, for few
languages the embeddings are folded into one table of BUCKETS x languages that the tasks get.

Rejection is calibrated on rows held out from the training: a temperature makes the probabilities honest,
and a text is rejected if it has no letters or if its probability is below the level that all but
REJECTED of the calibration rows reach, or half, whichever is lower.

A null text, an empty one and one without letters (of Unicode's category L) are `und` with score 0, and
rejected. Without labelled rows every text is. A row with a null id is in no fold: it is not held out, and
may be learned from. Whole texts are scored, in chunks of bounded size. Repeated rows get equal results.
Columns named like the results are replaced; others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, least_draws, spread, table
from .vectext import chunks

BUCKETS = 1 << 15
DIM = 16
#: The bounds of the sample: so many labelled rows over all languages, dealt evenly to them, but LEAST for each; of each text a run of so many characters.
SAMPLE, LEAST, CHARS = 3000, 20, 20_000
REJECTED = 0.005
UNKNOWN = "und"
#: ASCII letters and all bytes of other characters stay; the rest separates words.
_CLEAN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_GRAMS = (2, 3, 4)


def subwords(part: bytes) -> np.ndarray:
    """Buckets of the subwords of one chunk; no subword spans two words."""
    b = np.frombuffer(b" " + part.translate(_CLEAN) + b" ", np.uint8).astype(np.uint32)
    space = b == 32
    out, h = [], b.copy()
    inner = np.zeros(len(b), bool)  # a mark inside the gram, not at its ends
    for n in range(2, max(_GRAMS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + b[n - 1 :] * np.uint32(0x9E3779B1)
        inner = inner[:-1] | space[n - 2 : len(b) - 1] if n > 2 else inner[:-1]
        if n in _GRAMS:
            keep = ~(inner | (space[: len(h)] & space[n - 1 :]))
            g = h[keep]
            out.append(((g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, the two layers folded; with more languages than DIM, BUCKETS x DIM
    bias: np.ndarray
    head: np.ndarray | None = None  # DIM x languages, where the layers aren't folded
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray | None:
        """None where the text has no letter."""
        if not any(map(str.isalpha, text)):
            return None
        total, n = np.zeros(self.table.shape[1]), 0
        for part in chunks(text.lower().encode("utf-8", "surrogatepass")):
            for at in range(0, len(part), 1 << 16):
                ids = subwords(part[at : at + (1 << 16)])
                total += self.table[ids].sum(axis=0, dtype=np.float64)
                n += len(ids)
        mean = total / max(n, 1)
        return (mean if self.head is None else mean @ self.head) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        z = self.logits(text) if text and self.languages else None
        if z is None:
            return UNKNOWN, 0.0, True
        p = softmax(z[None] / self.temperature)[0]
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits that makes the labels likeliest, by a search on a grid."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 200))
    losses = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def fit(texts: list[str], labels: list[str], epochs: int = 6, batch: int = 64, rate: float = 2.0, seed: int = 11) -> Model:
    """A model from a sample; every fifth text calibrates and doesn't train."""
    languages = sorted(set(labels))
    empty = Model(languages, np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages)))
    if len(languages) < 2:
        return empty
    rng, y_of = np.random.default_rng(seed), {v: k for k, v in enumerate(languages)}
    segments: list[tuple[np.ndarray, int]] = []
    for k, (text, label) in enumerate(zip(texts, labels, strict=True)):
        if k % 5 == 0:
            continue
        data = text.lower().encode()
        for _ in range(4):  # segments from 16 to 1024 bytes, so that short texts are learned too
            size = int(2 ** rng.uniform(4, 10))
            at = int(rng.integers(0, max(1, len(data) - size)))
            ids = subwords(data[at : at + size])
            if len(ids):
                segments.append((ids, y_of[label]))
    e, w, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((DIM, len(languages))), np.zeros(len(languages))
    w += rng.normal(0, 0.3, w.shape)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(segments))
        for at in range(0, len(order), batch):
            part = [segments[k] for k in order[at : at + batch]]
            lengths = np.array([len(ids) for ids, _ in part])
            ids, row = np.concatenate([ids for ids, _ in part]), np.repeat(np.arange(len(part)), lengths)
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            x = np.add.reduceat(e[ids], starts, axis=0) / lengths[:, None]
            d = softmax(x @ w + bias)
            d[np.arange(len(part)), [y for _, y in part]] -= 1
            d /= len(part)
            dx = (d @ w.T) / lengths[:, None]
            w -= step * (x.T @ d)
            bias -= step * d.sum(axis=0)
            used, where = np.unique(ids, return_inverse=True)
            for k in range(DIM):
                e[used, k] -= 20 * step * np.bincount(where, weights=dx[row, k], minlength=len(used))
    folded = len(languages) <= DIM
    model = Model(languages, (e @ w if folded else e).astype(np.float32), bias, None if folded else w)
    held = [(z, y_of[label]) for text, label in list(zip(texts, labels, strict=True))[::5] if (z := model.logits(text)) is not None]
    if held:
        z, y = np.stack([z for z, _ in held]), np.array([y for _, y in held])
        model.temperature = temperature(z, y)
        model.threshold = min(0.5, float(np.quantile(softmax(z / model.temperature).max(axis=1), REJECTED)))
    return model


def sample(docs: DataFrame, learn: Column, rows: int = SAMPLE) -> tuple[list[str], list[str]]:
    """Texts and languages of a sample of at most `rows` rows where learn holds, evenly over languages.

    If there are more than rows / LEAST languages, those with the most rows are learned.

    Rows are drawn by a hash of id and text: reruns agree, and rows that share an id (or have none) are
    drawn one by one. Of a text longer than CHARS a run that starts at a place drawn by the same hash.
    """
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    most = max(1, rows // LEAST)
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most)
    languages = counts.count()
    if not languages:
        return [], []
    known = known.join(F.broadcast(counts.select("lang")), "lang")  # `most` rows
    draw = F.xxhash64("doc_id", "text", F.lit("sample"))
    chosen = least_draws(known, "lang", draw, rows // languages)
    run = F.substring("text", (F.pmod(draw, F.greatest(F.lit(1), F.length("text") - CHARS + 1)) + 1).cast("int"), F.lit(CHARS))
    got = sorted(chosen.select(draw.alias("draw"), run.alias("text"), "lang").collect())
    return [r["text"] for r in got], [r["lang"] for r in got]


def train(docs: DataFrame, learn: Column | None = None, rows: int = SAMPLE) -> Model:
    return fit(*sample(docs, F.lit(True) if learn is None else learn, rows))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats, whatever the input

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in parts:
            yield pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    found = docs.withColumn("__found", predict(F.col("text")))
    return found.withColumns({k: F.col(f"__found.{k}") for k in ("lang_pred", "score", "rejected")}).drop("__found")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4, 2)
    model = train(docs, ~held_out)
    return identified(spread(docs), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
