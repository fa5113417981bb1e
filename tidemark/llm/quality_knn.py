"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A bounded sample of labelled rows (SAMPLE per label) fits the model: tf-idf of hashed byte trigrams and of the
term "same word as before" (at REPEAT times its weight), its leading
singular vectors (randomised SVD), and the sample's own vectors with their labels. The model is of fixed size and is
broadcast; each document's exact cosines with all labelled vectors come from blocked matrix products inside tasks.

Defined results: null and empty texts have no vector and get the sample's share of label 1; without any labelled row
every score is 0.5; labelled vectors whose cosines equal that of the last neighbour all vote; repeated rows score alike; other columns are
kept and must not be named score.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _ngrams, _spark, _text

#: Labelled rows for each label at most, hashed trigrams, latent dimensions, neighbours that vote, power of their cosines.
SAMPLE, SIZE, RANK, NEIGHBOURS, POWER, REPEAT = 2048, 4096, 64, 15, 4, 4


def terms(texts: pa.Array) -> np.ndarray:
    """How often each term occurs in each text: SIZE hashed trigrams, then words that equal the word before."""
    words = _text.Words(*_text.buffer(texts))
    h = words.hashes(_text.AS_IS)
    again = words.doc[1:][(h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])]
    return np.hstack([_ngrams.counts(texts, SIZE, letters_only=False), np.bincount(again, minlength=len(texts))[:, None].astype(np.float32)])


@dataclass
class Model:
    weights: np.ndarray  # idf x singular vectors
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) @ self.weights
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(norm > 0, norm, 1)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        out = np.empty(len(counts))
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(counts), 256):
            v = self.embed(counts[a : a + 256])
            cos = v @ self.vectors.T
            least = np.partition(cos, len(self.labels) - k, axis=1)[:, len(self.labels) - k, None]
            w = np.where(cos >= least, np.maximum(cos, 0), 0) ** POWER
            total = w.sum(1)
            vote = w @ self.labels / np.where(total > 0, total, 1)
            out[a : a + 256] = np.where(total > 0, vote, self.prior)
        return np.clip(np.round(out, 6), 0, 1)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text; labels: doc_id, label (0 or 1)."""
    y, x = [], []
    for value in (0, 1):
        ys, xs = _ngrams.labelled(docs, labels.where(F.col("label") == value), SAMPLE, SIZE + 1, terms)
        y += ys
        x.append(xs)
    y, x = np.array(y, np.float32), np.log1p(np.concatenate(x))
    if not len(y):
        return Model(np.zeros((SIZE + 1, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    idf = (np.log((1 + len(y)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    idf[SIZE] *= REPEAT
    a = x * idf
    a /= np.maximum(np.sqrt((a * a).sum(1, keepdims=True)), 1e-9)
    q = np.random.default_rng(7).standard_normal((SIZE + 1, RANK + 16)).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(a.T @ (a @ q))[0]
    _, _, vt = np.linalg.svd(a @ q, full_matrices=False)
    model = Model((idf[:, None] * (q @ vt[:RANK].T)).astype(np.float32), np.zeros(0), y, float(y.mean()))
    v = x @ model.weights
    model.vectors = (v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)).astype(np.float32)
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep, then score (0 to 1, higher: label 1 likelier)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in _text.slices(batch, "_text"):
                s = shared.value.score(terms(part.column("_text")))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(s, pa.float64())], names=[*keep, "score"])

    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)
    return rows.mapInArrow(run, _spark.kept(docs, keep, "score double"))
