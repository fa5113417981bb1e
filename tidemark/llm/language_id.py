"""Language by hierarchical discrimination: first the family, then linear SVMs, one against one, within it.

A bounded sample of labelled rows (SAMPLE, shared evenly by the languages) fits it: log counts of hashed letter trigrams, scaled to length 1; a
softmax over families; and for each pair of languages of one family a linear support vector machine (squared hinge).
The weights are of fixed size and are broadcast. A language that FAMILY does not list is a family of its own.

Defined results: null text, or text without a letter, is `und` with score 0; so is all text if nothing was learned;
repeated rows get equal results; other columns are kept.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _ngrams, _spark, _text

#: Labelled rows at most, hashed trigrams.
SAMPLE, SIZE = 4096, 2048
#: Family of each language code.
FAMILY = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
}


def trigrams(texts: pa.Array) -> np.ndarray:
    return _ngrams.counts(texts, SIZE, letters_only=True)


def scaled(counts: np.ndarray) -> np.ndarray:
    x = np.log1p(counts)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.hstack([x / np.where(norm > 0, norm, 1), np.ones((len(x), 1), np.float32)])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 300, rate: float = 8.0) -> np.ndarray:
    w, speed = np.zeros((x.shape[1], classes), np.float32), 0.0
    for _ in range(steps):
        speed = 0.9 * speed - rate * 0.1 * (x.T @ (softmax(x @ w) - np.eye(classes, dtype=np.float32)[y]) / len(y) + 1e-5 * w)
        w = w + speed
    return w.astype(np.float32)


def _svm_fit(x: np.ndarray, sign: np.ndarray, steps: int = 300, rate: float = 2.0) -> np.ndarray:
    """Linear SVM, squared hinge loss, classes weighted alike."""
    weight = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1)).astype(np.float32)
    w, speed = np.zeros(x.shape[1], np.float32), 0.0
    for _ in range(steps):
        slack = np.maximum(1 - sign * (x @ w), 0)
        speed = 0.9 * speed - rate * 0.1 * (1e-4 * w - 2 * (x.T @ (weight * sign * slack)))
        w = w + speed
    return w.astype(np.float32)


@dataclass
class Model:
    families: list[list[str]]
    family_weights: np.ndarray
    pair_weights: dict[tuple[str, str], np.ndarray]

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.families:
            return np.full(len(counts), "und", object), np.zeros(len(counts))
        x = scaled(counts)
        chance = softmax(x @ self.family_weights)
        family = chance.argmax(1)
        lang, score = np.full(len(x), "", object), chance.max(1).astype(np.float64)
        for f, langs in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            votes = np.zeros((len(rows), len(langs)))
            for i, a in enumerate(langs):
                for j in range(i + 1, len(langs)):
                    p = 1 / (1 + np.exp(-4.0 * (x[rows] @ self.pair_weights[a, langs[j]]).astype(np.float64)))
                    votes[:, i] += (p >= 0.5) + p * 1e-3  # a tie of votes goes to the larger margin
                    votes[:, j] += (p < 0.5) + (1 - p) * 1e-3
            best = votes.argmax(1)
            lang[rows] = np.array(langs, object)[best]
            for i, a in enumerate(langs):
                for j, b in enumerate(langs):
                    if i != j:
                        on = best == i
                        m = (x[rows[on]] @ self.pair_weights[min(a, b), max(a, b)]).astype(np.float64) * (1 if a < b else -1)
                        score[rows[on]] *= 1 / (1 + np.exp(-4.0 * m))
        return lang, np.clip(np.round(score, 6), 0, 1)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text; labels: doc_id, label (a language code)."""
    y, x = _ngrams.labelled(docs, _ngrams.even(labels, SAMPLE), SAMPLE, SIZE, trigrams)
    on = x.sum(1) > 0
    y, x = np.array(y, object)[on], scaled(x[on])
    groups: dict[str, list[str]] = {}
    for lang in sorted(set(y)):
        groups.setdefault(FAMILY.get(lang, lang), []).append(lang)
    families = [groups[f] for f in sorted(groups)]
    if not families:
        return Model([], np.zeros(0), {})
    at = {lang: f for f, langs in enumerate(families) for lang in langs}
    weights = _softmax_fit(x, np.array([at[v] for v in y]), len(families))
    pairs = {}
    for langs in families:
        for i, a in enumerate(langs):
            for b in langs[i + 1 :]:
                rows = (y == a) | (y == b)
                pairs[a, b] = _svm_fit(x[rows], np.where(y[rows] == a, 1, -1).astype(np.float32))
    return Model(families, weights, pairs)


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep, then lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in _text.slices(batch, "_text"):
                lang, score = shared.value.predict(trigrams(part.column("_text")))
                no = ~np.asarray(part.column("_letter"), dtype=bool)
                lang[no], score[no] = "und", 0
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(lang, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    text = F.col(text_col).cast("string")
    rows = docs.select(text.alias("_text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letter"), *keep)
    return rows.mapInArrow(run, _spark.kept(docs, keep, "lang_pred string, score double"))
