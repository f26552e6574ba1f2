"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered
from .labelled import distinct, labelled_rows, remainder

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Labelled training texts that are drawn to the driver at most.
TRAIN_ROWS = 6_000
#: log2 of the weights' number.
DIM_BITS = 18
#: Distinct words that a worker keeps hashes of.
CACHE = 200_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MASK = (1 << 64) - 1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _Tokens(dict):
    """token -> (hash of the lower-cased token, hash of its shape), within a bounded size."""

    def __missing__(self, token: str):
        if len(self) >= CACHE:
            self.clear()
        value = self[token] = (xxhash.xxh64_intdigest(token.lower().encode(), 1), xxhash.xxh64_intdigest(shape(token).encode(), 2))
        return value


def shape(token: str) -> str:
    """What a token looks like: words by letter case and length, punctuation by its first sign and whether it goes on."""
    if not (token[0].isalnum() or token[0] == "_"):
        return token[0] + ("+" if len(token) > 1 else "")
    kind = "9" if token.isdigit() else "m" if any(c.isdigit() for c in token) else "A" if token.isupper() and len(token) > 1 else "C" if token[0].isupper() else "a"
    return kind + str(min(len(token) // 4, 5))


_REPEAT = np.uint64(xxhash.xxh64_intdigest(b"repeat", 3))


def _combine(*hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes[0]), dtype=np.uint64)
    for h in hashes:
        out = (out ^ h) * _FACTOR
        out ^= out >> np.uint64(29)
    return out


def features(text: str | None, cache: _Tokens, bits: int = DIM_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a whole text: word 1- and 2-grams, shape 1- to 3-grams, and the length's order, hashed.

    A word that repeats the one before it has a shape of its own.  Each of the two families has norm 1.
    """
    tokens = _TOKEN.findall(text or "")
    pairs = np.array([cache[t] for t in tokens], dtype=np.uint64).reshape(-1, 2)
    words, shapes = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
    if len(words) > 1:
        shapes[1:][words[1:] == words[:-1]] = _REPEAT
    length = np.array([xxhash.xxh64_intdigest(b"length", int(np.log2(len(tokens) + 1) * 2))], dtype=np.uint64)
    families = ([words, _combine(words[:-1], words[1:])], [shapes, _combine(shapes[:-1], shapes[1:]), _combine(shapes[:-2], shapes[1:-1], shapes[2:]) if len(shapes) > 2 else shapes[:0]])
    index, value = [length >> np.uint64(64 - bits)], [np.array([0.5])]
    for family in families:
        at, count = np.unique(np.concatenate(family) >> np.uint64(64 - bits), return_counts=True)
        weight = np.sqrt(count)
        index.append(at)
        value.append(weight / (np.sqrt((weight**2).sum()) or 1.0))
    return np.concatenate(index).astype(np.int64), np.concatenate(value)


@dataclass
class Ftrl:
    """Logistic regression with per-coordinate follow-the-regularised-leader updates (proximal form)."""

    bits: int = DIM_BITS
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 4

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 5) -> tuple[np.ndarray, float]:
        """Weights and bias. Without rows of both labels the bias alone tells the labels' share."""
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        bias, z, n = float(np.log(share / (1 - share))), np.zeros(1 << self.bits), np.zeros(1 << self.bits)
        if len(set(y.tolist())) < 2:
            return np.zeros(1 << self.bits, dtype=np.float32), bias
        order = np.random.default_rng(seed)
        for _ in range(self.epochs):
            for r in order.permutation(len(rows)):
                at, x = rows[r]
                w = self._weights(z[at], n[at])
                gradient = (_sigmoid(bias + w @ x) - y[r]) * x
                squared = gradient * gradient
                sigma = (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / self.alpha
                np.add.at(z, at, gradient - sigma * w)
                np.add.at(n, at, squared)
        return self._weights(z, n).astype(np.float32), bias

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def score(text: str | None, weights: np.ndarray, bias: float, cache: _Tokens, bits: int = DIM_BITS) -> float:
    at, x = features(text, cache, bits)
    return float(_sigmoid(bias + weights[at].astype(np.float64) @ x))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, train_rows: int = TRAIN_ROWS, model: Ftrl | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias, fitted by one task of an executor: texts and features (tens of KB a row) take none of the driver's memory."""
    model = model or Ftrl()

    def run(batches):
        texts, y = distinct([tuple(r.values()) for batch in batches for r in batch.to_pylist()])
        cache = _Tokens()
        weights, bias = model.fit([features(t, cache, model.bits) for t in texts], y)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    rows = labelled_rows(docs, labels, label, folds, held_out, train_rows)
    fitted = rows.coalesce(1).mapInArrow(run, "weights binary, bias double").first()
    return np.frombuffer(fitted["weights"], dtype=np.float32), fitted["bias"]


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Every document's columns, and held_out, score (0 to 1) and predicted (score >= threshold).

    The model is fitted on at most train_rows labelled texts, none of them held out; ids, lang, source and labels are no
    features.  Null and empty texts have only the length feature and are scored like any; a null doc_id is not held
    out.  Columns of docs named held_out, score or predicted, in any case, are replaced; repeated rows are scored each.
    """
    weights, bias = fit_quality(docs, labels, label, folds, held_out, train_rows)
    return apply_scores(docs, lambda: _scorer(weights, bias), folds, held_out, threshold)


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier accepts, with all their columns as they are, whatever their names."""
    weights, bias = fit_quality(docs, labels)
    scored = with_scores(docs, lambda: _scorer(weights, bias))
    return scored.filter(F.col("_score") >= THRESHOLD).drop("_score").toDF(*docs.columns)


def _scorer(weights: np.ndarray, bias: float):
    cache = _Tokens()
    return lambda texts: [score(t, weights, bias, cache) for t in texts]


def with_scores(docs: DataFrame, make, text_col: str = "text") -> DataFrame:
    """The columns of docs as _0, _1, ..., and _score; make() gives a worker its function from texts to scores."""
    rows, at = numbered(docs), docs.columns.index(text_col)
    schema = T.StructType([*rows.schema.fields, T.StructField("_score", T.DoubleType())])

    def run(batches):
        scorer = make()
        for batch in batches:
            scores = pa.array(scorer(batch.column(at).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "_score"])

    return rows.mapInArrow(run, schema)


def apply_scores(docs: DataFrame, make, folds: int, held_out: int, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, but for those that are named like one of held_out, score and predicted in any case, and these three."""
    kept = [F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in ("held_out", "score", "predicted")]
    key = F.col(f"_{docs.columns.index(id_col)}")
    new = [F.coalesce(remainder(key, folds) == held_out, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted")]
    return with_scores(docs, make, text_col).select(*kept, *new)
