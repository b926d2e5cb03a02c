"""Quality classifier: naive Bayes support vectors.

A text becomes indicators of n-grams: lower-cased words (1 and 2) and word
shapes (1 to 4; a shape collapses runs of capital, small letters and digits,
keeps punctuation, and tells whether the word repeats the one before it).
Indicators are scaled by their class log-count ratio, counted over all labelled
training rows, and a linear hinge-loss model is fitted to them by dual
coordinate descent on a bounded sample of those rows.  All tables have
``DIMENSION`` entries, whatever the corpus size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.common import fold_of, in_slices

DIMENSION = 1 << 18      # half for words, half for shapes
FIT_ROWS = 6000          # about so many labelled rows are fitted, chosen by a hash of their id
BROADCAST_ROWS = 2_000_000  # labels up to this many rows (16 bytes each) go to every task; more are joined by shuffle
C = 0.1
EPOCHS = 30
ROWS_AT_ONCE = 500       # texts that a task turns into Python strings at a time

_RUNS = re.compile(r"(\w)\1+|([^\w\s])\2+")
_HALF = np.uint64(DIMENSION // 2 - 1)
# Odd 64-bit constants of a multiplicative hash, one for each place of an n-gram.
_PLACES = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def word_shape(word: str) -> str:
    """``"Abc,"`` -> ``"Aa,"``; letters and digits by kind, runs collapsed, whatever the word's length."""
    kinds = "".join("A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch for ch in word)
    return _RUNS.sub(lambda m: m[0][0], kinds)


def _codes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """Per word: its lower-cased hash (high half) and its shape's hash (low half)."""
    from xxhash import xxh32_intdigest

    try:
        return np.array(list(map(known.__getitem__, words)), np.uint64)
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = xxh32_intdigest(w.lower()) << 32 | xxh32_intdigest(word_shape(w))
        return np.array(list(map(known.__getitem__, words)), np.uint64)


def text_features(text: str, known: dict[str, int], flags: np.ndarray) -> np.ndarray:
    """Sorted indices of a text's indicators.  ``flags``: scratch of DIMENSION booleans, all false before and after."""
    codes = _codes(text.split(), known)
    if not len(codes):
        return np.zeros(0, np.int64)
    words, shapes = codes >> np.uint64(32), (codes & np.uint64(0xFFFFFFFF)) << np.uint64(1)
    shapes[1:] |= codes[1:] == codes[:-1]
    for sequence, longest, base in ((words, 2, 0), (shapes, 4, DIMENSION // 2)):
        mixed = [(sequence + np.uint64(1)) * p for p in _PLACES[:longest]]
        grams = None
        for n in range(1, longest + 1):
            if len(sequence) < n:
                break
            last = mixed[n - 1][n - 1:]
            grams = last if grams is None else (grams[:-1] ^ (grams[:-1] >> np.uint64(29))) + last
            hashed = (grams ^ (grams >> np.uint64(32))) * _PLACES[3]
            flags[((hashed >> np.uint64(40)) & _HALF).astype(np.int64) + base] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


@dataclass(frozen=True)
class QualityModel:
    """Weights of the scaled indicators; a margin m means probability 1 / (1 + exp(-(slope * m + offset)))."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, features: np.ndarray) -> float:
        m = margin(features, self.ratios, self.weights, self.bias)
        return float(1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30))))


def margin(features: np.ndarray, ratios: np.ndarray, weights: np.ndarray, bias: float) -> float:
    x = ratios[features]
    norm = np.sqrt(x @ x)
    return float(x @ weights[features] / norm if norm > 0 else 0.0) + bias


def log_count_ratios(good: np.ndarray, bad: np.ndarray, n_good: int, n_bad: int) -> np.ndarray:
    """log of the smoothed document rates' ratio; smoothing in proportion to the classes, so an unseen n-gram gets 0."""
    share = n_good / max(1, n_good + n_bad)
    top = (good + share) / max(1, n_good)
    low = (bad + 1 - share) / max(1, n_bad)
    return np.log(top / low).astype(np.float32) if n_good and n_bad else np.zeros(len(good), np.float32)


def fit_hinge(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, c: float = C, epochs: int = EPOCHS,
              seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; a constant 1 carries the bias.

    Classes weigh the same in total.
    """
    sign = np.where(labels == 1, 1.0, -1.0)
    cost = c * len(sign) / (2 * np.where(sign > 0, max(1, (sign > 0).sum()), max(1, (sign < 0).sum())))
    scaled = [ratios[f].astype(np.float64) for f in rows]
    scaled = [x / n if (n := np.sqrt(x @ x)) > 0 else x for x in scaled]
    square = np.array([x @ x + 1 for x in scaled])
    weights, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(sign))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(sign)):
            gradient = sign[i] * (scaled[i] @ weights[rows[i]] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weights[rows[i]] += step * scaled[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4 * c:
            break
    return weights, bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, classes weighing the same (Newton steps, small ridge)."""
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels != 1).sum()))
    x, beta = np.stack([margins, np.ones(len(margins))], axis=1), np.array([2.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - (labels == 1))) + 1e-3 * (beta - np.array([2.0, 0.0]))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta - np.linalg.solve(hessian, gradient)
    return max(0.1, float(beta[0])), float(beta[1])


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``doc_id, text, label`` of documents with a label: the majority of its rows, 1 on a tie; null labels are none."""
    one = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
           .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
           .agg((F.avg(label) >= 0.5).cast("int").alias("label")))
    if one.count() <= BROADCAST_ROWS:
        one = F.broadcast(one)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
            .join(one, "doc_id"))


def fit(training: DataFrame, fit_rows: int = FIT_ROWS, known_words: int = 200_000) -> QualityModel:
    """Model from ``training`` (doc_id, text, label).

    Ratios count every row; about ``fit_rows`` rows, with the smallest id
    hashes, are fitted in one task.  Without rows, or with one class only, the
    model answers that class's (or 0.5) for every text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flags = {}, np.zeros(DIMENSION, bool)
        seen, n = np.zeros((2, DIMENSION), np.int64), np.zeros(2, np.int64)
        for batch in in_slices(batches, ROWS_AT_ONCE):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(known) > known_words:
                    known.clear()
                seen[label, text_features(text, known, flags)] += 1
                n[label] += 1
        at = np.flatnonzero(seen.any(axis=0))
        if n.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(at, -1)), pa.array(np.append(seen[0, at], n[0])), pa.array(np.append(seen[1, at], n[1]))],
                names=["feature", "bad", "good"])

    counts = (training.select("text", "label").mapInArrow(count, "feature long, bad long, good long")
              .groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas())  # DIMENSION rows
    bad, good = np.zeros(DIMENSION + 1, np.int64), np.zeros(DIMENSION + 1, np.int64)
    at = counts["feature"].to_numpy(np.int64)
    bad[at], good[at] = counts["bad"].to_numpy(np.int64), counts["good"].to_numpy(np.int64)  # -1: the rows themselves
    n_good, n_bad = int(good[-1]), int(bad[-1])
    ratios = log_count_ratios(good[:-1], bad[:-1], n_good, n_bad)
    if not n_good or not n_bad:
        offset = 0.0 if n_good == n_bad else 30.0 if n_good else -30.0
        return QualityModel(ratios, np.zeros(DIMENSION, np.float32), 0.0, 1.0, offset)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flags = {}, np.zeros(DIMENSION, bool)
        for batch in in_slices(batches, ROWS_AT_ONCE):
            found = []
            for text in batch.column(1).to_pylist():
                if len(known) > known_words:
                    known.clear()
                found.append(text_features(text, known, flags).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)],
                                             names=["doc_id", "features", "label"])

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = []
        for batch in batches:
            for doc_id, found, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                listed.append((doc_id, label, np.frombuffer(found, "<i4")))
        listed.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
        labels = np.array([r[1] for r in listed])
        rows = [r[2] for r in listed]
        if not 0 < labels.sum() < len(labels):
            weights, bias, slope, offset = np.zeros(DIMENSION), 0.0, 0.0, 0.0
        else:
            held = np.arange(len(rows)) % 5 == 4  # a fifth calibrates the model of the rest
            if not 0 < labels[~held].sum() < (~held).sum() or not 0 < labels[held].sum() < held.sum():
                held[:] = False
            weights, bias = fit_hinge([r for r, h in zip(rows, held, strict=True) if not h], labels[~held], ratios)
            checked = held if held.any() else ~held
            margins = np.array([margin(r, ratios, weights, bias) for r, h in zip(rows, checked, strict=True) if h])
            slope, offset = calibrate(margins, labels[checked])
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.astype("<f4").tobytes()], pa.binary()), *(pa.array([x], pa.float64()) for x in (bias, slope, offset))],
            names=["weights", "bias", "slope", "offset"])

    share = min(1.0, fit_rows / (n_good + n_bad))
    chosen = training.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    # the one task gets indicators (at most 4 * DIMENSION bytes a row), not texts
    indicators = chosen.select("doc_id", "text", "label").mapInArrow(features, "doc_id long, features binary, label int")
    made = indicators.repartition(1).mapInArrow(
        descend, "weights binary, bias double, slope double, offset double").first()
    return QualityModel(ratios, np.frombuffer(made["weights"], "<f4"), made["bias"], made["slope"], made["offset"])


def score(docs: DataFrame, model: QualityModel, known_words: int = 200_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (null text is empty).

    ``held_out``: crc32 of the id as text, mod 3, is 1 (the fold that gives no labels).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flags = {}, np.zeros(DIMENSION, bool)
        for batch in in_slices(batches, ROWS_AT_ONCE):
            scores = []
            for text in batch.column(2).to_pylist():
                if len(known) > known_words:
                    known.clear()
                scores.append(model.probability(text_features(text, known, flags)))
            made = np.array(scores, np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made), pa.array((made >= 0.5).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of("doc_id", 3) == 1).alias("held_out"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def accept(docs: DataFrame, model: QualityModel, known_words: int = 200_000) -> DataFrame:
    """The rows of ``docs`` that the model accepts (score of at least 0.5), with all their columns.

    The text is scored where it stands: no join, no shuffle.
    """
    @F.arrow_udf("boolean")
    def accepted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, flags = {}, np.zeros(DIMENSION, bool)
        for texts in batches:
            kept = []
            for first in range(0, len(texts), ROWS_AT_ONCE):
                for text in texts.slice(first, ROWS_AT_ONCE).to_pylist():
                    if len(known) > known_words:
                        known.clear()
                    kept.append(model.probability(text_features(text, known, flags)) >= 0.5)
            yield pa.array(kept, pa.bool_())

    return docs.filter(accepted(F.coalesce(F.col("text"), F.lit(""))))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Model learned from the labels of the two folds that may be used."""
    return fit(labelled_texts(docs, labels).filter(fold_of("doc_id", 3) != 1), fit_rows)
