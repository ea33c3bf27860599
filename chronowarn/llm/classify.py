"""A softmax classifier over hashed words and text statistics, fitted on a bounded sample of labelled rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronowarn.llm import tokens

WORD_BITS = 15
SAMPLE = 10_000          # labelled documents at most that the fit sees: those with the smallest hash of doc_id
STEPS = 120
RATE = 0.5
PENALTY = 1e-4
TELLING = 5.0            # standard deviations by which a word's share in some class must differ from chance
SYMBOL = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
STATS = 6


def features(text: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Per row the distinct hashed words, and statistics: log length, word length, symbols, variety, line length, repeats."""
    data, offsets = tokens.text_bytes(text)
    hashes, starts = tokens.words(data, offsets, tokens.ALNUM)
    n, size = np.diff(starts).astype(float), np.diff(offsets).astype(float)
    marks = np.r_[0, np.cumsum(SYMBOL[data])]
    lines = np.r_[0, np.cumsum(data == 0x0A)]
    buckets = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.uint16)
    sets = [np.unique(buckets[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
    again = np.r_[0, np.cumsum(np.r_[False, hashes[1:] == hashes[:-1]])] if len(hashes) else np.zeros(1, int)
    twice = again[starts[1:]] - again[np.minimum(starts[:-1] + 1, starts[1:])] if len(hashes) else n
    stats = np.c_[np.log1p(n), np.log((size + 60) / (n + 10)), np.log1p(100 * np.diff(marks[offsets]) / (n + 10)),
                  np.log((np.array([len(s) for s in sets]) + 8.0) / (n + 10)), np.log((n + 20) / (np.diff(lines[offsets]) + 2.0)), np.log1p(20 * twice / (n + 10))]
    return sets, stats


@dataclass
class Classifier:
    """Weights of a fixed size (``WORD_BITS``), so the model that travels to the tasks does not grow with the data."""
    words: np.ndarray      # buckets x classes
    stats: np.ndarray      # statistics (and their squares) x classes
    bias: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    prior: np.ndarray      # class shares of the sample

    def scores(self, sets: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        z = _expand((stats - self.centre) / self.scale) @ self.stats + self.bias
        counts = np.array([len(s) for s in sets])
        full = np.flatnonzero(counts)
        if len(full):
            cut = np.r_[0, np.cumsum(counts[full])[:-1]]
            z[full] += np.add.reduceat(self.words[np.concatenate([sets[i] for i in full])], cut, axis=0)
        return z

    def posteriors(self, text: pa.Array) -> np.ndarray:
        return softmax(self.scores(*features(text)))


def _expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.c_[z, z * z]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_features(sets: list[np.ndarray], stats: np.ndarray, classes: np.ndarray, n_classes: int) -> Classifier:
    """Softmax regression by full-batch Adam with a square penalty, the same result every time.

    Only hashed words that some class holds more or less often than chance (``TELLING``) get weights.
    """
    n = len(sets)
    prior = (np.bincount(classes, minlength=n_classes) + 1.0) / (n + n_classes)
    centre, scale = stats.mean(0) if n else np.zeros(STATS), (stats.std(0) + 1e-6) if n else np.ones(STATS)
    model = Classifier(np.zeros((1 << WORD_BITS, n_classes)), np.zeros((2 * STATS, n_classes)), np.log(prior), centre, scale, prior)
    if not n:
        return model
    want = np.eye(n_classes)[classes]
    counts = np.array([len(s) for s in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(n, dtype=np.int32), counts)
    telling = np.zeros(1 << WORD_BITS, bool)
    seen = np.bincount(flat, minlength=len(telling)).astype(float)
    for k in range(n_classes):
        held = np.bincount(flat, weights=want[row, k], minlength=len(telling))
        telling |= np.abs(held - seen * prior[k]) >= TELLING * np.sqrt(seen * prior[k] * (1 - prior[k]) + 1)
    flat, row = flat[telling[flat]], row[telling[flat]]
    order = np.argsort(flat, kind="stable")
    by_word, heads = row[order], np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]]) if len(order) else np.zeros(0, int)
    z = _expand((stats - centre) / scale)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (model.words, model.stats, model.bias)]
    for step in range(1, STEPS + 1):
        gap = (softmax(model.scores(sets, stats)) - want) / n
        words = np.zeros_like(model.words)
        if len(heads):
            words[flat[order][heads]] = np.add.reduceat(gap[by_word], heads, axis=0)
        grads = (words + PENALTY * model.words, z.T @ gap + PENALTY * model.stats, gap.sum(0))
        for p, g, (m, v) in zip((model.words, model.stats, model.bias), grads, moments):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            p -= RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8) * 0.2
    return model


def fit_labelled(docs: DataFrame, labels: DataFrame, label, n_classes: int, sample: int = SAMPLE) -> Classifier:
    """Fit on at most ``sample`` labelled rows of ``docs``; ``label`` is a column over ``labels`` (null: not used)."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.cast("int").alias("_class")).where("_class is not null and doc_id is not null")
    named = named.groupBy("doc_id").agg(F.min("_class").alias("_class")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(named, "doc_id")
    packed = rows.groupBy("doc_id").agg(F.min(F.struct("text", "_class")).alias("s")).select("doc_id", "s.*").mapInArrow(_sample_features, "doc_id long, label int, words binary, stats array<double>")
    found = packed.toArrow().sort_by("doc_id")  # at most ``sample`` rows of a few hundred numbers
    sets = [np.frombuffer(w, np.uint16) for w in found["words"].to_pylist()]
    return fit_features(sets, np.array(found["stats"].to_pylist()).reshape(-1, STATS), found["label"].to_numpy().astype(np.int64), n_classes)


def _sample_features(batches):
    for batch in tokens.pieces(batches):
        sets, stats = features(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(list(stats), pa.list_(pa.float64()))],
                                         ["doc_id", "label", "words", "stats"])
