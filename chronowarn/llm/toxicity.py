"""Toxicity of whole texts: embeddings of character n-grams averaged into a linear softmax, trained jointly in NumPy.

A word (digits, letters and non-ASCII characters, lower-cased) between two marks gives its character n-grams of
``SHORTEST`` to ``LONGEST`` characters; each falls into one of ``2 ** BITS`` buckets.  Buckets that the labelled sample
shows more or less often in toxic documents than chance explains own a vector.  A document is the average of the
vectors of its distinct buckets, so a misspelling or a new ending that keeps a stem shares the vectors of the stem.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronowarn.llm import tokens
from chronowarn.llm.shared import written

SHORTEST, LONGEST = 3, 6
BITS = 20                # buckets of n-grams; the tables that travel have this size, whatever the input
SAMPLE = 10_000          # labelled documents at most that the fit sees: those with the smallest hash of doc_id
TELLING = 4.0            # standard deviations by which a bucket's share of toxic documents must differ from chance
VECTORS = 1 << 15        # buckets with vectors at most, those furthest from chance
WIDTH = 8                # numbers in a vector
PADDING = 4.0            # zero vectors in every average, so that one weak n-gram alone says little
STEPS = 100
RATE = 0.1
PENALTY = 1e-5
FOLDS = 5                # a document is held out if the CRC-32 of its id's text leaves 0
SEGMENT = 1 << 18        # characters handled at once; longer texts are cut between words

_FACTOR = tokens.constants(LONGEST, 211)
_MARK = 0x2E


def _inside(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < 128, tokens.ALNUM[np.minimum(codes, 127)], True)


def subwords(codes: np.ndarray):
    """For every n: buckets of all n-grams of the words in ``codes`` (one text's characters, or several apart by a mark)
    and the place in ``codes`` of each one's second character, which is never a mark."""
    inside = _inside(codes)
    keep = inside.copy()
    keep[1:] |= inside[:-1]          # one mark behind each word
    place = np.r_[0, np.flatnonzero(keep) + 1]
    marked = np.r_[np.uint64(_MARK), np.where(inside, codes, _MARK)[keep].astype(np.uint64)]
    if len(marked) < 2 or marked[-1] != _MARK:
        marked, place = np.r_[marked, np.uint64(_MARK)], np.r_[place, len(codes)]
    marks = np.r_[0, np.cumsum(marked == _MARK)]
    total = marked[: len(marked) - 1] * _FACTOR[0]
    for n in range(2, LONGEST + 1):
        size = len(marked) - n + 1
        if size <= 0:
            return
        total = total[:size] + marked[n - 1 :] * _FACTOR[n - 1]
        if n >= SHORTEST:
            good = marks[n - 1 : n - 1 + size] == marks[1 : 1 + size]      # no mark inside
            yield (tokens.mix(total[good] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int32), place[1 : 1 + size][good]


def segments(text: str):
    """Characters of ``text`` in stretches of about ``SEGMENT``, cut where no word is."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    at = 0
    while at < len(codes):
        end = min(len(codes), at + SEGMENT)
        while end < len(codes):
            gap = np.flatnonzero(~_inside(codes[end - 1 : end + SEGMENT]))
            end = end + int(gap[0]) if len(gap) else min(len(codes), end + SEGMENT)
            if len(gap):
                break
        yield codes[at:end]
        at = end


def batches_of(texts: list[str | None]):
    """Rows in groups of about ``SEGMENT`` characters, as (numbers of the rows, their characters, where each row ends)."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for part in segments(text) if text else ():
            if rows and size + len(part) > SEGMENT:
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append(row)
            parts.append(part)
            size += len(part) + 1
    if rows:
        yield rows, parts


def bags(texts: list[str | None], slots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct bucket of every row, sorted; with ``slots``, of the buckets that have a slot."""
    found, gap = [np.zeros(0, np.int64)], np.array([_MARK], np.uint32)
    for rows, parts in batches_of(texts):
        codes = np.concatenate([x for part in parts for x in (part, gap)])
        ends = np.cumsum([len(p) + 1 for p in parts])
        rows = np.array(rows, np.int64)
        for buckets, place in subwords(codes):
            if slots is not None:
                buckets = slots[buckets]
                told = buckets >= 0
                buckets, place = buckets[told], place[told]
            row = rows[np.minimum(np.searchsorted(ends, place, side="right"), len(rows) - 1)]
            found.append(_distinct(row << np.int64(BITS) | buckets))
    keys = _distinct(np.concatenate(found))
    return keys >> np.int64(BITS), keys & np.int64((1 << BITS) - 1)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


@dataclass
class Toxicity:
    """A fitted model; its size depends on ``BITS``, ``VECTORS`` and ``WIDTH`` alone."""
    slots: np.ndarray      # bucket -> row of vectors, or -1
    vectors: np.ndarray    # rows x WIDTH
    weights: np.ndarray    # WIDTH x 2
    bias: np.ndarray

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        """Probability of toxic for every text; a text without known n-grams has that of the bias."""
        row, slot = bags(texts, self.slots)
        return _softmax(_average(self.vectors, row, slot, len(texts)) @ self.weights + self.bias)[:, 1]


def _average(vectors: np.ndarray, row: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, WIDTH), np.float32)
    if len(row):
        heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[heads]] = np.add.reduceat(vectors[slot], heads, axis=0)
    return out / (np.bincount(row, minlength=n) + PADDING).astype(np.float32)[:, None]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
    return e / e.sum(axis=1, keepdims=True)


def fit(row: np.ndarray, bucket: np.ndarray, toxic: np.ndarray, told: np.ndarray) -> Toxicity:
    """Vectors and softmax together, by full-batch Adam on the cross entropy; the same result every time.

    ``row`` and ``bucket`` are the bags of the sample over the buckets ``told`` (sorted), ``toxic`` its 0/1 labels.
    """
    n = len(toxic)
    slots = np.full(1 << BITS, -1, np.int32)
    slots[told] = np.arange(len(told), dtype=np.int32)
    prior = (np.bincount(toxic, minlength=2) + 1.0) / (n + 2)
    start = tokens.mix(np.arange(1, len(told) * WIDTH + 1, dtype=np.uint64)).astype(np.float64) / 2.0**64 - 0.5
    vectors = (0.1 * start.reshape(len(told), WIDTH)).astype(np.float32)
    weights = np.tile(np.array([[-0.5, 0.5]], np.float32), (WIDTH, 1)) / np.float32(WIDTH)
    model = Toxicity(slots, vectors, weights, np.log(prior).astype(np.float32))
    if not n or not len(told):
        return model
    slot, want = slots[bucket], np.eye(2, dtype=np.float32)[toxic]
    size = (np.bincount(row, minlength=n) + PADDING).astype(np.float32)
    order = np.argsort(slot, kind="stable")
    heads = np.flatnonzero(np.r_[True, slot[order][1:] != slot[order][:-1]])
    params = (model.vectors, model.weights, model.bias)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, STEPS + 1):
        mean = _average(model.vectors, row, slot, n)
        gap = (_softmax(mean @ model.weights + model.bias) - want) / n
        back = (gap @ model.weights.T) / size[:, None]
        moved = np.zeros_like(model.vectors)
        moved[slot[order][heads]] = np.add.reduceat(back[row[order]], heads, axis=0)
        grads = (moved + PENALTY * model.vectors, mean.T @ gap + PENALTY * model.weights, gap.sum(0))
        for p, g, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            p -= RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-12)
    return model


def remainder(doc_id: Column) -> Column:
    """CRC-32 of the id's text modulo ``FOLDS``; a null id counts as the empty text, whose remainder is 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def _counts(batches):
    """Documents and toxic documents that hold a bucket, summed over a task: at most ``2 ** BITS`` rows leave it."""
    seen, hit = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in tokens.pieces(batches):
        row, bucket = bags(batch.column(1).to_pylist())
        toxic = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        seen += np.bincount(bucket, minlength=len(seen))
        hit += np.bincount(bucket[toxic[row]], minlength=len(hit))
    there = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(seen[there]), pa.array(hit[there])], ["bucket", "seen", "hit"])


def _sample_bags(told: np.ndarray):
    slots = np.full(1 << BITS, -1, np.int32)
    slots[told] = np.arange(len(told), dtype=np.int32)

    def run(batches):
        for batch in tokens.pieces(batches):
            row, slot = bags(batch.column(1).to_pylist(), slots)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([slot[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                                             ["doc_id", "toxic", "bag"])
    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, toxic of at most ``sample`` labelled documents that are not held out.

    Of labels that repeat a doc_id the worse counts, of documents that repeat one the smallest text.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    named = named.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 0))
    named = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    there = rows.select("doc_id").join(named, "doc_id", "left_semi").distinct().join(named, "doc_id")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return rows.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, telling: float = TELLING, vectors: int = VECTORS) -> Toxicity:
    """Count the sample's buckets in tasks, keep the telling ones, and fit on the sample's bags over those."""
    chosen = written(labelled_sample(docs, labels, sample), "toxic-sample")
    n, bad = chosen.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    share = bad / n
    seen = F.col("seen").cast("double")
    chance = F.sqrt(seen * share * (1 - share) * (1 - seen / n) + 1)
    counts = chosen.mapInArrow(_counts, "bucket int, seen long, hit long").groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("hit").alias("hit"))
    far = counts.withColumn("far", F.abs((F.col("hit") - seen * share) / chance)).where(F.col("far") >= telling)
    told = np.sort(far.orderBy(F.desc("far"), "bucket").limit(vectors).select("bucket").toArrow()["bucket"].to_numpy())
    found = chosen.mapInArrow(_sample_bags(told), "doc_id long, toxic int, bag binary").toArrow().sort_by("doc_id")  # at most ``sample`` rows
    held = [np.frombuffer(b, np.int32) for b in found["bag"].to_pylist()]
    row = np.repeat(np.arange(len(held)), [len(b) for b in held])
    return fit(row, told[np.concatenate(held)] if len(row) else np.zeros(0, np.int64), found["toxic"].to_numpy().astype(np.int64), told)


def _scores(model: Toxicity):
    def run(batches):
        for batch in tokens.pieces(batches):
            p = model.posteriors(batch.column(1).to_pylist()).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(p, 0.0, 1.0))], ["doc_id", "score"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, toxic) teaches from documents that are not held out, at most ``sample`` of them; the fit sees
    texts only.  Every whole text is scored; predicted is 1 from a score of one half.

    Null, empty and wordless texts get the score of the bias (about the share of toxic documents in the sample).  A
    null doc_id counts as held out and teaches nothing; null labels and labels other than 0 and 1 are not used.  Rows
    that repeat a doc_id are scored one by one.  Without labels every score is one half.  Empty input gives no rows.
    Extra columns are ignored.
    """
    model = train(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scores(model), "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
