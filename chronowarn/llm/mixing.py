"""Soft-membership mixing: document rates that bring expected domain tokens to target weights."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chronowarn.llm import tokens
from chronowarn.llm.classify import SAMPLE, fit_labelled
from chronowarn.llm.shared import whole_row, written

DOMAINS = ("clean", "junk", "toxic")
WEIGHTS = (0.90, 0.08, 0.02)
EASE = 1e-6         # weight of staying near a rate of one, in the error's units; it makes the optimum unique
CLOSE = 1e-8        # share of the target total by which every domain must meet its condition at the optimum
PASSES = 200        # passes after which a fit that has not come so close raises


def domain(quality: Column, toxic: Column) -> Column:
    """Number of a label's domain in ``DOMAINS``; null for a label without values."""
    return F.when(F.coalesce(toxic, F.lit(0)) == 1, 2).when(quality == 0, 1).when(quality == 1, 0)


def _posteriors(model, text_at: int):
    """Batches with tokens and posteriors added behind their columns, of which ``text_at`` is the text."""
    def run(batches):
        for batch in tokens.pieces(batches):
            if not batch.num_rows:
                continue
            text = batch.column(text_at)
            n = np.diff(tokens.words(*tokens.text_bytes(text), tokens.NOT_SPACE)[1])
            p = model.posteriors(text)
            rest = [i for i in range(batch.num_columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], pa.array(n, pa.int64()), *[pa.array(np.ascontiguousarray(c)) for c in p.T]],
                                             [*[batch.schema.names[i] for i in rest], "tokens", *[f"p_{d}" for d in DOMAINS]])
    return run


def is_toxic() -> Column:
    """Whether toxic is the likeliest domain of a row of ``memberships``; equal posteriors name none."""
    return F.col(f"p_{DOMAINS[2]}") > F.greatest(*[F.col(f"p_{d}") for d in DOMAINS[:2]])


def memberships(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, carry: bool = False) -> DataFrame:
    """doc_id, tokens (words between white space) and the posterior of every domain, for every row of ``docs``.

    ``carry`` adds the whole row as column ``_row``.  The result is a written table.
    """
    model = fit_labelled(docs, labels, domain(F.col("quality"), F.col("toxic")), len(DOMAINS), sample)
    rows = docs.select(F.col("text").cast("string").alias("_text"), F.col("doc_id").cast("long").alias("doc_id"), *([whole_row(docs)] if carry else []))
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("tokens", T.LongType()), *[T.StructField(f"p_{d}", T.DoubleType()) for d in DOMAINS]])
    return written(rows.mapInArrow(_posteriors(model, 0), schema), "memberships")


def fit_rates(members: DataFrame, weights=WEIGHTS, most: float = 1.0) -> tuple[float, ...]:
    """The K numbers u of the fitted rates: r_i = clip(1 - p_i . u) to [0, ``most``], the projection of a gradient step.

    The rates minimise half the sum over domains of ((sum_i r_i tokens_i p_ik - T_k) / T)^2, plus ``EASE`` / 2 times
    the tokens' mean of (r_i - 1)^2.  T_k is weight_k * T, and T is chosen so that the first domain's target is the
    tokens it has.  In the metric of the tokens the gradient of document i is p_i . v, with v the residuals over T, so at
    the optimum u is v / ``EASE``: the steps of projected gradient descent add up to one step from r = 1.

    u is the least point of a convex function of K variables whose slope is u * EASE - v(u).  A pass over the documents
    sums that function, its slope and its curvature over the documents between the bounds; the driver takes the Newton
    step, halved while it does not descend.  So the common domain does not hold back a rare one, and nothing but a
    few sums leaves the tasks.  Raises if ``PASSES`` passes do not bring every slope below ``CLOSE``.
    """
    k = len(DOMAINS)
    have = _token_sums(members, lambda t, p: t @ p)
    total = have[0] / weights[0] if have[0] > 0 else have.sum()
    if total <= 0:
        return (0.0,) * k
    target = np.array(weights)

    def at(u: np.ndarray, ease: float):
        def sums(t, p):
            z = p @ u
            loss = np.where(z > 1, 0.0, np.where(z < 1 - most, most * (1 - z) - most * most / 2, (1 - z) ** 2 / 2))
            inside = t * ((z < 1) & (z > 1 - most))
            return np.r_[t @ loss, (t * np.clip(1 - z, 0.0, most)) @ p, ((p * inside[:, None]).T @ p).ravel()]

        found = _token_sums(members, sums) / total
        slope = target - found[1 : 1 + k] + ease * u
        return found[0] + target @ u + ease / 2 * u @ u, slope, found[1 + k :].reshape(k, k) + ease * np.eye(k)

    u, passes = np.zeros(k), 0
    for ease in (1000 * EASE, EASE):       # the first brings u near the second's
        value, slope, curve = at(u, ease)
        step, size = None, 1.0
        while np.abs(slope).max() > CLOSE:
            passes += 1
            if passes > PASSES:
                raise ValueError(f"the rates are not fitted after {PASSES} passes")
            if step is None:
                step, size = -np.linalg.solve(curve, slope), 1.0
            new = at(u + size * step, ease)
            if new[0] <= value + 1e-4 * size * slope @ step or np.abs(new[1]).max() < np.abs(slope).max() and size < 1e-3:
                u, (value, slope, curve), step = u + size * step, new, None
            else:
                size /= 2
    return tuple(u.tolist())


def _token_sums(members: DataFrame, sums) -> np.ndarray:
    """Sum over all documents of ``sums(tokens, posteriors)``: a fixed few numbers a task, added up in Spark."""
    def run(batches):
        out = 0.0
        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            out = out + sums(t, np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(DOMAINS))], axis=1))
        if np.ndim(out):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["place", "v"])

    found = members.select("tokens", *[f"p_{d}" for d in DOMAINS]).mapInArrow(run, "place int, v double").groupBy("place").agg(F.sum("v").alias("v"))
    values = found.toArrow().sort_by("place")["v"].to_numpy()
    return values if len(values) else np.zeros(len(DOMAINS))


def _dot(v) -> Column:
    return sum((F.col(f"p_{d}") * float(x) for d, x in zip(DOMAINS[1:], v[1:])), F.col(f"p_{DOMAINS[0]}") * float(v[0]))


def _rate(u, most: float) -> Column:
    return F.least(F.greatest(1 - _dot(u), F.lit(0.0)), F.lit(float(most)))


def with_rates(members: DataFrame, u, most: float = 1.0) -> DataFrame:
    """``members`` with rate, from the fitted numbers, and the whole number of copies."""
    return members.withColumn("rate", _rate(u, most)).withColumn("copies", copies(F.col("rate")))


def copies(rate_column: Column, seed: int = 20261001) -> Column:
    """Whole copies of a document: its rate, rounded up with the chance of its fraction, by a hash of doc_id.

    Rows without an id are told apart by their tokens and posteriors.
    """
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("tokens", *[f"p_{d}" for d in DOMAINS]))
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), own), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate_column) + (chance < rate_column - F.floor(rate_column)).cast("int")).cast("int")


def mix(docs: DataFrame, labels: DataFrame, weights=WEIGHTS, most: float = 1.0, sample: int = SAMPLE) -> DataFrame:
    """doc_id, tokens, p_<domain>, rate and copies of every row of ``docs``.

    Domains come from ``labels``: toxic, else low quality (junk), else clean.  The classifier sees at most ``sample``
    labelled documents; token totals and rates cover all rows.  The first domain keeps what it has, the others are
    brought toward their share of the mix; ``most`` bounds a rate (1: nothing is repeated).

    Null or empty text has no tokens and moves no total; null doc_ids are rounded by a hash of their tokens
    and posteriors; rows that
    repeat a doc_id get equal rates for equal texts and the same rounding.  Without labels all domains are equally
    likely.  Empty input gives no rows.  Extra columns are ignored.
    """
    members = memberships(docs, labels, sample)
    return with_rates(members, fit_rates(members, weights, most), most)


def apply_mix(docs: DataFrame, labels: DataFrame, weights=WEIGHTS, most: float = 1.0, sample: int = SAMPLE, reject: bool = False) -> DataFrame:
    """``docs`` with every row as often as ``mix`` says; all columns stay.

    With ``reject`` rows of which toxic is the likeliest domain go first (without labels no domain is), and the others
    are mixed.  Rows travel with their memberships, so null or repeated ids make no difference.
    """
    members = memberships(docs, labels, sample, carry=True)
    members = members.where(~is_toxic()) if reject else members
    chosen = with_rates(members, fit_rates(members, weights, most), most).where("copies > 0")
    return chosen.select("_row", F.explode(F.expr("sequence(1, copies)"))).select("_row.*")
