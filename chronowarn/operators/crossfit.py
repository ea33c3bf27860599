"""Many small models fitted at once: every (setting, held-out fold) is a key of one weighted table.

A pass over the rows sends, for all keys together, sums of gradients and curvatures of a logistic loss; the driver
takes one bounded Newton step per key.  So a grid of settings over folds costs as many passes as its slowest key, not
as many jobs as keys, and the driver holds keys x width x width numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronowarn.operators import evaluate
from chronowarn.operators.splits import grouped_stratified_folds
from chronowarn.session import materialise, spread

PASSES = 100
CLOSE = 1e-9          # largest slope of the standardised loss at the end
PIECE = 8192          # rows whose columns are built at once


@dataclass(frozen=True)
class Setting:
    """One candidate: ``family`` (logistic, spline_logistic or bounded), its penalty and the shape of its columns."""

    name: str
    family: str
    penalty: float
    knots: int = 0
    degree: int = 0


@dataclass(frozen=True)
class Columns:
    """How a key turns raw features into columns; everything in it comes from the key's own training rows."""

    family: str
    mean: tuple = ()
    missing: tuple = ()
    low: tuple = ()
    high: tuple = ()
    knots: int = 0
    degree: int = 0

    def matrix(self, x: np.ndarray) -> np.ndarray:
        """Rows x (1, columns).  ``bounded`` takes log1p of complete nonnegative features; the others fill missing
        cells by the training mean and mark them."""
        if self.family == "bounded":
            return np.c_[np.ones(len(x)), np.log1p(x)]
        gone = np.isnan(x)
        filled = np.where(gone, np.array(self.mean), x)
        parts = [np.ones((len(x), 1))]
        for j in range(x.shape[1]):
            parts.append(filled[:, [j]] if self.family == "logistic" else b_spline(filled[:, j], self.low[j], self.high[j], self.knots, self.degree))
        return np.hstack([*parts, gone[:, list(self.missing)].astype(float)])


def b_spline(x: np.ndarray, low: float, high: float, knots: int, degree: int) -> np.ndarray:
    """B-spline columns on ``knots`` even knots from ``low`` to ``high``, constant outside, without the last column.

    A feature without spread has no columns.
    """
    if not high > low:
        return np.zeros((len(x), 0))
    step = (high - low) / (knots - 1)
    t = low + step * np.arange(-degree, knots + degree)
    x = np.clip(x, low, high)
    cell = np.minimum(((x - low) / step).astype(int), knots - 2) + degree
    basis = np.zeros((len(x), len(t) - 1))
    basis[np.arange(len(x)), cell] = 1.0
    for d in range(1, degree + 1):
        n = len(t) - 1 - d
        rise = (x[:, None] - t[:n]) / (t[d : d + n] - t[:n])
        fall = (t[d + 1 : d + 1 + n] - x[:, None]) / (t[d + 1 : d + 1 + n] - t[1 : 1 + n])
        basis = rise * basis[:, :n] + fall * basis[:, 1 : n + 1]
    return basis[:, :-1]


@dataclass
class Key:
    """A setting fitted without one fold (None: on all rows)."""

    setting: Setting
    held: int | None
    columns: Columns
    shift: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))   # on standardised columns, intercept first

    def raw(self) -> np.ndarray:
        """Coefficients on the columns of ``columns.matrix``; constant columns have none."""
        slope = self.beta[1:] / self.scale
        return np.r_[self.beta[0] - slope @ self.shift, slope]

    def turn(self) -> np.ndarray:
        """Matrix that takes sums over raw columns to sums over standardised ones."""
        a = np.diag(np.r_[1.0, 1 / self.scale])
        a[1:, 0] = -self.shift / self.scale
        return a


# ---- passes over the rows: x array<double>, y, w (row weight), fold ----

def _rows(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            part = batch.slice(at, PIECE)
            x = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
            yield part, x, *(part.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2, 3))


def _sums(rows: DataFrame, width: int, per_key) -> dict[int, np.ndarray]:
    """Sum over all rows of the vectors ``per_key(x, y, w, fold)`` yields as (key, vector)."""
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for _, x, y, w, fold in _rows(batches):
            for key, vector in per_key(x, y, w, fold):
                total[key] = total[key] + vector if key in total else vector
        for key, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vector), key, np.int32)), pa.array(np.arange(len(vector), dtype=np.int32)), pa.array(vector)], ["key", "place", "v"])

    found = rows.select("x", "y", "w", "fold").mapInArrow(run, "key int, place int, v double").groupBy("key", "place").agg(F.sum("v").alias("v"))
    table = found.toArrow().sort_by([("key", "ascending"), ("place", "ascending")])
    keys, values = table["key"].to_numpy(), table["v"].to_numpy()
    return {int(k): values[keys == k] for k in np.unique(keys)}


def fold_moments(rows: DataFrame, features: int) -> dict[int, np.ndarray]:
    """Per fold and feature: present cells, their sum, least and greatest value, missing cells (5 x features)."""
    def f(j):
        return F.when(~F.isnan(F.col("x")[j]), F.col("x")[j])
    parts = [[F.count(f(j)).cast("double"), F.sum(f(j)), F.min(f(j)), F.max(f(j)), F.count_if(F.isnan(F.col("x")[j])).cast("double")] for j in range(features)]
    out = rows.groupBy("fold").agg(F.array(*[p for part in parts for p in part]).alias("m")).toArrow().to_pylist()
    return {int(r["fold"]): np.array([np.nan if v is None else v for v in r["m"]], float).reshape(features, 5).T for r in out}


def design(setting: Setting, held: int | None, moments: dict[int, np.ndarray]) -> Columns:
    used = np.stack([m for fold, m in moments.items() if fold != held])
    n, total = used[:, 0].sum(0), np.nansum(used[:, 1], axis=0)
    mean = np.divide(total, n, out=np.zeros_like(total), where=n > 0)
    low, high = (np.where(n > 0, f(np.where(np.isnan(used[:, i]), fill, used[:, i]), axis=0), 0.0) for i, f, fill in ((2, np.min, np.inf), (3, np.max, -np.inf)))
    missing = tuple(np.flatnonzero((used[:, 4].sum(0) > 0)).tolist())
    return Columns(setting.family, tuple(mean), missing, tuple(low), tuple(high), setting.knots, setting.degree)


def _grouped(keys: list[Key]) -> list[tuple[Columns, int | None, list[tuple[int, Key]]]]:
    """Keys that share their columns and their rows, so that those are built once."""
    found: dict[tuple, list] = {}
    for i, k in enumerate(keys):
        found.setdefault((k.columns, k.held), []).append((i, k))
    return [(columns, held, members) for (columns, held), members in found.items()]


def _seen(fold: np.ndarray, held: int | None):
    """Rows that a key is fitted on."""
    return slice(None) if held is None else fold != held


def _training(keys: list[Key], rows: DataFrame) -> None:
    """Set every key's shift and scale: weighted mean and spread of its columns over its training rows."""
    groups = _grouped(keys)

    def per_key(x, y, w, fold):
        for columns, held, members in groups:
            on = _seen(fold, held)
            t, use = columns.matrix(x[on]), w[on]
            sums = np.r_[use @ t, use @ (t * t), use @ y[on]]
            for i, _ in members:
                yield i, sums

    for i, v in _sums(rows, 0, per_key).items():
        k = (len(v) - 1) // 2
        mean = v[1:k] / v[0]
        square = v[k + 1 : 2 * k] / v[0]
        spread = square - mean**2
        share = v[-1] / v[0]
        if not 0 < share < 1:
            raise ValueError(f"{keys[i].setting.name} without fold {keys[i].held}: both classes are needed")
        keys[i].shift, keys[i].scale = mean, np.where(spread <= 1e-12 * square, np.inf, np.sqrt(np.maximum(spread, 0)))   # constant columns: no slope
        keys[i].beta = np.r_[np.log(share / (1 - share)), np.zeros(k - 1)]


def bounded_step(g: np.ndarray, h: np.ndarray, beta: np.ndarray, bounded: bool) -> np.ndarray:
    """Step to the least of the quadratic model; with ``bounded`` slopes stay nonnegative (coordinate descent)."""
    if not bounded:
        return -np.linalg.solve(h, g)
    step, slope = np.zeros_like(g), g.copy()
    for _ in range(10_000):
        largest = 0.0
        for j in range(len(g)):
            new = step[j] - slope[j] / h[j, j]
            new = max(new, -beta[j]) if j else new
            if new != step[j]:
                slope = slope + h[:, j] * (new - step[j])
                largest = max(largest, abs(new - step[j]))
                step[j] = new
        if largest <= 1e-14:
            break
    return step


def fit_keys(keys: list[Key], rows: DataFrame) -> list[Key]:
    """All keys fitted together: logistic loss averaged over the row weights plus penalty / 2 times squared slopes.

    A pass evaluates every key that is still open; a step that does not lower the loss is halved.  A key that is not
    within ``CLOSE`` of its optimum after ``PASSES`` raises.
    """
    _training(keys, rows)
    active = [np.r_[True, np.isfinite(k.scale)] for k in keys]
    old: dict[int, tuple] = {}
    trial = {i: k.beta for i, k in enumerate(keys)}
    for _ in range(PASSES):
        groups = [(c, held, [(i, replace(k, beta=trial[i]).raw()) for i, k in members if i in trial]) for c, held, members in _grouped(keys)]
        groups = [g for g in groups if g[2]]

        def per_key(x, y, w, fold, groups=groups):
            for columns, held, members in groups:
                on = _seen(fold, held)
                t, use, true = columns.matrix(x[on]), w[on], y[on]
                for i, raw in members:
                    eta = t @ raw
                    p = 1 / (1 + np.exp(-eta))
                    curve = (t * (use * p * (1 - p))[:, None]).T @ t
                    yield i, np.r_[use.sum(), use @ (np.logaddexp(0, eta) - true * eta), t.T @ (use * (p - true)), curve.ravel()]

        for i, v in _sums(rows, 0, per_key).items():
            key, beta, on = keys[i], trial[i], active[i]
            k = len(beta)
            pull = key.setting.penalty * np.r_[0.0, np.ones(k - 1)]
            loss = v[1] / v[0] + (pull * beta * beta).sum() / 2
            turn = key.turn()
            g = turn @ (v[2 : 2 + k] / v[0]) + pull * beta
            h = turn @ (v[2 + k :].reshape(k, k) / v[0]) @ turn.T + np.diag(pull)
            bounded = key.setting.family == "bounded"
            if i in old and loss > old[i][1] + 1e-14 * abs(loss) and old[i][3] > 1e-10:
                base, best, step, t = old[i]
                old[i] = (base, best, step, t / 2)
                trial[i] = base + step * t / 2
                continue
            slope = np.where(on, g, 0.0)
            if bounded:
                slope[1:] = np.where(beta[1:] > 0, slope[1:], np.minimum(slope[1:], 0))
            key.beta = beta
            if np.abs(slope).max() <= CLOSE:
                del trial[i]
                continue
            step = np.zeros(k)
            step[on] = bounded_step(g[on], h[np.ix_(on, on)] + 1e-12 * np.eye(on.sum()), beta[on], bounded)
            old[i] = (beta, loss, step, 1.0)
            trial[i] = beta + step
        if not trial:
            return keys
    raise ValueError(f"not converged: {[(keys[i].setting.name, keys[i].held) for i in trial]}")


def held_out(keys: list[Key], rows: DataFrame, carry: Sequence[str]) -> DataFrame:
    """``carry`` columns, y, fold, setting and p of every row under every key that has not seen its fold."""
    groups = _grouped([k for k in keys if k.held is not None])
    names = [*carry, "y", "fold", "setting", "p"]

    def run(batches):
        for part, x, y, w, fold in _rows(batches):
            for columns, held, members in groups:
                mine = np.flatnonzero(fold == held)
                t, rest = columns.matrix(x[mine]), part.take(pa.array(mine))
                for _, key in members:
                    p = 1 / (1 + np.exp(-(t @ key.raw())))
                    yield pa.RecordBatch.from_arrays([*[rest.column(4 + i) for i in range(len(carry))], rest.column(1), rest.column(3), pa.array([key.setting.name] * len(mine), pa.string()), pa.array(p)], names)

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*carry, "y", "fold")) + ", setting string, p double"
    return rows.select("x", "y", "w", "fold", *carry).mapInArrow(run, schema)


def as_rows(examples: DataFrame, features: Sequence[str], *, person: str, label: str, fold: str = "fold", weigh_people: bool, carry: Sequence[str] = ()) -> DataFrame:
    """x (missing: NaN), y, w and fold of every example; with ``weigh_people`` a person's rows share a weight of one.

    Every pass of a fit reads this table, so it is spread over the cores.
    """
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
    out = examples.select(x.alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"), *dict.fromkeys((person, *carry)))
    if not weigh_people:
        return materialise(spread(out.withColumn("w", F.lit(1.0))), "crossfit")
    counts = out.groupBy(person).agg((F.lit(1.0) / F.count(F.lit(1))).alias("w"))
    return materialise(spread(out.join(counts, person)), "crossfit")


def fit_grid(rows: DataFrame, settings: Sequence[Setting], folds: int, features: int, whole: bool = False) -> list[Key]:
    """Every setting without every fold (and, with ``whole``, on all rows)."""
    moments = fold_moments(rows, features)
    held = [*range(folds), *([None] if whole else [])]
    return fit_keys([Key(s, k, design(s, k, moments)) for s in settings for k in held], rows)


# ---- choices ----

def select_penalty(examples: DataFrame, features: Sequence[str], penalties: Sequence[float], *, person: str, label: str, seed: int, folds: int = 3) -> tuple[float, DataFrame, Key]:
    """Penalty of a nonnegative logistic model on log1p features by inner person folds.

    Returns the penalty, a table (penalty, fold, loss, mean_loss) and the model on all rows.  A fold's loss weighs its
    people equally; the smallest mean loss (12 decimals) wins and ties go to the larger penalty.  Features must be
    present, finite and nonnegative; constant columns have no slope.
    """
    bad = F.lit(False)
    for f in features:
        v = F.col(f).cast("double")
        bad = bad | v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))
    if not examples.where(bad).isEmpty():
        raise ValueError("features must be present, finite and nonnegative")
    assigned = examples.join(grouped_stratified_folds(examples, person, label, seed, folds).select(person, "fold"), person)
    rows = as_rows(assigned, features, person=person, label=label, weigh_people=True)
    settings = [Setting(repr(p), "bounded", p) for p in penalties]
    keys = fit_grid(rows, settings, folds, len(features), whole=True)
    scored = held_out(keys, rows, (person, "w"))
    eps = 2.220446049250313e-16
    p = F.least(F.greatest("p", F.lit(eps)), F.lit(1 - eps))
    loss = -F.when(F.col("y") == 1, F.log(p)).otherwise(F.log1p(-p))
    table = scored.groupBy("setting", "fold").agg((F.sum(F.col("w") * loss) / F.sum("w")).alias("loss"))
    losses = {(r["setting"], r["fold"]): r["loss"] for r in table.toArrow().to_pylist()}   # penalties x folds
    means = {p: float(np.mean([losses[repr(p), k] for k in range(folds)])) for p in penalties}
    chosen = min(penalties, key=lambda v: (round(means[v], 12), -v))
    out = examples.sparkSession.createDataFrame([(float(v), k, losses[repr(v), k], means[v]) for v in penalties for k in range(folds)],
                                                "penalty double, fold int, loss double, mean_loss double")
    return chosen, out, next(k for k in keys if k.held is None and k.setting.penalty == chosen)


LOGISTIC = [Setting(f"logistic C={c:g}", "logistic", c) for c in (0.01, 0.1, 1.0, 10.0)]
SPLINES = [Setting(f"spline_logistic knots={k} degree={d} C={c:g}", "spline_logistic", c, k, d) for k in (3, 5) for d in (2, 3) for c in (0.1, 1.0)]


def cross_fitted(examples: DataFrame, features: Sequence[str], settings: Sequence[Setting], *, person: str, label: str, carry: Sequence[str] = ()) -> DataFrame:
    """Out-of-fold probabilities of every setting for ``examples`` with a column fold.

    A setting's ``penalty`` is the usual C: the loss is summed over rows and slopes cost 1 / C, so the averaged loss
    has a penalty of 1 / (C rows).
    """
    rows = as_rows(examples, features, person=person, label=label, weigh_people=False, carry=carry)
    counts = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().toArrow().to_pylist()}
    moments = fold_moments(rows, len(features))
    keys = []
    for s in settings:
        for k in sorted(counts):
            n = sum(c for fold, c in counts.items() if fold != k)
            keys.append(Key(replace(s, penalty=1 / (s.penalty * n)), k, design(s, k, moments)))
    return held_out(fit_keys(keys, rows), rows, tuple(dict.fromkeys((person, *carry))))


def precision_by_fold(scored: DataFrame) -> DataFrame:
    """average_precision of every (setting, fold) of out-of-fold scores."""
    return evaluate.rank_metrics(scored, "y", "p", by=["setting", "fold"]).select("setting", "fold", "average_precision")


def best_settings(by_fold: DataFrame, family: Column) -> DataFrame:
    """Mean average precision per setting, the best setting of each family and the winner of all (ties: first name)."""
    mean = by_fold.groupBy("setting").agg(F.avg("average_precision").alias("mean_precision")).withColumn("family", family)
    family_best = mean.groupBy("family").agg(F.max(F.round("mean_precision", 12)).alias("_top"))
    both = mean.join(family_best, "family")
    tied = both.where(F.round("mean_precision", 12) == F.col("_top")).groupBy("family").agg(F.min("setting").alias("_best"))
    top = tied.join(mean.select("setting", F.round("mean_precision", 12).alias("_m")), F.col("_best") == F.col("setting")).agg(
        F.min_by("_best", F.struct(-F.col("_m"), F.col("_best"))).alias("_winner"))
    out = mean.join(tied, "family").join(F.broadcast(top))   # one row
    return out.select("family", "setting", "mean_precision", (F.col("setting") == F.col("_best")).alias("best_of_family"), (F.col("setting") == F.col("_winner")).alias("selected"))
