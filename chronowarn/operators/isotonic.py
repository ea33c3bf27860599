"""Increasing curves by pooling adjacent violators, cross-fitted over family folds, and the strength of a correction."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronowarn.functions import textkeys
from chronowarn.session import materialise

WHOLE = -1            # stands for the curve that no fold is held out of
LOW, HIGH = 0.0, 100.0


def pool(x_low: np.ndarray, x_high: np.ndarray, weight: np.ndarray, total: np.ndarray):
    """Blocks of the increasing least-squares fit of ordered cells: (least x, greatest x, weight, weighted sum)."""
    out: list[list[float]] = []
    for a, b, w, s in zip(x_low.tolist(), x_high.tolist(), weight.tolist(), total.tolist()):
        out.append([a, b, w, s])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            a, b, w, s = out.pop()
            out[-1] = [out[-1][0], b, out[-1][2] + w, out[-1][3] + s]
    return np.array(out).reshape(-1, 4).T


def _pooled(names: Sequence[str]):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("x_low")
        blocks = pool(*(group[c].to_numpy() for c in ("x_low", "x_high", "weight", "total")))
        keys = {c: [group[c][0].as_py()] * blocks.shape[1] for c in names}
        return pa.table({**{c: pa.array(v, group.schema.field(c).type) for c, v in keys.items()}, **dict(zip(("x_low", "x_high", "weight", "total"), map(pa.array, blocks)))})
    return run


def increasing_blocks(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Blocks of the increasing fit of ``cells`` (by, x, weight, total) per group.

    Cells are first pooled inside unit intervals of x, in parallel, and then the blocks that are left per group:
    pooling adjacent violators may start anywhere, so this is the same fit.
    """
    kinds = dict(cells.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", x_low double, x_high double, weight double, total double"
    parts = cells.select(*by, F.floor("x").alias("_unit"), F.col("x").alias("x_low"), F.col("x").alias("x_high"), "weight", "total")
    inside = parts.groupBy(*by, "_unit").applyInArrow(_pooled(by), schema)
    return inside.groupBy(*by).applyInArrow(_pooled(by), schema)


def curves(rows: DataFrame, predicted: str, truth: str, person: str, by: Sequence[str], folds: int) -> DataFrame:
    """Knot arrays (knots_x, knots_y) of every group without each fold, and on all rows (held = ``WHOLE``).

    People weigh the same and share their weight among their rows.  Cells of equal predictions are summed per fold
    once, and a key's cells are sums of those, so rows are read once for all keys.  Values lie in ``LOW`` to ``HIGH``.
    """
    bad = ~F.col(predicted).between(LOW, HIGH) | ~F.col(truth).between(LOW, HIGH) | F.isnan(predicted) | F.isnan(truth)
    if not rows.where(bad | F.col(predicted).isNull() | F.col(truth).isNull()).isEmpty():
        raise ValueError("predictions and truths must lie between 0 and 100")
    counts = rows.groupBy(*by, person).agg((F.lit(1.0) / F.count(F.lit(1))).alias("_w"), F.count_distinct("fold").alias("_folds"))
    if not counts.where("_folds > 1").isEmpty():
        raise ValueError("a person or family lies in several folds")
    weighed = rows.join(counts.drop("_folds"), [*by, person])
    cells = weighed.groupBy(*by, "fold", F.col(predicted).cast("double").alias("x")).agg(F.sum("_w").alias("weight"), F.sum(F.col("_w") * F.col(truth)).alias("total"))
    held = F.explode(F.array(*[F.lit(k) for k in (*range(folds), WHOLE)]))
    cells = cells.withColumn("held", held).where("fold <> held").groupBy(*by, "held", "x").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))
    blocks = increasing_blocks(cells, [*by, "held"])
    level = F.least(F.greatest(F.col("total") / F.col("weight"), F.lit(LOW)), F.lit(HIGH))
    knots = blocks.select(*by, "held", F.explode(F.array_distinct(F.array("x_low", "x_high"))).alias("x"), level.alias("y"))
    sorted_knots = F.array_sort(F.collect_list(F.struct("x", "y")))
    return knots.groupBy(*by, "held").agg(sorted_knots.alias("k")).select(*by, "held", F.col("k")["x"].alias("knots_x"), F.col("k")["y"].alias("knots_y"))


def select_strength(rows: DataFrame, predicted: str, truth: str, person: str, by: Sequence[str], strengths: Sequence[float], folds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Person-weighted mean absolute error of every strength on folds its curve has not seen, and the curves.

    A corrected value is (1 - s) x + s f(x).  The least error per group (12 decimals) is selected, ties to the smaller
    strength; the curve to use is then the one with held = ``WHOLE``.  ``rows`` needs a column fold (0 to folds - 1).
    """
    fitted = materialise(curves(rows, predicted, truth, person, by, folds), "curves")
    counts = rows.groupBy(*by, person).agg((F.lit(1.0) / F.count(F.lit(1))).alias("_w"))
    scored = rows.join(counts, [*by, person]).join(fitted.withColumnRenamed("held", "fold"), [*by, "fold"])
    error = [F.struct(F.lit(float(s)).alias("strength"), F.abs(textkeys.apply_curve(predicted, F.col("knots_x"), F.col("knots_y"), s) - F.col(truth)).alias("e")) for s in strengths]
    mae = scored.select(*by, "_w", F.explode(F.array(*error)).alias("z")).groupBy(*by, "z.strength").agg((F.sum(F.col("_w") * F.col("z.e")) / F.sum("_w")).alias("mae"))
    best = mae.groupBy(*by).agg(F.min(F.struct(F.round("mae", 12).alias("m"), "strength")).alias("_b")).select(*by, F.col("_b")["strength"].alias("_best"))
    return mae.join(best, list(by)).select(*by, "strength", "mae", (F.col("strength") == F.col("_best")).alias("selected")), fitted
