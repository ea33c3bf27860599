"""People-level resampling as block products: a matrix of draws by people times the people's own products.

How often each draw takes each person is counted once and travels with the person, so every panel, occasion and metric
is resampled by the same draws.  A task multiplies its people's draw counts with their values, and sends sums of a
fixed size; rows are never repeated per draw.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from chronowarn.operators import resample
from chronowarn.session import materialise

POINT = -1      # stands for the people themselves, each once


def with_draws(people: DataFrame, person: str, draws: int, seed: int) -> tuple[DataFrame, int]:
    """``people`` with column ``taken``: (draw, times) of every draw that takes the person; and their number.

    Draws take as many people as there are, with replacement, by the seeded hash of ``resample.draw_counts``.
    """
    index, n = resample.person_index(people, person, seed)
    counts = resample.draw_counts(people.sparkSession, n, draws, seed)
    taken = counts.groupBy("idx").agg(F.collect_list(F.struct(F.col("draw").cast("int").alias("draw"), F.col("times").cast("int").alias("times"))).alias("taken"))
    return people.join(index, person).join(taken, "idx", "left").drop("idx"), n


def _weights(column: pa.Array, draws: int) -> np.ndarray:
    """Draws by rows of how often each row is taken; row 0 stands for ``POINT``."""
    out = np.zeros((draws + 1, len(column)))
    out[0] = 1.0
    flat = column.flatten()
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    if column.null_count:
        sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    np.add.at(out, (flat.field(0).to_numpy() + 1, np.repeat(np.arange(len(column)), sizes)), flat.field(1).to_numpy())
    return out


def participant_cube(rows: DataFrame, person: str, occasion: str, features: Sequence[str], occasions: Sequence[int]) -> DataFrame:
    """One row per person: ``cube`` (occasions x features, flat) or the reason why it is not complete.

    A person needs every occasion once and every feature present at each: repeated_occasion, missing_occasion,
    missing_feature, else null.
    """
    asked = rows.where(F.col(occasion).isin(*occasions)).select(person, F.col(occasion).cast("int").alias("_o"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    held = asked.groupBy(person).agg(F.array_sort(F.collect_list(F.struct("_o", "x"))).alias("_r"), F.count_distinct("_o").alias("_n"))
    cube = F.flatten(F.col("_r")["x"])
    reason = F.when(F.size("_r") > F.col("_n"), "repeated_occasion").when(F.col("_n") < len(occasions), "missing_occasion").when(
        F.exists(cube, lambda v: v.isNull() | F.isnan(v)), "missing_feature")
    return held.select(person, cube.alias("cube"), reason.alias("reason"))


def resampled_correlations(cube: DataFrame, person: str, features: int, occasions: Sequence[int], draws: int, seed: int) -> DataFrame:
    """(occasion, draw, sd, r): spreads and correlations (row-major) of every draw; draw ``POINT`` is the people themselves.

    sd and r are null where a feature has no spread in the draw.
    """
    people, n = with_draws(cube.select(person, "cube"), person, draws, seed)
    p, t = features, len(occasions)
    centre = cube.agg(F.array(*[F.avg(F.col("cube")[i]) for i in range(p * t)]).alias("c")).first()["c"]
    if n < 3:
        raise ValueError("correlations need three complete people")
    centre = np.array(centre).reshape(t, p)

    def sums(batches):
        total = np.zeros((t, draws + 1, p + p * p))
        for batch in batches:
            w = _weights(batch.column(1), draws)
            x = batch.column(0).flatten().to_numpy().reshape(-1, t, p) - centre
            for k in range(t):
                v = x[:, k]
                total[k] += w @ np.hstack([v, (v[:, :, None] * v[:, None, :]).reshape(len(v), p * p)])
        kinds = [pa.array(np.repeat(np.arange(t, dtype=np.int32), draws + 1)), pa.array(np.tile(np.arange(-1, draws, dtype=np.int32), t))]
        yield pa.RecordBatch.from_arrays([*kinds, pa.array(list(total.reshape(-1, p + p * p)), pa.list_(pa.float64()))], ["occasion", "draw", "v"])

    parts = people.select("cube", "taken").mapInArrow(sums, "occasion int, draw int, v array<double>")
    whole = parts.groupBy("occasion", "draw").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(p + p * p)]).alias("v"))

    def finish(batches):
        for batch in batches:
            v = batch.column(2).flatten().to_numpy().reshape(-1, p + p * p)
            mean, cross = v[:, :p] / n, v[:, p:].reshape(-1, p, p)
            cov = (cross - n * mean[:, :, None] * mean[:, None, :]) / (n - 1)
            var = np.einsum("dii->di", cov)
            good = (var > 1e-12 * np.maximum(np.einsum("dii->di", cross) / n, 1e-300)).all(1)
            sd = np.sqrt(np.where(good[:, None], var, 1.0))
            r = cov / sd[:, :, None] / sd[:, None, :]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.asarray(occasions, np.int32)[batch.column(0).to_numpy()]), batch.column(1),
                pa.array([s if g else None for s, g in zip(sd.tolist(), good)], pa.list_(pa.float64())),
                pa.array([m.ravel().tolist() if g else None for m, g in zip(r, good)], pa.list_(pa.float64()))], ["occasion", "draw", "sd", "r"])

    return materialise(whole.mapInArrow(finish, "occasion int, draw int, sd array<double>, r array<double>"), "correlations")


def panel_edges(corr: DataFrame, features: int, panels: dict[str, Sequence[int]], draws: int) -> DataFrame:
    """Pearson and 95 % interval of every edge of every panel and occasion.

    A failed draw is counted and withholds the interval, since one over the draws that worked would claim too much.
    """
    edges = F.array(*[F.struct(F.lit(name).alias("panel"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("r")[i * features + j].alias("r"))
                      for name, members in panels.items() for i, j in combinations(sorted(members), 2)])
    long = corr.select("occasion", "draw", F.explode(edges).alias("e")).select("occasion", "draw", "e.*")
    sampled = F.when(F.col("draw") >= 0, F.col("r"))
    out = long.groupBy("panel", "occasion", "i", "j").agg(
        F.max(F.when(F.col("draw") == POINT, F.col("r"))).alias("pearson"), F.count(sampled).alias("valid_draws"),
        F.percentile(sampled, 0.025).alias("low"), F.percentile(sampled, 0.975).alias("high"))
    whole = F.col("valid_draws") == draws
    return out.withColumn("low", F.when(whole, F.col("low"))).withColumn("high", F.when(whole, F.col("high")))


def panel_summary(corr: DataFrame, features: int, panels: dict[str, Sequence[int]], draws: int, people: int) -> DataFrame:
    """Participation ratio with its interval, largest eigenvalue share, mean absolute correlation and the median width of
    the edges' intervals, per panel and occasion."""
    names = list(panels.items())

    def measure(batches):
        for batch in batches:
            rows = []
            for occasion, draw, r in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for name, members in names:
                    m, k = sorted(members), len(members)
                    if r is None:
                        rows.append((name, occasion, draw, None, None, None))
                        continue
                    c = np.array(r).reshape(features, features)[np.ix_(m, m)]
                    rows.append((name, occasion, draw, k * k / float((c * c).sum()), float(max(np.linalg.eigvalsh(c)[-1], 0)) / k, float(np.abs(c[np.triu_indices(k, 1)]).mean())))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)], ["panel", "occasion", "draw", "ratio", "share", "mean_abs"])

    m = corr.select("occasion", "draw", "r").mapInArrow(measure, "panel string, occasion int, draw int, ratio double, share double, mean_abs double")
    point, sampled = F.col("draw") == POINT, F.when(F.col("draw") >= 0, F.col("ratio"))
    out = m.groupBy("panel", "occasion").agg(
        F.max(F.when(point, F.col("ratio"))).alias("participation_ratio"), F.max(F.when(point, F.col("share"))).alias("largest_share"),
        F.max(F.when(point, F.col("mean_abs"))).alias("mean_abs_r"), F.count(sampled).alias("valid_draws"),
        F.percentile(sampled, 0.025).alias("ratio_low"), F.percentile(sampled, 0.975).alias("ratio_high"))
    whole = F.col("valid_draws") == draws
    widths = panel_edges(corr, features, panels, draws).groupBy("panel", "occasion").agg(F.percentile(F.col("high") - F.col("low"), 0.5).alias("median_edge_width"))
    out = out.withColumn("ratio_low", F.when(whole, F.col("ratio_low"))).withColumn("ratio_high", F.when(whole, F.col("ratio_high")))
    return out.join(widths, ["panel", "occasion"]).select("panel", "occasion", F.lit(people).alias("people"), "participation_ratio", "largest_share", "mean_abs_r",
                                                          "valid_draws", "ratio_low", "ratio_high", "median_edge_width")


# ---- metrics of scored rows under the same draws ----

def resampled_metrics(rows: DataFrame, person: str, label: str, score: str, alert: str, draws: int, seed: int) -> DataFrame:
    """Per draw (and ``POINT``): n, positives, accuracy, balanced_accuracy, sensitivity, specificity, roc_auc, average_precision.

    Rows that lack label, score or alert are left out, and people without a row left are not drawn.  Rows are ordered once by score: range
    partitions hold equal scores together, each task multiplies its score bins' draw counts, and what lies above a
    partition is a running sum of per-partition totals.  So AUC and precision of all draws come from one ordering.
    """
    known = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull() & F.col(alert).isNotNull())
    known = known.select(person, F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("s"), F.col(alert).cast("int").alias("a"))
    people, _ = with_draws(known.select(person).distinct(), person, draws, seed)
    placed = known.join(people, person).repartitionByRange(F.col("s").desc()).withColumn("part", F.spark_partition_id())
    placed = materialise(placed.select("part", "y", "s", "a", "taken"), "placed")

    def counts(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            part, y, a = (batch.column(i).to_numpy() for i in (0, 1, 2))
            w = _weights(batch.column(3), draws)
            for k in np.unique(part).tolist():
                use = part == k
                cells = np.stack([w @ (use & (y == u) & (a == v)) for u in (0, 1) for v in (0, 1)], axis=1)
                total[k] = total.get(k, 0.0) + cells
        for k, cells in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(draws + 1, k, np.int32)), pa.array(np.arange(-1, draws, dtype=np.int32)), *[pa.array(c) for c in cells.T]],
                                             ["part", "draw", "tn", "fp", "fn", "tp"])

    per_part = placed.select("part", "y", "a", "taken").mapInArrow(counts, "part int, draw int, tn double, fp double, fn double, tp double")
    per_part = materialise(per_part.groupBy("part", "draw").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")]), "part-counts")
    order = W.partitionBy("draw").orderBy("part").rowsBetween(W.unboundedPreceding, -1)     # a row per partition
    pos, neg = F.col("fn") + F.col("tp"), F.col("tn") + F.col("fp")
    before = per_part.select("part", "draw", F.coalesce(F.sum(pos).over(order), F.lit(0.0)).alias("pos"), F.coalesce(F.sum(neg).over(order), F.lit(0.0)).alias("neg"))
    before = before.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("draw", "pos", "neg"))).alias("before"))

    def areas(key, group: pa.Table, ahead: pa.Table) -> pa.Table:
        start = ahead["before"].combine_chunks().flatten()
        pos, neg = start.field(1).to_numpy(), start.field(2).to_numpy()
        group = group.sort_by([("s", "descending")]).combine_chunks()
        s, y = group["s"].to_numpy(), group["y"].to_numpy()
        wins, area = np.zeros(draws + 1), np.zeros(draws + 1)
        cuts = np.r_[np.flatnonzero(np.r_[True, s[1:] != s[:-1]]), len(s)]
        at = 0
        while at < len(cuts) - 1:                      # bins in blocks, so that the count matrix stays small
            stop = min(len(cuts) - 1, at + 4096)
            piece = slice(int(cuts[at]), int(cuts[stop]))
            w = _weights(group["taken"].chunk(0)[piece] if group["taken"].num_chunks else pa.array([]), draws)
            local = cuts[at:stop] - cuts[at]
            p, q = np.add.reduceat(w * y[piece], local, axis=1), np.add.reduceat(w * (1 - y[piece]), local, axis=1)
            above_p, above_q = pos[:, None] + np.cumsum(p, axis=1), neg[:, None] + np.cumsum(q, axis=1)
            wins += (q * (above_p - p / 2)).sum(1)
            area += np.divide(p * above_p, above_p + above_q, out=np.zeros_like(p), where=above_p + above_q > 0).sum(1)
            pos, neg, at = above_p[:, -1], above_q[:, -1], stop
        return pa.table({"draw": pa.array(np.arange(-1, draws, dtype=np.int32)), "wins": wins, "area": area})

    parts = placed.groupBy("part").cogroup(before.groupBy("part")).applyInArrow(areas, "draw int, wins double, area double")
    ranked = parts.groupBy("draw").agg(F.sum("wins").alias("wins"), F.sum("area").alias("area"))
    all_ = per_part.groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")]).join(ranked, "draw")
    both = (pos > 0) & (neg > 0)
    sens, spec = F.try_divide("tp", pos), F.try_divide("tn", neg)
    return all_.select("draw", (pos + neg).alias("n"), pos.alias("positives"), F.try_divide(F.col("tp") + F.col("tn"), pos + neg).alias("accuracy"),
                       ((sens + spec) / 2).alias("balanced_accuracy"), sens.alias("sensitivity"), spec.alias("specificity"),
                       F.when(both, F.col("wins") / (pos * neg)).alias("roc_auc"), F.when(both, F.col("area") / pos).alias("average_precision"))


METRICS = ("accuracy", "balanced_accuracy", "sensitivity", "specificity", "roc_auc", "average_precision")


def metric_intervals(sampled: DataFrame, draws: int) -> DataFrame:
    """Estimate, valid draws and 95 % interval of every metric; a draw without a value withholds the interval."""
    long = sampled.select("draw", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("z")).select("draw", "z.*")
    inside = F.when(F.col("draw") >= 0, F.col("v"))
    out = long.groupBy("metric").agg(F.max(F.when(F.col("draw") == POINT, F.col("v"))).alias("estimate"), F.count(inside).alias("valid_draws"),
                                     F.percentile(inside, 0.025).alias("low"), F.percentile(inside, 0.975).alias("high"))
    whole = F.col("valid_draws") == draws
    return out.withColumn("low", F.when(whole, F.col("low"))).withColumn("high", F.when(whole, F.col("high")))
