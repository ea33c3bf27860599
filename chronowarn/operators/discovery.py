"""Module discovery: directional conditions, person bootstrap and paired-label permutation."""

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronowarn.functions.stats import with_row
from chronowarn.functions.hashing import hash_ints
from chronowarn.operators import resample
from chronowarn.operators.network import EPSILON, moments


def paired_records(records: DataFrame, events: DataFrame, lead_hours: int = 24) -> DataFrame:
    """Per person the earliest record and the last one at least ``lead_hours`` before onset; two or more needed."""
    early = records.join(events.select("participant_id", "onset"), "participant_id").filter(
        F.col("issued_at") <= F.col("onset") - F.expr(f"INTERVAL {lead_hours} HOURS"))
    row = F.struct("day", "vec")
    out = early.groupBy("participant_id").agg(F.min_by(row, "issued_at").alias("a"), F.max_by(row, "issued_at").alias("b"), F.count(F.lit(1)).alias("n"))
    return out.filter("n >= 2").select("participant_id", F.col("a.day").alias("stable_day"), F.col("b.day").alias("pre_day"),
                                       F.col("a.vec").alias("stable"), F.col("b.vec").alias("pre"))


def module_table(spark, features: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """Index arrays of every module: members, inside pairs and crossing pairs of a row-major matrix."""
    p = len(features)
    rows = []
    for k in sizes:
        for m in combinations(range(p), k):
            out = [i for i in range(p) if i not in m]
            rows.append((",".join(features[i] for i in m), list(m), [i * p + j for i, j in combinations(m, 2)], [i * p + j for i in m for j in out]))
    return spark.createDataFrame(rows, "module string, inside array<int>, pairs array<int>, crossing array<int>")


def _pick(values: str, index: str) -> Column:
    return F.aggregate(F.transform(index, lambda i: F.col(values)[i]), F.lit(0.0), lambda a, v: a + v) / F.size(index)


def components(stats: DataFrame, modules: DataFrame, p: int, keys: Sequence[str]) -> DataFrame:
    """Amplitude, internal and external means of every module for each row of moments."""
    sd = F.array(*[F.sqrt(F.greatest(F.col("scatter")[i * p + i], F.lit(0.0)) / (F.col("n") - 1)) for i in range(p)])
    corr = F.array(*[F.abs(F.try_divide(F.col("scatter")[i * p + j], F.sqrt(F.greatest(F.col("scatter")[i * p + i] * F.col("scatter")[j * p + j], F.lit(0.0)))))
                     for i in range(p) for j in range(p)])
    s = stats.select(*keys, sd.alias("sd"), corr.alias("corr")).withColumn("usable", F.forall("sd", lambda v: v > 1e-12))
    listed = modules.agg(F.collect_list(F.struct("module", "inside", "pairs", "crossing")).alias("listed"))  # bounded by the search budget
    j = s.transform(with_row, listed).select(*keys, "sd", "corr", "usable", F.explode_outer("listed").alias("z")).select(*keys, "sd", "corr", "usable", "z.*")
    part = lambda c: F.when(F.col("usable"), c)
    return j.select(*keys, "module", part(_pick("sd", "inside")).alias("amplitude"), part(_pick("corr", "pairs")).alias("internal"), part(_pick("corr", "crossing")).alias("external"))


def directional_statistic(a: str = "a", b: str = "b") -> Column:
    """log amplitude gain + log internal gain - log external gain when all three move the right way, else 0."""
    x = {k: (F.col(f"{a}.{k}"), F.col(f"{b}.{k}")) for k in ("amplitude", "internal", "external")}
    ok = F.lit(True)
    for lo, hi in x.values():
        ok = ok & lo.isNotNull() & hi.isNotNull() & (lo > 0) & (hi > 0)
    ok = ok & (x["external"][0] > EPSILON) & (x["external"][1] > EPSILON)
    ok = ok & (x["amplitude"][1] > x["amplitude"][0]) & (x["internal"][1] > x["internal"][0]) & (x["external"][1] < x["external"][0])
    gain = lambda k: F.log(F.try_divide(x[k][1], x[k][0]))
    return F.when(ok, gain("amplitude") + gain("internal") - gain("external")).otherwise(0.0)


def _sides(stats: DataFrame, modules: DataFrame, p: int, keys: Sequence[str]) -> DataFrame:
    """Both conditions' components from their moments, one row per (keys, module) with structs a (stable) and b (pre)."""
    c = components(stats, modules, p, [*keys, "side"])
    s = F.struct("amplitude", "internal", "external")
    return c.groupBy(*keys, "module").agg(F.max(F.when(F.col("side") == 0, s)).alias("a"), F.max(F.when(F.col("side") == 1, s)).alias("b"))


def _products(column: pa.ChunkedArray, p: int) -> np.ndarray:
    """One, the features and their pair products of every whole vector; zeros for any other."""
    x = np.array([np.full(p, np.nan) if v is None else np.asarray(v, float) for v in column.to_pylist()]).reshape(-1, p)
    i, j = np.triu_indices(p)
    out = np.hstack([np.ones((len(x), 1)), x, x[:, i] * x[:, j]])
    out[np.isnan(x).any(1)] = 0.0
    return out


def _side_moments(parts: DataFrame, p: int) -> DataFrame:
    """Moments of each (draw, side) from sums of ``_products`` over blocks."""
    width = 1 + p + p * (p + 1) // 2
    at = {pair: 1 + p + k for k, pair in enumerate(zip(*(v.tolist() for v in np.triu_indices(p))))}
    whole = parts.groupBy("draw", "side").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(width)]).alias("v")).filter(F.col("v")[0] > 0)
    v = [F.col("v")[i] for i in range(width)]
    flat = [v[at[min(i, j), max(i, j)]] - v[1 + i] * v[1 + j] / v[0] for i in range(p) for j in range(p)]
    return whole.select("draw", "side", v[0].alias("n"), F.array(*[v[1 + i] / v[0] for i in range(p)]).alias("mean"), F.array(*flat).alias("scatter"))


SUMS = "draw long, side int, v array<double>"


def _as_sums(draws: np.ndarray, stable: np.ndarray, pre: np.ndarray) -> pa.Table:
    v = np.vstack([stable, pre])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))
    return pa.table([pa.array(np.tile(draws, 2)), pa.array(np.repeat(np.array([0, 1], np.int32), len(draws))), lists], ["draw", "side", "v"])


def _drawn_moments(pairs: DataFrame, cells: DataFrame, p: int, bootstraps: int) -> DataFrame:
    """Moments of both sides in every bootstrap draw."""
    def multiply(rows: pa.Table, draws: np.ndarray, weights: np.ndarray) -> pa.Table:
        return _as_sums(draws, weights @ _products(rows["stable"], p), weights @ _products(rows["pre"], p))

    return _side_moments(resample.draws_by_block(pairs.select("idx", "stable", "pre"), cells, bootstraps, multiply, SUMS), p)


def _swapped_moments(pairs: DataFrame, p: int, permutations: int, seed: int) -> DataFrame:
    """Moments of both sides where a permutation swaps the records of every person whose seeded hash is odd."""
    chunk = resample.CHUNK

    def multiply(key, rows):
        first = key[1].as_py() * chunk
        draws = np.arange(first, min(permutations, first + chunk))
        idx = rows["idx"].to_numpy()
        flips = np.stack([hash_ints(f"{seed}|permutation|{d}|", idx) & 1 for d in draws]).astype(float)
        stable, pre = _products(rows["stable"], p), _products(rows["pre"], p)
        moved = flips @ (pre - stable)
        return _as_sums(draws, stable.sum(0) + moved, pre.sum(0) - moved)

    parts = resample.in_chunks(pairs.select("idx", "stable", "pre"), permutations).groupBy("block", "chunk").applyInArrow(multiply, SUMS)
    return _side_moments(parts, p)


def discover(pairs: DataFrame, draws: DataFrame, modules: DataFrame, p: int, *, bootstraps: int, permutations: int, seed: int,
             stability: float, alpha: float) -> DataFrame:
    """Candidate table with stability, adjusted p and eligibility.

    ``pairs`` holds idx, stable and pre; ``draws`` holds (draw, idx, times) or comes from ``resample.draw_cells``.
    Draws and permutations are reduced to pair sums by products of blocks of people with their counts, so no row stands
    for a person in a draw; module rows are made after it.  Failed draws count as misses.
    """
    both = pairs.select("idx", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("stable").alias("vec")), F.struct(F.lit(1).alias("side"), F.col("pre").alias("vec")))).alias("z")).select("idx", "z.side", "z.vec")
    seen = moments(both.withColumn("w", F.lit(1.0)), p, keys=["side"], weight=F.col("w"))
    observed = _sides(seen, modules, p, []).withColumn("statistic", directional_statistic())
    cells = draws if "block" in draws.columns else resample.packed(draws)
    boot = _sides(_drawn_moments(pairs, cells, p, bootstraps), modules, p, ["draw"])
    valid = F.col("a.external").isNotNull() & F.col("b.external").isNotNull() & (F.col("a.external") > EPSILON) & (F.col("b.external") > EPSILON)
    hit = valid & (F.col("b.amplitude") > F.col("a.amplitude")) & (F.col("b.internal") > F.col("a.internal")) & (F.col("b.external") < F.col("a.external"))
    stable = boot.groupBy("module").agg(F.count_if(hit).alias("hits"), F.count_if(valid).alias("valid_bootstraps"))
    null = _sides(_swapped_moments(pairs, p, permutations, seed), modules, p, ["draw"]).withColumn("statistic", directional_statistic())
    broken = F.max(F.col("a.external").isNull() | F.col("b.external").isNull())
    top = null.groupBy("draw").agg(F.when(broken, F.lit(float("inf"))).otherwise(F.max("statistic")).alias("top"))
    maxima = top.agg(F.sort_array(F.collect_list("top")).alias("maxima"))  # one number per permutation
    table = observed.join(stable, "module", "left").transform(with_row, maxima)
    reach = F.size(F.filter("maxima", lambda v: v >= F.col("statistic")))
    table = table.withColumn("stability", F.coalesce("hits", F.lit(0)) / F.lit(float(bootstraps))).withColumn(
        "adjusted_p", (F.lit(1.0) + reach) / F.lit(permutations + 1.0))
    score = lambda s: F.when(F.col(f"{s}.external") > EPSILON, F.try_divide(F.col(f"{s}.amplitude") * F.col(f"{s}.internal"), F.col(f"{s}.external")))
    all_three = (F.col("b.amplitude") > F.col("a.amplitude")) & (F.col("b.internal") > F.col("a.internal")) & (F.col("b.external") < F.col("a.external")) & (F.col("b.external") > EPSILON)
    return (table.withColumn("all_three_conditions", F.coalesce(all_three, F.lit(False))).withColumn("score_ratio", F.try_divide(score("b"), score("a")))
            .withColumn("eligible", F.col("all_three_conditions") & (F.col("stability") >= stability) & (F.col("adjusted_p") <= alpha))
            .select("module", "a", "b", "statistic", "stability", "valid_bootstraps", "adjusted_p", "all_three_conditions", "score_ratio", "eligible"))


def top_modules(candidates: DataFrame, limit: int = 5) -> DataFrame:
    """Eligible modules by stability, then score ratio, then name."""
    ranked = candidates.filter("eligible").orderBy(F.col("stability").desc(), F.coalesce("score_ratio", F.lit(0.0)).desc(), "module")
    return ranked.limit(limit)


def distinct_modules(rows: DataFrame, members: str, rank: str, limit: int) -> DataFrame:
    """Best-ranked row of every distinct member set, then the best ``limit`` sets."""
    keyed = rows.withColumn("__set", F.concat_ws(",", F.array_sort(members)))
    best = keyed.groupBy("__set").agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(rank), F.col("__set"))).alias("r")).select("r.*")
    return best.orderBy(F.col(rank).desc()).limit(limit)


def permutation_adjustments(statistics: DataFrame, candidate: str = "candidate", draw: str = "draw", value: str = "value") -> DataFrame:
    """maxT and minP adjusted p of each candidate; draw 0 is the observed statistic.

    Ranks are taken within a candidate, whose rows are the configured draws.
    """
    own = W.partitionBy(candidate)
    at_least = F.count(F.lit(1)).over(own.orderBy(F.col(value).desc()).rangeBetween(W.unboundedPreceding, 0))
    s = statistics.withColumn("p", at_least / F.count(F.lit(1)).over(own))
    per_draw = s.groupBy(draw).agg(F.max(value).alias("top"), F.min("p").alias("low"))
    limits = per_draw.agg(F.collect_list(F.struct("top", "low")).alias("all"), F.count(F.lit(1)).alias("draws"))
    observed = s.filter(F.col(draw) == 0).transform(with_row, limits)
    reach_t = F.size(F.filter("all", lambda x: x["top"] >= F.col(value)))
    reach_p = F.size(F.filter("all", lambda x: x["low"] <= F.col("p") + 1e-12))
    return observed.select(candidate, F.col(value).alias("statistic"), F.col("p").alias("marginal_p"), (reach_t / F.col("draws")).alias("max_t"), (reach_p / F.col("draws")).alias("min_p"))


def gate_summary(candidates: DataFrame, stability: float, alpha: float) -> DataFrame:
    """How many candidates pass each gate alone and one after another."""
    d, s, p = F.col("all_three_conditions"), F.col("stability") >= stability, F.col("adjusted_p") <= alpha
    return candidates.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(d).alias("direction"), F.count_if(s).alias("stable"), F.count_if(p).alias("significant"),
                          F.count_if(d & s).alias("direction_stable"), F.count_if(d & s & p).alias("all_gates"))
