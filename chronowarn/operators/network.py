"""Dynamic-network-biomarker scores.

Feature counts are small (at most 24), so reference statistics are at most a few hundred
numbers.  They are fitted by one partial aggregation, kept as literals, and applied to
any number of records as plain column expressions.
"""

import math
from collections.abc import Iterator, Sequence
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType

EPSILON = 1e-8
MIN_REFERENCE = 9


def pairs_of(p: int) -> list[tuple[int, int]]:
    return list(combinations(range(p), 2))


def candidate_modules(features: DataFrame, name: str, sizes: Sequence[int], maximum: int = 10000) -> DataFrame:
    """All feature subsets of the given sizes in name order; refuses a search over the budget first.

    ``features`` holds distinct names.  Ordered self-joins build size k from size k - 1.
    """
    n = features.count()
    wanted = sum(math.comb(n, k) for k in sizes)
    if wanted > maximum:
        raise ValueError(f"search needs {wanted} candidates, budget is {maximum}")
    if any(k < 2 or k >= n for k in sizes):
        raise ValueError("module sizes must leave an outside feature")
    level = features.select(F.array(name).alias("module"), F.col(name).alias("last"))
    step = features.select(F.col(name).alias("next"))
    found = None
    for k in range(2, max(sizes) + 1):
        level = level.join(F.broadcast(step), F.col("next") > F.col("last")).select(
            F.concat("module", F.array("next")).alias("module"), F.col("next").alias("last"))
        if k in sizes:
            part = level.select(F.lit(k).alias("size"), "module")
            found = part if found is None else found.unionByName(part)
    return found


class Reference(NamedTuple):
    """Frozen moments of a complete reference matrix."""

    n: int
    mean: tuple
    scatter: tuple  # row-major p x p

    def base(self) -> np.ndarray:
        s = np.asarray(self.scatter).reshape(len(self.mean), -1)
        d = np.sqrt(np.diag(s))
        return s / d[:, None] / d[None, :]


def moments(rows: DataFrame, p: int, keys: Sequence[str] = (), vec: str = "vec", weight: Column | None = None) -> DataFrame:
    """Count, mean array and scatter array (row-major) of complete vectors, per key.

    Weighted moments come from shifted sums; unweighted ones from covariance aggregates.
    """
    complete = rows.filter(F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v)))
    x = [F.col(vec)[i] for i in range(p)]
    if weight is None:
        cov = {(i, j): F.covar_samp(x[i], x[j]) * (F.count(F.lit(1)) - 1) for i in range(p) for j in range(i, p)}
        agg = [F.count(F.lit(1)).alias("n"), F.array(*[F.avg(v) for v in x]).alias("mean")]
    else:
        total = F.sum(weight)
        s = [F.sum(weight * v) for v in x]
        cov = {(i, j): F.sum(weight * x[i] * x[j]) - s[i] * s[j] / total for i in range(p) for j in range(i, p)}
        agg = [total.alias("n"), F.array(*[v / total for v in s]).alias("mean")]
    flat = [cov[min(i, j), max(i, j)] for i in range(p) for j in range(p)]
    return complete.groupBy(*keys).agg(*agg, F.array(*flat).alias("scatter"))


def freeze_reference(rows: DataFrame, p: int, vec: str = "vec") -> Reference | None:
    """Reference moments, or None below nine people or with a constant feature."""
    row = moments(rows, p, vec=vec).first()
    if row is None or row["n"] < MIN_REFERENCE or any((row["scatter"][i * p + i] or 0.0) <= 1e-12 for i in range(p)):
        return None
    return Reference(row["n"], tuple(row["mean"]), tuple(row["scatter"]))


def perturb(records: DataFrame, ref: Reference | None, p: int, vec: str = "vec") -> DataFrame:
    """Add ``dev`` (absolute deviations) and ``delta`` (pair changes of correlation, i < j order).

    The correlation of the reference plus one record follows from the frozen scatter by a
    rank-one update; nothing is refitted per record.
    """
    if ref is None:
        null = F.lit(None).cast("array<double>")
        return records.withColumn("dev", null).withColumn("delta", null)
    grow = ref.n / (ref.n + 1.0)
    base = ref.base()
    records = records.withColumn("__d", F.array(*[F.col(vec)[i] - F.lit(ref.mean[i]) for i in range(p)]))
    d = [F.col("__d")[i] for i in range(p)]
    records = records.withColumn("__v", F.array(*[F.sqrt(F.lit(ref.scatter[i * p + i]) + F.lit(grow) * d[i] * d[i]) for i in range(p)]))
    v = [F.col("__v")[i] for i in range(p)]
    delta = [(F.lit(ref.scatter[i * p + j]) + F.lit(grow) * d[i] * d[j]) / (v[i] * v[j]) - F.lit(float(base[i, j])) for i, j in pairs_of(p)]
    complete = F.forall(vec, lambda x: x.isNotNull())
    return (records.withColumn("dev", F.when(complete, F.transform("__d", lambda x: F.abs(x))))
            .withColumn("delta", F.when(complete, F.array(*delta))).drop("__d", "__v"))


def perturb_by_row(records: DataFrame, p: int, vec: str = "vec") -> DataFrame:
    """As ``perturb`` with the reference moments n, mean and scatter held in each row."""
    d = [F.col(vec)[i] - F.col("mean")[i] for i in range(p)]
    grow = F.col("n") / (F.col("n") + 1)
    records = records.withColumn("__d", F.array(*d))
    e = [F.col("__d")[i] for i in range(p)]
    diag = [F.col("scatter")[i * p + i] for i in range(p)]
    records = records.withColumn("__v", F.array(*[F.sqrt(diag[i] + grow * e[i] * e[i]) for i in range(p)]))
    delta = []
    for i, j in pairs_of(p):
        s = F.col("scatter")[i * p + j]
        now = F.try_divide(s + grow * e[i] * e[j], F.col("__v")[i] * F.col("__v")[j])
        delta.append(now - F.try_divide(s, F.sqrt(diag[i] * diag[j])))
    usable = F.forall(vec, lambda x: x.isNotNull()) & (F.col("n") >= MIN_REFERENCE)
    for i in range(p):
        usable = usable & (diag[i] > 1e-12)
    return (records.withColumn("dev", F.when(usable, F.transform("__d", lambda x: F.abs(x))))
            .withColumn("delta", F.when(usable, F.array(*delta))).drop("__d", "__v"))


def _mean(values: Sequence[Column]) -> Column:
    total = values[0]
    for v in values[1:]:
        total = total + v
    return total / F.lit(float(len(values)))


def module_parts(module: Sequence[int], p: int, amplitude: Sequence[Column], strength: dict, k_squared: bool):
    """Amplitude, internal and external mean of one module from per-feature and per-pair columns."""
    inside = sorted(module)
    outside = [i for i in range(p) if i not in inside]
    internal = _mean([strength[i, j] for i, j in combinations(inside, 2)])
    if k_squared:
        internal = internal * F.lit((len(inside) - 1) / len(inside))
    external = _mean([strength[min(i, j), max(i, j)] for i in inside for j in outside])
    return _mean([amplitude[i] for i in inside]), internal, external


def _result(name: str, amplitude: Column, internal: Column, external: Column, blocked: Column, near: str) -> Column:
    ok = ~blocked & (external > EPSILON)
    score = F.when(ok, F.try_divide(amplitude * internal, external))
    reason = F.when(blocked, "missing_input").when(external <= EPSILON, near)
    return F.struct(F.lit(name).alias("module"), score.isNotNull().alias("valid"), score.alias("score"), amplitude.alias("amplitude"),
                    internal.alias("internal"), external.alias("external"), reason.alias("reason"))


def single_sample_scores(perturbed: DataFrame, p: int, modules: dict[str, Sequence[int]], k_squared: bool = True) -> DataFrame:
    """Array ``modules`` of one result per frozen module, from ``dev`` and ``delta``."""
    index = {pair: k for k, pair in enumerate(pairs_of(p))}
    perturbed = perturbed.withColumn("__a", F.transform("delta", lambda x: F.abs(x)))
    strength = {pair: F.col("__a")[k] for pair, k in index.items()}
    dev = [F.col("dev")[i] for i in range(p)]
    out = []
    for name, module in modules.items():
        a, i, e = module_parts(module, p, dev, strength, k_squared)
        out.append(_result(name, a, i, e, F.col("dev").isNull(), "near_zero_spcc_out"))
    return perturbed.withColumn("modules", F.array(*out)).drop("__a")


def aggregate_score(modules: str = "modules") -> Column:
    """Largest module score; NULL when any frozen module is invalid."""
    m = F.col(modules)
    return F.when((F.size(m) > 0) & F.forall(m, lambda x: x["valid"]), F.array_max(F.transform(m, lambda x: x["score"])))


def window_scores(rows: DataFrame, p: int, modules: dict[str, Sequence[int]], *, keys: Sequence[str] = (), window=None,
                  minimum: int = 8, vec: str = "vec") -> DataFrame:
    """Classic score over groups of rows, or over a sliding window of each row.

    Both forms use sample SDs and guarded correlations of jointly complete rows.
    """
    complete = F.forall(vec, lambda v: v.isNotNull())
    staged = rows.withColumn("__x", F.when(complete, F.col(vec)))
    x = [F.col("__x")[i] for i in range(p)]
    aggs = {"n": F.count("__x"), **{f"sd{i}": F.stddev_samp(x[i]) for i in range(p)},
            **{f"c{i}_{j}": F.covar_samp(x[i], x[j]) for i, j in pairs_of(p)}}
    if window is None:
        flat = staged.groupBy(*keys).agg(*[a.alias(f"__{k}") for k, a in aggs.items()])
    else:
        flat = staged.select("*", *[a.over(window).alias(f"__{k}") for k, a in aggs.items()])
    sd = [F.col(f"__sd{i}") for i in range(p)]
    blocked = F.col("__n") < minimum
    for s in sd:
        blocked = blocked | F.coalesce(s <= 1e-12, F.lit(True))
    strength = {(i, j): F.abs(F.try_divide(F.col(f"__c{i}_{j}"), sd[i] * sd[j])) for i, j in pairs_of(p)}
    out = [_result(name, *module_parts(m, p, sd, strength, False), blocked, "near_zero_external_correlation") for name, m in modules.items()]
    return flat.withColumn("modules", F.array(*out)).withColumn("n_rows", F.col("__n")).drop("__x", *[f"__{k}" for k in aggs])


def ablations(scored: DataFrame, ref: Reference | None, p: int) -> DataFrame:
    """Comparators of each module result: amplitude alone, ratio alone, association normalised by the
    expected size of a one-record change, and plain reference deviation."""
    z = scored.withColumn("m", F.explode_outer("modules"))
    deviation = F.aggregate("dev", F.lit(0.0), lambda a, v: a + v) / F.lit(float(p))
    return (z.withColumn("amplitude_only", F.col("m.amplitude"))
            .withColumn("ratio_only", F.when(F.col("m.external") > EPSILON, F.try_divide(F.col("m.internal"), F.col("m.external"))))
            .withColumn("reference_deviation", deviation))


def normalised_strength(perturbed: DataFrame, ref: Reference, p: int) -> DataFrame:
    """Pair changes over their approximate standard error: |delta| (n - 1) / (1 - r^2)."""
    base = ref.base()
    scale = F.array(*[F.lit((ref.n - 1) / max(1.0 - float(base[i, j]) ** 2, EPSILON)) for i, j in pairs_of(p)])
    return perturbed.withColumn("delta", F.zip_with("delta", scale, lambda d, c: F.abs(d) * c))


# ---- long pair-table form, used for audits -------------------------------------------------

def pair_table_scores(perturbed: DataFrame, p: int, members: DataFrame, record_keys: Sequence[str], k_squared: bool = True) -> DataFrame:
    """The same single-sample score from exploded pairs joined to a module membership table.

    ``members`` holds (module, i); at most a few thousand rows, broadcast.  A record that cannot be scored keeps its
    row per module, with NULLs.
    """
    gap = lambda c, n: F.coalesce(c, F.array_repeat(F.lit(None).cast("double"), n))
    index = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs_of(p)])
    size = members.groupBy("module").agg(F.count(F.lit(1)).alias("k"), F.collect_set("i").alias("inside"))
    edges = perturbed.select(*record_keys, F.explode(F.arrays_zip(index.alias("e"), gap(F.col("delta"), len(pairs_of(p))).alias("d"))).alias("z"))
    edges = edges.select(*record_keys, F.col("z.e.i").alias("i"), F.col("z.e.j").alias("j"), F.abs("z.d").alias("s"))
    hit = edges.join(F.broadcast(size), F.array_contains("inside", F.col("i")) | F.array_contains("inside", F.col("j")))
    both = F.array_contains("inside", F.col("i")) & F.array_contains("inside", F.col("j"))
    links = hit.groupBy(*record_keys, "module", "k").agg(F.avg(F.when(both, F.col("s"))).alias("internal"), F.avg(F.when(~both, F.col("s"))).alias("external"))
    nodes = perturbed.select(*record_keys, F.posexplode(gap(F.col("dev"), p)).alias("i", "a")).join(F.broadcast(members), "i")
    level = nodes.groupBy(*record_keys, "module").agg(F.avg("a").alias("amplitude"))
    scale = (F.col("k") - 1) / F.col("k") if k_squared else F.lit(1.0)
    j = links.join(level, [*record_keys, "module"]).withColumn("internal", F.col("internal") * scale)
    return j.withColumn("score", F.when(F.col("external") > EPSILON, F.try_divide(F.col("amplitude") * F.col("internal"), F.col("external")))).drop("k")


# ---- personal branches -----------------------------------------------------------------------

def _member_tables(p: int):
    """Functions of branches given as bits: members, pairs inside and pairs that cross, as 0/1 rows."""
    ij = np.asarray(pairs_of(p))

    def member(g):
        return ((g[:, None] >> np.arange(p)) & 1).astype(float)

    def pair(g, crossing):
        m = member(g) > 0
        return (m[:, ij[:, 0]] ^ m[:, ij[:, 1]] if crossing else m[:, ij[:, 0]] & m[:, ij[:, 1]]).astype(float)

    if p > 10:
        return member, lambda g: pair(g, False), lambda g: pair(g, True)
    every = np.arange(1 << p)                                  # few features: looked up
    tables = member(every), pair(every, False), pair(every, True)
    return tuple(lambda g, t=t: t[g] for t in tables)


def branch_scores(dev: np.ndarray, delta: np.ndarray, epsilon: float = EPSILON):
    """Best proper single-linkage branch of many records at once.

    ``dev`` is (records, p); ``delta`` is (records, pairs).  Edges are taken in order of
    falling |delta|; all records merge their k-th edge together.  A branch with a
    near-zero outside mean voids its record.
    """
    m, p = dev.shape
    ij = np.asarray(pairs_of(p))
    strength = np.abs(delta)
    order = np.argsort(-strength, axis=1, kind="stable")
    bits, within_of, crossing_of = _member_tables(p)
    group = np.tile(np.int64(1) << np.arange(p), (m, 1))       # members of each feature's branch, as bits
    score, ratio = np.full(m, -np.inf), np.full(m, np.nan)
    best = np.zeros(m, np.int64)
    valid = np.isfinite(dev).all(1) & np.isfinite(delta).all(1)
    open_ = np.arange(m)                                       # records whose features are not yet one branch
    for k in range(order.shape[1]):
        edge = ij[order[open_, k]]
        a, b = group[open_, edge[:, 0]], group[open_, edge[:, 1]]
        merged = np.flatnonzero(a != b)
        if not len(merged):
            continue
        rows, inside = open_[merged], a[merged] | b[merged]
        member = bits(inside)
        n = member.sum(1)
        group[rows] = np.where(member > 0, inside[:, None], group[rows])
        part = n < p
        if not part.all():
            closed = np.zeros(len(open_), bool)
            closed[merged[~part]] = True
            open_ = open_[~closed]
            rows, inside, member, n = rows[part], inside[part], member[part], n[part]
        if not len(rows):
            if not len(open_):
                break
            continue
        own = strength[rows]
        amplitude = np.einsum("rk,rk->r", dev[rows], member) / n
        within = 2.0 * np.einsum("rk,rk->r", own, within_of(inside)) / (n * n)
        between = np.einsum("rk,rk->r", own, crossing_of(inside)) / (n * (p - n))
        low = between <= epsilon
        valid[rows[low]] = False
        with np.errstate(divide="ignore", invalid="ignore"):
            r = within / between
        s = amplitude * r
        better = ~low & (s > score[rows])
        win = rows[better]
        score[win], ratio[win], best[win] = s[better], r[better], inside[better]
    inside_best = bits(best) > 0
    score = np.where(valid & np.isfinite(score), score, np.nan)
    return score, np.where(np.isnan(score), np.nan, ratio), inside_best


def personal_scores(perturbed: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Personal score, ratio and module per record; each Arrow batch is scored with array arithmetic."""
    names = np.asarray(features)
    source = perturbed.select(*keys, "dev", "delta")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in keys] +
                       ["personal_score double", "personal_ratio double", "module string"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[list(keys)].copy()
            ok = b["dev"].notna().to_numpy() & b["delta"].notna().to_numpy()
            s, r = np.full(len(b), np.nan), np.full(len(b), np.nan)
            mod = np.full(len(b), None, object)
            if ok.any():
                sub = b[ok]
                ss, rr, inside = branch_scores(np.vstack(sub["dev"].to_list()), np.vstack(sub["delta"].to_list()))
                s[ok], r[ok] = ss, rr
                mod[ok] = [",".join(names[row]) if np.isfinite(v) else None for row, v in zip(inside, ss)]
            out["personal_score"], out["personal_ratio"], out["module"] = s, r, mod
            yield out

    done = source.mapInPandas(score, schema)
    return done.withColumn("personal_score", F.nanvl("personal_score", F.lit(None).cast("double"))).withColumn(
        "personal_ratio", F.nanvl("personal_ratio", F.lit(None).cast("double")))


KINDS = ("dnb", "network_ratio", "deviation")


def resampled_scores(records: DataFrame, draws: list[Reference], keys: Sequence[str], features: Sequence[str], kinds: Sequence[str] = KINDS) -> DataFrame:
    """Personal score, ratio and deviation under every reference draw, summarised per record.

    Each draw is represented by its moments (p + p^2 numbers), so what travels to the
    executors is draws x features^2 numbers whatever the number of reference people.
    Median and interquartile spread are given only when every draw could be evaluated.
    Where ``kinds`` asks for the deviation alone no branch is looked at, and valid_draws and membership are left out.
    """
    branches = set(kinds) != {"deviation"}
    p = len(features)
    ij = np.asarray(pairs_of(p))
    stats = [(d.n / (d.n + 1.0), np.asarray(d.mean), np.asarray(d.scatter).reshape(p, p), d.base()) for d in draws]
    source = records.select(*keys, "vec")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in keys] +
                       [f"{k}_median double, {k}_iqr double" for k in kinds] + (["valid_draws int", "membership array<int>"] if branches else []))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            empty = np.full(p, np.nan)  # a record without a whole vector stays, with no valid draw
            x = np.array([empty if v is None else np.asarray(v, dtype=float) for v in b["vec"]]).reshape(len(b), p)
            whole_rows = np.isfinite(x).all(1)
            values = {k: np.full((len(stats), len(x)), np.nan) for k in kinds}
            members = np.zeros((len(x), p), int)
            for t, (grow, mean, scatter, base) in enumerate(stats):
                d = x[whole_rows] - mean
                if not len(d):
                    break
                if not branches:
                    values["deviation"][t, whole_rows] = np.abs(d).mean(1)
                    continue
                var = np.sqrt(np.diag(scatter) + grow * d * d)
                i, j = ij[:, 0], ij[:, 1]
                delta = (scatter[i, j] + grow * d[:, i] * d[:, j]) / (var[:, i] * var[:, j]) - base[i, j]
                s, r, inside = branch_scores(np.abs(d), delta)
                found = dict(zip(KINDS, (s, r, np.abs(d).mean(1))))
                for k in kinds:
                    values[k][t, whole_rows] = found[k]
                members[whole_rows] += inside & np.isfinite(s)[:, None]
            out = b[list(keys)].copy()
            for k in kinds:
                whole = np.isfinite(values[k]).all(0)
                q = np.full((3, len(x)), np.nan)
                if whole.any():
                    q[:, whole] = np.quantile(values[k][:, whole], [0.25, 0.5, 0.75], axis=0)
                out[f"{k}_median"], out[f"{k}_iqr"] = q[1], q[2] - q[0]
            if branches:
                out["valid_draws"] = np.isfinite(values["dnb"]).sum(0).astype("int32")
                out["membership"] = members.astype("int32").tolist()
            yield out

    done = source.mapInPandas(run, schema)
    for k in kinds:
        for part in ("median", "iqr"):
            done = done.withColumn(f"{k}_{part}", F.nanvl(f"{k}_{part}", F.lit(None).cast("double")))
    return done


def freeze_draws(reference: DataFrame, draws: DataFrame, p: int) -> list[Reference]:
    """Moments of every reference draw with at least nine distinct people (draws are few by configuration)."""
    joined = reference.join(draws, "idx")
    rows = moments(joined, p, keys=["draw"], weight=F.col("times").cast("double"))
    distinct = draws.groupBy("draw").agg(F.count(F.lit(1)).alias("people"))
    rows = rows.join(distinct, "draw").filter(F.col("people") >= MIN_REFERENCE).orderBy("draw")
    return [Reference(int(r["n"]), tuple(r["mean"]), tuple(r["scatter"])) for r in rows.toLocalIterator()
            if all(r["scatter"][i * p + i] > 1e-12 for i in range(p))]


# ---- screened sample networks ------------------------------------------------------------------

@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal tail of a z value."""
    return pd.Series([math.erfc(abs(v) / math.sqrt(2.0)) if v == v else None for v in z], dtype="float64")


def benjamini_hochberg(rows: DataFrame, p: str, by: Sequence[str], tie: Sequence[str] = (), out: str = "q") -> DataFrame:
    """Adjusted values: running minimum of p * m / rank from the largest p down, within each group."""
    group = W.partitionBy(*by)
    ranked = rows.withColumn("__r", F.row_number().over(group.orderBy(p, *tie))).withColumn("__m", F.count(F.lit(1)).over(group))
    down = group.orderBy(F.col("__r").desc()).rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__r")).over(down))).drop("__r", "__m")


def linear_quantile(values: Column, q: float) -> Column:
    """Linear quantile of a bounded array without missing items."""
    s = F.array_sort(values)
    position = (F.size(s) - 1) * F.lit(q)
    low = F.floor(position).cast("int")
    high = F.least(low + 1, F.size(s) - 1)
    return F.get(s, low) + (F.get(s, high) - F.get(s, low)) * (position - low)


def sample_network(perturbed: DataFrame, ref: Reference, features: Sequence[str], keys: Sequence[str], *,
                   deviation_quantile: float = 0.75, alpha: float = 0.05) -> DataFrame:
    """Screened edges between strongly deviating features with z, p, adjusted q and significance."""
    p = len(features)
    base = ref.base()
    edges = [F.struct(F.lit(features[i]).alias("source"), F.lit(features[j]).alias("target"), F.col("dev")[i].alias("a"), F.col("dev")[j].alias("b"),
                      F.col("delta")[k].alias("delta"), (F.col("delta")[k] * F.lit((ref.n - 1) / (1 - float(base[i, j]) ** 2))).alias("z"))
             for k, (i, j) in enumerate(pairs_of(p)) if 1 - float(base[i, j]) ** 2 > EPSILON]
    staged = perturbed.filter("dev IS NOT NULL").withColumn("__cut", linear_quantile(F.col("dev"), deviation_quantile))
    long = staged.select(*keys, "__cut", F.explode(F.array(*edges)).alias("e"))
    kept = long.filter((F.col("e.a") >= F.col("__cut")) & (F.col("e.b") >= F.col("__cut"))).select(*keys, "e.source", "e.target", "e.delta", "e.z")
    tested = benjamini_hochberg(kept.withColumn("p", two_sided_p("z")), "p", keys, ["source", "target"])
    return tested.withColumn("significant", F.col("q") <= alpha)


def sample_modules(network: DataFrame, keys: Sequence[str], distance_cut: float = 1.9) -> DataFrame:
    """Connected groups of significant edges within the cut, by repeated minimum labels.

    A record has at most 24 features, so the fixpoint is reached inside the record's own
    small edge array.
    """
    near = network.filter(F.col("significant") & ((F.lit(2.0) - F.abs("delta")) <= distance_cut))
    edges = near.groupBy(*keys).agg(F.collect_list(F.struct("source", "target")).alias("edges"))
    nodes = F.array_sort(F.array_distinct(F.flatten(F.transform("edges", lambda e: F.array(e["source"], e["target"])))))
    groups = edges.withColumn("groups", F.transform(nodes, lambda n: F.array(n)))

    def join(acc, e):
        touch = lambda g: F.array_contains(g, e["source"]) | F.array_contains(g, e["target"])
        merged = F.array_sort(F.array_distinct(F.flatten(F.filter(acc, touch))))
        return F.concat(F.filter(acc, lambda g: ~touch(g)), F.array(merged))

    return groups.select(*keys, F.explode(F.aggregate("edges", F.col("groups"), join)).alias("module")).filter(F.size("module") >= 2)
