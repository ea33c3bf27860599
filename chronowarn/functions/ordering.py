"""Running totals and tied ranks over data that does not fit one task.

Rows are first reduced to one per distinct order value.  Quantile cut points of that
value (a fixed, small number of doubles) split the order into buckets; windows run
inside buckets and bucket totals supply the offsets.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def cut_points(df: DataFrame, order_col: str, buckets: int | None = None) -> list[float]:
    """At most ``buckets - 1`` approximate quantiles of ``order_col``."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    if n < 2:
        return []
    shares = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(order_col, shares, 10000).alias("q")).first()
    return sorted(set(row["q"] or []))


def bucket_of(order_col: str, cuts: list[float]) -> Column:
    """Number of cut points strictly below the value: equal values share a bucket."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(order_col).cast("double")))


def running_totals(df: DataFrame, order_col: str, values: list[str], by=(), descending: bool = False,
                   buckets: int | None = None) -> DataFrame:
    """Inclusive running sum ``cum_<v>`` and group total ``total_<v>`` of each value.

    ``df`` must hold one row per (by, order_col).
    """
    by = list(by)
    rows = df.withColumn("__b", bucket_of(order_col, cut_points(df, order_col, buckets)))
    order = F.col(order_col).desc() if descending else F.col(order_col)
    inner = W.partitionBy(*by, "__b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    sums = rows.groupBy(*by, "__b").agg(*[F.sum(v).alias(f"__s_{v}") for v in values])
    scope = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    step = scope.orderBy(F.col("__b").desc() if descending else F.col("__b"))
    offsets = sums
    for v in values:
        offsets = offsets.withColumn(f"__o_{v}", F.sum(f"__s_{v}").over(step.rowsBetween(W.unboundedPreceding, 0)) - F.col(f"__s_{v}"))
        offsets = offsets.withColumn(f"total_{v}", F.sum(f"__s_{v}").over(scope))
    offsets = offsets.drop(*[f"__s_{v}" for v in values])
    keys = by + ["__b"]
    offsets = offsets.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                             *[c for c in offsets.columns if c not in keys])
    condition = None
    for i, k in enumerate(keys):
        term = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        condition = term if condition is None else condition & term
    for v in values:
        rows = rows.withColumn(f"cum_{v}", F.sum(v).over(inner))
    joined = rows.join(offsets, condition, "inner")
    for v in values:
        joined = joined.withColumn(f"cum_{v}", F.col(f"cum_{v}") + F.col(f"__o_{v}"))
    return joined.drop("__b", *[f"__o_{v}" for v in values], *[f"__k{i}" for i in range(len(keys))])


def average_ranks(df: DataFrame, value_col: str, by=(), out: str = "avg_rank") -> DataFrame:
    """One row per (by, value): tie count ``n`` and average rank of the tied rows."""
    counts = df.groupBy(*by, value_col).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, value_col, ["n"], by=by)
    return ranked.withColumn(out, F.col("cum_n") - (F.col("n") - 1) / F.lit(2.0)).drop("cum_n")


def weighted_quantile(df: DataFrame, value_col: str, weight_col: str, q: float, by=()) -> DataFrame:
    """Smallest value whose cumulative weight reaches ``q`` of the total (left inverse)."""
    mass = df.groupBy(*by, value_col).agg(F.sum(weight_col).alias("w"))
    totals = running_totals(mass, value_col, ["w"], by=by)
    reached = totals.filter(F.col("cum_w") >= F.col("total_w") * F.lit(q) - F.col("total_w") * F.lit(1e-12))
    return reached.groupBy(*by).agg(F.min(value_col).alias("quantile"))


def previous_row(df: DataFrame, by, order_col: str, payload: list[str], buckets: int | None = None) -> DataFrame:
    """Add ``prev`` (struct of the preceding row's payload) within each group, NULL for the first.

    A busy group is cut into order buckets; only the last row of each bucket crosses to
    the next one, so no task holds a whole group.
    """
    by = list(by)
    rows = df.withColumn("__b", bucket_of(order_col, cut_points(df, order_col, buckets)))
    item = F.struct(*payload)
    inner = W.partitionBy(*by, "__b").orderBy(order_col)
    rows = rows.withColumn("__p", F.lag(item).over(inner)).withColumn("__first", F.row_number().over(inner) == 1)
    tails = rows.groupBy(*by, "__b").agg(F.max_by(item, F.col(order_col)).alias("__tail"))
    carry = tails.withColumn("__carry", F.lag("__tail").over(W.partitionBy(*by).orderBy("__b"))).drop("__tail")
    joined = rows.join(carry, [*by, "__b"], "left")
    return joined.withColumn("prev", F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__p"))).drop("__b", "__p", "__first", "__carry")


def linear_quantiles(df: DataFrame, value_col: str, shares: dict[str, float], by=()) -> DataFrame:
    """Exact linear-interpolation quantiles, one named column per share.

    Distinct values are counted, cumulated in buckets and looked up by position, so no
    task gathers a whole group.
    """
    by = list(by)
    counts = df.filter(F.col(value_col).isNotNull()).groupBy(*by, value_col).agg(F.count(F.lit(1)).alias("n"))
    r = running_totals(counts, value_col, ["n"], by=by)
    aggs = []
    for name, q in shares.items():
        position = F.lit(q) * (F.col("total_n") - 1)
        low = F.floor(position)
        aggs += [F.min(F.when(F.col("cum_n") > low, F.col(value_col))).alias(f"__lo_{name}"),
                 F.min(F.when(F.col("cum_n") > F.least(low + 1, F.col("total_n") - 1), F.col(value_col))).alias(f"__hi_{name}"),
                 F.max(position - low).alias(f"__f_{name}")]
    out = r.groupBy(*by).agg(*aggs)
    return out.select(*by, *[(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__f_{n}")).alias(n) for n in shares])
