"""Guarded statistics: NULL instead of a division error or a NaN."""

from pyspark.sql import Column, DataFrame, functions as F


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def finite(value) -> Column:
    """The value, or NULL when it is NaN or infinite."""
    v = _col(value).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def ratio(numerator, denominator) -> Column:
    return F.try_divide(_col(numerator), _col(denominator))


def safe_corr(x, y) -> Column:
    """Pearson correlation of jointly present pairs, NULL for fewer than two or a constant side.

    Sample moments are kept by Welford-style aggregates, so large means do not cancel.
    """
    both = _col(x).isNotNull() & _col(y).isNotNull()
    a, b = F.when(both, _col(x)), F.when(both, _col(y))
    spread = F.stddev_samp(a) * F.stddev_samp(b)
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, F.try_divide(F.covar_samp(a, b), spread))


def higher_quantile(values: Column, q: float) -> Column:
    """'higher' quantile of a bounded, already collected array."""
    ordered = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    position = F.ceil((F.size(ordered) - 1) * F.lit(q)).cast("int") + 1
    return F.when(F.size(ordered) > 0, F.element_at(ordered, position))


def array_mean(values: Column) -> Column:
    n = F.size(values)
    return F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row result to every row, as one scalar subquery; NULLs when it is empty."""
    packed = row.select(F.struct(*row.columns).alias("r")).scalar()
    return df.withColumn("__row", packed).select(*df.columns, *[F.col("__row")[c].alias(c) for c in row.columns])
