"""Observations to daily panels, reference freeze, frozen scaling and simple scores."""

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from chronowarn.functions import clock, hashing
from chronowarn.functions.stats import array_mean


def daily_panel(observations: DataFrame) -> DataFrame:
    """One row per (participant, research day) with seven features complete on any active day.

    A single partial-aggregated shuffle on the person-day key; raw rows of a busy person
    are combined on the map side before they move.
    """
    day = clock.research_day("start_at", "timezone")
    base = observations.select("participant_id", "timezone", day.alias("day"), "start_at", "value",
                               clock.clock_hour("start_at", "timezone").alias("h"))
    n, c, s = clock.circular_sums("h")
    grouped = base.groupBy("participant_id", "timezone", "day").agg(
        F.count(F.lit(1)).cast("double").alias("n_events"), F.sum("value").alias("value_sum"),
        F.avg("value").alias("value_mean"), F.max("value").alias("value_max"),
        F.min("start_at").alias("__first"), F.max("start_at").alias("__last"),
        n.alias("__n"), c.alias("__c"), s.alias("__s"))
    mean, _ = clock.circular_from_sums(F.col("__n"), F.col("__c"), F.col("__s"))
    return (grouped.withColumn("first_h", clock.clock_hour("__first", "timezone"))
            .withColumn("last_h", clock.clock_hour("__last", "timezone"))
            .withColumn("mean_h", mean).drop("__first", "__last", "__n", "__c", "__s"))


def person_days(observations: DataFrame) -> DataFrame:
    """``daily_panel`` with each day's counts by local hour (``hours``) and its last arrival (``arrived``).

    The raw rows are read and turned to local time once.  They are combined per (person, day, hour) before they move, and
    a day is then put together from at most 25 rows, which move before its 24 slots are opened.
    """
    local = observations.withColumn("__t", clock.local_time("start_at", "timezone"))
    base = local.select("participant_id", "timezone", clock.research_day("start_at", "timezone").alias("day"), F.hour("__t").alias("hour"),
                        "start_at", "value", "available_at", clock.clock_hour("start_at", "timezone").alias("h"))
    n, c, s = clock.circular_sums("h")
    hourly = base.groupBy("participant_id", "timezone", "day", "hour").agg(
        F.count(F.lit(1)).cast("double").alias("events"), F.sum("value").alias("total"), F.count("value").alias("values"), F.max("value").alias("top"),
        F.min("start_at").alias("first"), F.max("start_at").alias("last"), n.alias("n"), c.alias("c"), s.alias("s"), F.max("available_at").alias("arrived"))
    slots = [F.coalesce(F.max(F.when(F.col("hour") == k, F.col("events"))), F.lit(0.0)) for k in range(24)]
    days = hourly.repartition("participant_id", "timezone", "day").groupBy("participant_id", "timezone", "day").agg(
        F.sum("events").alias("n_events"), F.sum("total").alias("value_sum"), F.sum("values").alias("__values"), F.max("top").alias("value_max"),
        F.min("first").alias("__first"), F.max("last").alias("__last"), F.sum("n").alias("__n"), F.sum("c").alias("__c"), F.sum("s").alias("__s"),
        F.array(*slots).alias("hours"), F.max("arrived").alias("arrived"))
    mean, _ = clock.circular_from_sums(F.col("__n"), F.col("__c"), F.col("__s"))
    return days.select("participant_id", "timezone", "day", "n_events", "value_sum",
                       F.when(F.col("__values") > 0, F.col("value_sum") / F.col("__values")).alias("value_mean"), "value_max",
                       clock.clock_hour("__first", "timezone").alias("first_h"), clock.clock_hour("__last", "timezone").alias("last_h"),
                       mean.alias("mean_h"), "hours", "arrived")


def freeze_reference(candidates: DataFrame, seed: int) -> DataFrame:
    """One seeded eligible day per person."""
    payload = [c for c in candidates.columns if c != "participant_id"]
    key = F.struct(hashing.seeded_digest(seed, "participant_id", "day"), F.col("day"))
    chosen = candidates.groupBy("participant_id").agg(F.min_by(F.struct(*payload), key).alias("r"))
    return chosen.select("participant_id", "r.*")


def fit_scaler(reference: DataFrame, features: Sequence[str], clocks: Sequence[str], minimum: int = 9) -> DataFrame:
    """One row: centre, mean and sample SD arrays in feature order.

    SD is NULL for a constant feature and everywhere when fewer than ``minimum`` people qualify.
    """
    center = reference.agg(F.array(*[
        clock.circular_summary(f)[0] if f in clocks else F.lit(0.0) for f in features]).alias("center")).scalar()
    placed = reference.withColumn("center", center)
    u = {f: clock.clock_delta(F.col(f), F.col("center")[i]) if f in clocks else F.col(f) for i, f in enumerate(features)}
    enough = F.count(F.lit(1)) >= minimum
    return placed.agg(
        F.first("center").alias("center"), F.array(*[F.avg(u[f]) for f in features]).alias("mean"),
        F.array(*[F.when(enough & (F.stddev_samp(u[f]) > 1e-12), F.stddev_samp(u[f])) for f in features]).alias("scale"),
        F.count(F.lit(1)).alias("n"))


class FrozenScaler(NamedTuple):
    """A fitted scale: three short lists in feature order, used as literals in later plans."""

    features: tuple[str, ...]
    clocks: tuple[str, ...]
    center: tuple
    mean: tuple
    scale: tuple

    def vector(self) -> Column:
        """Feature columns to a standardised array; NULL where a value or its scale is missing."""
        values = []
        for f, center, mean, scale in zip(self.features, self.center, self.mean, self.scale):
            x = F.col(f)
            if f in self.clocks:
                x = clock.clock_delta(x, F.lit(center).cast("double"))
            z = (x - F.lit(mean).cast("double")) / F.lit(scale) if scale is not None else F.lit(None).cast("double")
            values.append(z)
        return F.array(*values)


def freeze_scaler(reference: DataFrame, features: Sequence[str], clocks: Sequence[str], minimum: int = 9) -> FrozenScaler:
    """Fit once and keep the one-row result (three numbers per feature) for scoring plans."""
    row = fit_scaler(reference, features, clocks, minimum).first()
    return FrozenScaler(tuple(features), tuple(clocks), tuple(row["center"] or [None] * len(features)),
                        tuple(row["mean"]), tuple(row["scale"]))


def mean_abs_deviation(vec: Column) -> Column:
    """Mean absolute standardised deviation, NULL when any component is missing."""
    complete = F.forall(vec, lambda v: v.isNotNull())
    return F.when(complete, array_mean(F.transform(vec, lambda v: F.abs(v))))
