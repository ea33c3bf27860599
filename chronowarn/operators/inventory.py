"""Inventory of a record store: what each source holds, what of it can be traced, who was already used, and how long runs of days are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

TRACED = "source_traceable_retrospective"   # fixed value: kind of a cell whose source value is kept


def exposed_people(records: DataFrame, exposures: DataFrame, person: str = "participant_id", record: str = "record_id") -> DataFrame:
    """People that an earlier development set has seen, by name or through one of their records."""
    by_record = records.select(person, record).join(exposures.select(record).where(F.col(record).isNotNull()).distinct(), record, "left_semi").select(person)
    return exposures.select(person).where(F.col(person).isNotNull()).unionByName(by_record).distinct()


def day_runs(records: DataFrame, keys: Sequence[str], day: str, future_days: int) -> DataFrame:
    """Per key: unique_days, duplicate_days, longest_streak, and window_upper_bound of days with ``future_days`` behind them.

    A day with several records is ambiguous: it is counted and takes part in no streak.  Records are counted per day
    before anything is ordered, so a window holds a key's calendar and not its records.
    """
    days = records.where(F.col(day).isNotNull()).groupBy(*keys, day).agg(F.count(F.lit(1)).alias("_k"))
    totals = days.groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_days"), F.count_if(F.col("_k") > 1).alias("duplicate_days"))
    run = F.date_sub(F.col(day), F.row_number().over(W.partitionBy(*keys).orderBy(day)).cast("int"))
    runs = days.where("_k = 1").withColumn("_run", run).groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_n"))
    best = runs.groupBy(*keys).agg(F.max("_n").alias("longest_streak"), F.sum(F.greatest(F.col("_n") - future_days, F.lit(0))).alias("window_upper_bound"))
    return totals.join(best, list(keys), "left").na.fill(0, ["longest_streak", "window_upper_bound"])


def expansion_inventory(records: DataFrame, exposures: DataFrame, fields: Sequence[str], panels: dict[str, Sequence[str]], future_days: int = 9) -> DataFrame:
    """One row per source of ``records`` (source, participant_id, record_id, day, cells map, evidence map).

    A cell counts as traceable if it has a value and its evidence is ``TRACED``.  Returns records, people,
    exposed_people, rows_with_traced, traced_<field>, rows whose whole panel is traced, people with 14 and 30 days in a
    row, and the upper bound of calendar windows, which is not a number of labelled predictions.
    """
    traced = {f: F.coalesce(F.try_element_at("cells", F.lit(f)).isNotNull() & (F.try_element_at("evidence", F.lit(f)) == TRACED), F.lit(False)) for f in fields}
    some, whole = F.lit(False), {}
    for f in fields:
        some = some | traced[f]
    for name, members in panels.items():
        whole[name] = F.lit(True)
        for f in members:
            whole[name] = whole[name] & traced[f]
    counts = records.groupBy("source").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(some).alias("rows_with_traced"), *[F.count_if(c).alias(f"traced_{f}") for f, c in traced.items()],
        *[F.count_if(c).alias(f"panel_{name}") for name, c in whole.items()])
    seen = exposed_people(records, exposures).withColumn("_exposed", F.lit(1))
    people = day_runs(records, ["source", "participant_id"], "day", future_days)
    every = records.select("source", "participant_id").distinct().join(people, ["source", "participant_id"], "left").join(seen, "participant_id", "left")
    by_source = every.groupBy("source").agg(
        F.count(F.lit(1)).alias("people"), F.count("_exposed").alias("exposed_people"), F.count_if(F.col("longest_streak") >= 14).alias("people_14_days"),
        F.count_if(F.col("longest_streak") >= 30).alias("people_30_days"), F.sum("duplicate_days").alias("duplicate_days"), F.sum("window_upper_bound").alias("window_upper_bound"))
    return counts.join(by_source, "source")
