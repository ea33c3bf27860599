"""Daily behavioural measures: sleep, eating, activity, physiology, interval algebra."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronowarn.functions import clock
from chronowarn.functions.stats import ratio


def split_by_day(episodes: DataFrame, *, start="start_at", end="end_at", tz="timezone") -> DataFrame:
    """One row per research day an interval touches, with the part inside that day."""
    first = clock.research_day(start, tz)
    last = clock.research_day(F.col(end) - F.expr("INTERVAL 1 MICROSECOND"), tz)
    days = episodes.filter(F.col(end) > F.col(start)).withColumn("day", F.explode(F.sequence(first, last)))
    low, high = clock.local_boundary("day", tz), clock.local_boundary(F.date_add("day", 1), tz)
    return (days.withColumn("part_start", F.greatest(F.col(start), low))
            .withColumn("part_end", F.least(F.col(end), high)).filter("part_end > part_start"))


def daily_sleep(episodes: DataFrame) -> DataFrame:
    """Asleep hours inside each research day; NULL hours and a reason when episodes overlap."""
    parts = split_by_day(episodes)
    order = W.partitionBy("participant_id", "day").orderBy("part_start", "part_end")
    seconds = (F.unix_micros("part_end") - F.unix_micros("part_start")) / F.lit(3.6e9)
    marked = parts.withColumn("overlap", F.coalesce(F.lag("part_end").over(order) > F.col("part_start"), F.lit(False)))
    out = marked.groupBy("participant_id", "day").agg(
        F.count(F.lit(1)).alias("episodes"), F.sum(seconds).alias("hours"), F.max("overlap").alias("overlap"))
    return out.select("participant_id", "day", "episodes",
                      F.when(~F.col("overlap"), F.col("hours")).alias("sleep_duration_h"),
                      F.when(F.col("overlap"), "overlapping_episodes").alias("reason"))


def union_length(intervals: DataFrame, keys, start: str, end: str) -> DataFrame:
    """Covered length of possibly overlapping numeric intervals, counted once per key.

    Only the longest interval of each distinct start can matter, so rows are combined to
    one per (key, start) before the ordered pass.
    """
    best = intervals.filter(F.col(end) > F.col(start)).groupBy(*keys, start).agg(F.max(end).alias(end))
    order = W.partitionBy(*keys).orderBy(start)
    before = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    gain = F.greatest(F.lit(0.0), F.col(end) - F.greatest(F.col(start), F.coalesce(before, F.col(start))))
    return best.withColumn("gain", gain).groupBy(*keys).agg(F.sum("gain").alias("covered"))


def main_episode(episodes: DataFrame, keys, length: str, tie: str) -> DataFrame:
    """Longest episode per key, smallest id among equals."""
    payload = F.struct(*[c for c in episodes.columns if c not in keys])
    return episodes.groupBy(*keys).agg(F.max_by(payload, F.struct(F.col(length), -F.col(tie))).alias("m")).select(*keys, "m.*")


def daily_eating(events: DataFrame) -> DataFrame:
    """First and last clock of events with positive energy on completely logged days."""
    base = events.withColumn("day", clock.research_day("start_at", "timezone"))
    eaten = F.when(F.col("energy") > 0, F.col("start_at"))
    out = base.groupBy("participant_id", "timezone", "day").agg(
        F.min(eaten).alias("a"), F.max(eaten).alias("b"), F.min("complete").alias("complete"))
    return out.select("participant_id", "day",
                      F.when(F.col("complete"), clock.clock_hour("a", "timezone")).alias("first_caloric_h"),
                      F.when(F.col("complete"), clock.clock_hour("b", "timezone")).alias("last_caloric_h"))


def normalise_wear(hourly: DataFrame, keys, *, minimum_hour: float = 45.0, minimum_day: float = 1200.0) -> DataFrame:
    """Counts per 60 worn minutes; short-worn hours are NULL, short-worn days wholly NULL.

    Input holds keys, hour, count and wear; keys name one day, so groups have 24 rows.
    """
    day = W.partitionBy(*keys)
    rate = F.when(F.col("wear") >= minimum_hour, F.col("count") * (F.lit(60.0) / F.col("wear")))
    return hourly.withColumn("rate", F.when(F.sum("wear").over(day) >= minimum_day, rate))


def hour_array(hourly: DataFrame, keys, hour: str, value: str, fill=None) -> DataFrame:
    """24-slot array per key by local hour, absent hours filled or NULL."""
    slots = [F.coalesce(F.max(F.when(F.col(hour) == h, F.col(value))), F.lit(fill).cast("double")) for h in range(24)]
    return hourly.groupBy(*keys).agg(F.array(*slots).alias("hours"))


def _cyclic_means(hours: Column, width: int) -> Column:
    doubled = F.concat(hours, hours)
    return F.transform(F.sequence(F.lit(1), F.lit(24)),
                       lambda i: F.aggregate(F.slice(doubled, i, F.lit(width)), F.lit(0.0), lambda a, v: a + v) / width)


def activity_summary(profiles: DataFrame, hours: str = "hours") -> DataFrame:
    """M10, L5, relative amplitude, unique M10 start and total; NULL for incomplete profiles."""
    complete = F.forall(hours, lambda v: v.isNotNull())
    h = F.when(complete, F.col(hours))
    p = profiles.withColumn("__ten", _cyclic_means(h, 10)).withColumn("__five", _cyclic_means(h, 5))
    p = p.withColumn("m10", F.array_max("__ten")).withColumn("l5", F.array_min("__five"))
    ranked = F.sort_array("__ten", asc=False)
    tied = F.get(ranked, F.lit(1)) >= F.col("m10") - F.lit(1e-12) * F.abs(F.col("m10"))
    start = F.array_position("__ten", F.col("m10")) - 1
    return (p.withColumn("activity_m10_start_h", F.when((F.col("m10") > F.col("l5")) & ~tied, start.cast("double")))
            .withColumn("activity_ra", F.when(F.col("m10") + F.col("l5") > 0, ratio(F.col("m10") - F.col("l5"), F.col("m10") + F.col("l5"))))
            .withColumn("activity_total", F.aggregate(h, F.lit(0.0), lambda a, v: a + v))
            .drop("__ten", "__five"))


def activity_regularity(rows: DataFrame, n: str, squares: str, hour_sums: str, out: str, minimum: int = 6) -> DataFrame:
    """1 - interdaily stability of ``n`` complete 24-hour profiles, from the sum of their squares and their sums by hour.

    Sums keep a window's cost per row at 26 numbers; the profiles themselves are not gathered.
    """
    enough = F.when(F.col(n) >= minimum, F.col(hour_sums))
    staged = rows.withColumn("__t", F.aggregate(enough, F.lit(0.0), lambda a, v: a + v)).withColumn("__m", F.aggregate(enough, F.lit(0.0), lambda a, v: a + v * v))
    staged = staged.withColumn("__g", F.col("__t") * F.col("__t") / (F.col(n) * 24)).withColumn("__d", F.col(squares) - F.col("__g"))
    stability = F.try_divide(F.col("__m") / F.col(n) - F.col("__g"), F.col("__d"))
    value = F.when(F.col("__d") > 0, F.lit(1.0) - F.least(F.lit(1.0), F.greatest(F.lit(0.0), stability)))
    return staged.withColumn(out, value).drop("__t", "__m", "__g", "__d")


def intradaily_variability(hours: Column) -> Column:
    """Successive squared change against total squared deviation of one 24-hour profile."""
    n = F.size(hours)
    total = F.aggregate(hours, F.lit(0.0), lambda a, v: a + v)
    spread = F.aggregate(hours, F.lit(0.0), lambda a, v: a + v * v) - total * total / n
    steps = F.zip_with(F.slice(hours, F.lit(2), n - 1), F.slice(hours, F.lit(1), n - 1), lambda b, a: (b - a) * (b - a))
    change = F.aggregate(steps, F.lit(0.0), lambda a, v: a + v)
    complete = F.forall(hours, lambda v: v.isNotNull())
    return F.when(complete & (spread > 0), F.try_divide(n * change, (n - 1) * spread))


def sleep_regularity_index(states: DataFrame, keys, epoch: str, state: str, epochs_per_day: int) -> DataFrame:
    """200 * P(same state one day apart) - 100 on a complete grid with one row per (key, epoch)."""
    order = W.partitionBy(*keys).orderBy(epoch)
    pair = states.withColumn("prior", F.lag(state, epochs_per_day).over(order))
    same = F.when(F.col("prior").isNotNull(), (F.col("prior") == F.col(state)).cast("double"))
    return pair.groupBy(*keys).agg((F.avg(same) * 200 - 100).alias("sri"), F.count(F.lit(1)).alias("epochs"))


def weighted_clock(entries: DataFrame, keys, hour: str, weight: str) -> DataFrame:
    """Total weight and weight-averaged circular hour, NULL with no direction."""
    angle = F.col(hour) * (2 * F.pi() / 24)
    out = entries.groupBy(*keys).agg(F.sum(weight).alias("minutes"), F.sum(F.col(weight) * F.cos(angle)).alias("x"),
                                     F.sum(F.col(weight) * F.sin(angle)).alias("y"))
    hour_of = F.when(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2) > 1e-9, F.pmod(F.atan2("y", "x") * 24 / (2 * F.pi()), F.lit(24.0)))
    return out.select(*keys, "minutes", hour_of.alias("clock_h"))


def agreed_value(entries: DataFrame, keys, value: str) -> DataFrame:
    """The sole distinct value per key, and whether values conflict."""
    out = entries.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return out.select(*keys, F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("agreed"),
                      F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("conflict"))


def physiology(values: DataFrame, keys) -> DataFrame:
    """Mean, sample SD and median of resting values inside the acquisition range."""
    ok = F.col("value").between(20, 250)
    x = F.when(ok, F.col("value"))
    return values.groupBy(*keys).agg(
        F.median(F.when(F.col("resting"), x)).alias("resting_hr_bpm"), F.avg(x).alias("heart_rate_bpm"),
        F.stddev_samp(x).alias("hr_sd_bpm"))
