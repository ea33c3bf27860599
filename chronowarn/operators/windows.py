"""Calendar spines, trailing windows, causal history and runs.

Inputs hold at most one row per (person, day); windows by person are bounded by the calendar.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronowarn.functions import clock
from chronowarn.functions.ordering import previous_row, running_totals
from chronowarn.operators.measures import activity_regularity

MICROS_PER_DAY = 86_400_000_000


def calendar_spine(panel: DataFrame, keys: Sequence[str] = ("participant_id",), day: str = "day") -> DataFrame:
    """Every calendar day between a person's first and last day, absent days as NULL rows.

    Each row is followed by the absent days up to the person's next row, so ``panel`` is read once and moves once.
    Rows without a day are left out; where a key is NULL the days stay but are empty.
    """
    following = F.lead(day).over(W.partitionBy(*keys).orderBy(day))
    days = F.sequence(F.col(day), F.greatest(F.col(day), F.date_sub(following, 1)))
    filled = panel.filter(F.col(day).isNotNull()).withColumn("__days", days).withColumn("__day", F.explode("__days"))
    own = F.col("__day") == F.col(day)
    for k in keys:
        own = own & F.col(k).isNotNull()
    return filled.select(*keys, F.col("__day").alias(day), *[F.when(own, F.col(c)).alias(c) for c in panel.columns if c not in (*keys, day)])


def trailing(keys: Sequence[str], order: str, rows: int):
    return W.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)


def spread_people(rows: DataFrame) -> DataFrame:
    """Rows by person in a number of tasks that adaptive execution keeps, for short rows that cost much each.

    One task more than shuffles have by default: of an equal number the exchange would be folded into an earlier one,
    which adaptive execution merges by bytes.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) + 1
    return rows.repartition(tasks, "participant_id")


def rolling_outcomes(daily: DataFrame, window: int = 7, minimum: int = 6) -> DataFrame:
    """S1, E1 and A1 over each trailing calendar window of a spine.

    Every day gives numbers once (cosines, sines, hours) and the windows only add them.
    Needs midpoint_h, first_h, last_h and a 24-slot ``hours`` array (NULL on absent days).
    """
    frame = trailing(["participant_id"], "day", window)
    paired = F.col("first_h").isNotNull() & F.col("last_h").isNotNull()
    clocks = {"mid": F.col("midpoint_h"), "first": F.when(paired, F.col("first_h")), "last": F.when(paired, F.col("last_h"))}
    whole = F.when(F.forall("hours", lambda v: v.isNotNull()), F.col("hours"))
    staged = daily.withColumn("__p", whole).withColumn("__hq", F.aggregate("__p", F.lit(0.0), lambda a, v: a + v * v))
    staged = staged.select("*", *[c.alias(f"__{k}_{i}") for k, v in clocks.items() for i, c in enumerate(clock.circular_parts(v))])
    sums = spread_people(staged).select(
        *daily.columns, *[F.sum(f"__{k}_{i}").over(frame).alias(f"__{k}_{i}") for k in clocks for i in range(3)],
        F.count("__p").over(frame).alias("__n"), F.sum("__hq").over(frame).alias("__q"),
        F.array(*[F.sum(F.get("__p", F.lit(h))).over(frame) for h in range(24)]).alias("__s"))
    s1, first, last = (clock.circular_from_sums(*[F.col(f"__{k}_{i}") for i in range(3)], minimum=minimum)[1] for k in clocks)
    e1 = F.when(first.isNotNull() & last.isNotNull(), F.greatest(first, last))
    return activity_regularity(sums.select(*daily.columns, s1.alias("S1"), e1.alias("E1"), "__n", "__q", "__s"), "__n", "__q", "__s", "A1", minimum).drop("__n", "__q", "__s")


def select_window(spine: DataFrame, *, days: int, minimum: int, max_missing_run: int,
                  complete: str = "complete", available_at: str = "available_at", as_of: str = "as_of") -> DataFrame:
    """Completeness of the trailing window as known at each row's ``as_of``.

    A day counts when its vector is complete and had arrived by then.  Days before the
    person's first row are missing days.
    """
    frame = trailing(["participant_id"], "day", days)
    item = F.struct(F.coalesce(F.col(complete), F.lit(False)).alias("ok"), F.col(available_at).alias("at"))
    staged = spine.withColumn("__w", F.collect_list(item).over(frame))
    flags = F.transform("__w", lambda e: F.coalesce(e["ok"] & (e["at"] <= F.col(as_of)), F.lit(False)))
    staged = staged.withColumn("__f", flags)
    lead = F.lit(days) - F.size("__f")
    start = F.struct(lead.alias("run"), lead.alias("longest"))

    def step(acc, ok):
        run = F.when(ok, 0).otherwise(acc["run"] + 1)
        return F.struct(run.alias("run"), F.greatest(acc["longest"], run).alias("longest"))

    longest = F.aggregate("__f", start, step, lambda a: a["longest"])
    count = F.size(F.filter("__f", lambda v: v))
    reason = (F.when(~F.element_at("__f", -1), "missing_target_day").when(count < minimum, "insufficient_complete_days")
              .when(longest > max_missing_run, "missing_run_too_long"))
    return (staged.withColumn("complete_days", count).withColumn("longest_missing_run", longest)
            .withColumn("reason", reason).drop("__w", "__f"))


def causal_history(panel: DataFrame, features: Sequence[str], history_days: int, at: str = "issued_at") -> DataFrame:
    """Current value, trailing mean, sample SD over (t - N days, t] and change from exactly one day before."""
    micros = F.unix_micros(at)
    person = W.partitionBy("participant_id").orderBy("__t")
    frame = person.rangeBetween(-(history_days * MICROS_PER_DAY - 1), 0)
    out = panel.withColumn("__t", micros)
    adjacent = F.col("__t") - F.lag("__t").over(person) == MICROS_PER_DAY
    for f in features:
        out = (out.withColumn(f"mean_{f}", F.avg(f).over(frame)).withColumn(f"sd_{f}", F.stddev_samp(f).over(frame))
               .withColumn(f"change_{f}", F.when(adjacent, F.col(f) - F.lag(f).over(person))))
    return out.drop("__t")


def causal_smooth(scores: DataFrame, half_life: float, at: str = "day", out: str = "smoothed") -> DataFrame:
    """Exponential smoothing by elapsed days; a NULL score stays NULL but decay goes on."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(at).alias("t"), F.col("score").cast("double").alias("score"))))
    grouped = scores.groupBy("participant_id").agg(rows.alias("__r"))
    state = "struct<t:date,num:double,den:double,out:array<struct<t:date,score:double,smoothed:double>>>"
    empty = F.from_json(F.lit('{"num":0.0,"den":0.0,"out":[]}'), state)

    def step(s, r):
        gap = F.datediff(r["t"], s["t"])
        decay = F.lit(0.0) if half_life == 0 else F.coalesce(F.pow(F.lit(2.0), -gap / F.lit(float(half_life))), F.lit(0.0))
        num = s["num"] * decay + F.coalesce(r["score"], F.lit(0.0))
        den = s["den"] * decay + r["score"].isNotNull().cast("double")
        value = F.when(r["score"].isNotNull(), F.try_divide(num, den))
        return F.struct(r["t"].alias("t"), num.alias("num"), den.alias("den"),
                        F.concat(s["out"], F.array(F.struct(r["t"].alias("t"), r["score"].alias("score"), value.alias("smoothed")))).alias("out")).cast(state)

    done = grouped.select("participant_id", F.explode(F.aggregate("__r", empty, step, lambda s: s["out"])).alias("z"))
    return done.select("participant_id", F.col("z.t").alias(at), F.col("z.score").alias("score"), F.col("z.smoothed").alias(out))


def previous_day_change(panel: DataFrame, vec: str = "vec") -> DataFrame:
    """Mean absolute change of a complete vector from the adjacent previous day."""
    order = W.partitionBy("participant_id").orderBy("day")
    complete = F.forall(vec, lambda v: v.isNotNull())
    staged = panel.withColumn("__v", F.when(complete, F.col(vec)))
    prior, when = F.lag("__v").over(order), F.lag("day").over(order)
    staged = staged.withColumn("__p", F.when(when == F.date_sub("day", 1), prior))
    diff = F.zip_with("__v", "__p", lambda a, b: F.abs(a - b))
    mean = F.aggregate(diff, F.lit(0.0), lambda a, v: a + v) / F.size("__v")
    return staged.withColumn("previous_day_change", F.when(F.col("__p").isNotNull() & F.col("__v").isNotNull(), mean)).drop("__v", "__p")


def trailing_trends(panel: DataFrame, features: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """Trailing mean, sample SD and least-squares slope per step for each feature and window length."""
    order = W.partitionBy("participant_id").orderBy("day")
    out = panel.withColumn("__i", F.row_number().over(order).cast("double"))
    for w in windows:
        frame = order.rowsBetween(-(w - 1), 0)
        for f in features:
            out = (out.withColumn(f"mean{w}_{f}", F.avg(f).over(frame)).withColumn(f"sd{w}_{f}", F.stddev_samp(f).over(frame))
                   .withColumn(f"slope{w}_{f}", F.regr_slope(F.col(f), F.col("__i")).over(frame)))
    return out.drop("__i")


def streaks(days: DataFrame, keys: Sequence[str], day: str = "day") -> DataFrame:
    """Runs of consecutive calendar days that occur exactly once per key: start and length."""
    single = days.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    order = W.partitionBy(*keys).orderBy(day)
    island = single.withColumn("island", F.date_sub(F.col(day), F.row_number().over(order)))
    return island.groupBy(*keys, "island").agg(F.min(day).alias("first_day"), F.count(F.lit(1)).alias("length")).drop("island")


def calendar_capacity(days: DataFrame, keys: Sequence[str], future_days: int, history_days: int = 0, day: str = "day") -> DataFrame:
    """Longest streak and the number of windows with full history and future cover."""
    spare = F.greatest(F.lit(0), F.col("length") - history_days - future_days)
    runs = streaks(days, keys, day).groupBy(*keys).agg(F.max("length").alias("longest_streak"), F.sum(spare).alias("windows"))
    counts = days.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_days"), F.count_if(F.col("n") > 1).alias("duplicate_days"))
    return counts.join(runs, list(keys), "left").fillna(0, ["longest_streak", "windows"])


def first_n(rows: DataFrame, n: int, order: str = "day") -> DataFrame:
    """First ``n`` rows per person; people with fewer are reported by ``enough`` = false."""
    w = W.partitionBy("participant_id")
    ranked = rows.withColumn("rn", F.row_number().over(w.orderBy(order))).withColumn("enough", F.count(F.lit(1)).over(w) >= n)
    return ranked.filter(F.col("rn") <= n)


def relative_days(rows: DataFrame, key: str, order: str, weekday: str) -> DataFrame:
    """Day index rising by one at each weekday change; ``bad_step`` marks a change of more than a day.

    Raw answers of one person may be many, so both passes cut a person's rows into order buckets.
    """
    prior = F.col("prev")[weekday]
    staged = previous_row(rows, [key], order, [weekday])
    staged = staged.withColumn("step", F.coalesce((prior != F.col(weekday)).cast("int"), F.lit(0))).withColumn(
        "bad_step", F.coalesce((prior != F.col(weekday)) & (F.col(weekday) != F.pmod(prior + 1, F.lit(7))), F.lit(False)))
    return running_totals(staged, order, ["step"], by=[key]).withColumn("day_index", F.col("cum_step")).drop("cum_step", "total_step", "step", "prev")


def occasion_numbers(rows: DataFrame, key: str, order: str, out: str = "occasion") -> DataFrame:
    """1, 2, 3, ... in source order within each key, without one task per key."""
    counted = running_totals(rows.withColumn("__one", F.lit(1)), order, ["__one"], by=[key])
    return counted.withColumn(out, F.col("cum___one").cast("int")).drop("__one", "cum___one", "total___one")


def personal_baseline(panel: DataFrame, features: Sequence[str], clocks: Sequence[str], baseline_days: int) -> DataFrame:
    """Scale every later day by the person's own first ``baseline_days`` rows (clocks unwrapped)."""
    order = W.partitionBy("participant_id").orderBy("day")
    p = panel.withColumn("day_index", F.row_number().over(order) - 1)
    base = F.col("day_index") < baseline_days
    person = W.partitionBy("participant_id")
    out = p.withColumn("baseline_rows", F.count(F.when(base, 1)).over(person))
    for f in features:
        if f in clocks:
            center, _ = clock.circular_summary(F.when(base, F.col(f)), window=person)
            out = out.withColumn(f"__c_{f}", center).withColumn(f"__u_{f}", clock.clock_delta(F.col(f), F.col(f"__c_{f}")))
        else:
            out = out.withColumn(f"__c_{f}", F.avg(F.when(base, F.col(f))).over(person)).withColumn(f"__u_{f}", F.col(f) - F.col(f"__c_{f}"))
        sd = F.stddev_samp(F.when(base, F.col(f"__u_{f}"))).over(person)
        out = out.withColumn(f"__s_{f}", sd)
    z = F.array(*[F.when(F.col(f"__s_{f}") > 1e-8, F.try_divide(F.col(f"__u_{f}"), F.col(f"__s_{f}"))) for f in features])
    drop = [f"__{k}_{f}" for k in "cus" for f in features]
    return out.withColumn("z", z).drop(*drop)


def qualifying_runs(rows: DataFrame, condition: Column, persistence: int) -> DataFrame:
    """Add run start, position and length for runs of adjacent qualifying days.

    A day whose condition is unknown does not qualify and breaks a run.
    """
    key = W.partitionBy("participant_id")
    flagged = rows.withColumn("__q", F.coalesce(condition, F.lit(False)))
    numbered = flagged.withColumn("__n", F.row_number().over(W.partitionBy("participant_id", "__q").orderBy("day")))
    island = numbered.withColumn("__g", F.when(F.col("__q"), F.date_sub("day", F.col("__n"))))
    run = W.partitionBy("participant_id", "__g")
    return (island.withColumn("run_start", F.when(F.col("__q"), F.min("day").over(run)))
            .withColumn("run_length", F.when(F.col("__q"), F.count(F.lit(1)).over(run)))
            .withColumn("run_position", F.when(F.col("__q"), F.datediff("day", F.min("day").over(run)) + 1))
            .withColumn("confirmed", F.coalesce(F.col("run_length") >= persistence, F.lit(False)))
            .withColumnRenamed("__q", "qualifies").drop("__n", "__g"))


def level_and_trend(spine: DataFrame, features: Sequence[str], window: int) -> DataFrame:
    """Last observed value, mean absolute value and slope per calendar day inside each window."""
    order = W.partitionBy("participant_id").orderBy("day")
    frame = order.rowsBetween(-(window - 1), 0)
    out = spine.withColumn("__t", F.unix_date("day").cast("double"))
    for f in features:
        out = (out.withColumn(f"level_{f}", F.last(f, True).over(frame)).withColumn(f"deviation_{f}", F.avg(F.abs(f)).over(frame))
               .withColumn(f"trend_{f}", F.regr_slope(F.col(f), F.col("__t")).over(frame)))
    return out.drop("__t")
