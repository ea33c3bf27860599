"""Ward occasions: timing shifts between ordered visits and person-level labels."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronowarn.functions.clock import circular_distance

CLOCK_FIELDS = ("sleep_start", "sleep_end", "meal_a", "meal_b", "meal_c")


def clock_evidence() -> Column:
    """Midpoint and meal clocks in minutes, NULL when any clock is missing, out of range or the sleep span is zero."""
    ok = F.lit(True)
    for f in CLOCK_FIELDS:
        ok = ok & F.coalesce((F.col(f) >= 0) & (F.col(f) < 1440), F.lit(False))
    span = F.pmod(F.col("sleep_end") - F.col("sleep_start"), F.lit(1440.0))
    return F.when(ok & (span > 0), F.struct(F.pmod(F.col("sleep_start") + span / 2, F.lit(1440.0)).alias("midpoint"), F.col("meal_a").alias("a"), F.col("meal_b").alias("b"), F.col("meal_c").alias("c")))


def _shift(x: Column, y: Column):
    sleep = circular_distance(x["midpoint"], y["midpoint"])
    meals = (circular_distance(x["a"], y["a"]) + circular_distance(x["b"], y["b"]) + circular_distance(x["c"], y["c"])) / 3
    return sleep, meals, F.least(sleep, meals)


def next_shift(rows: DataFrame) -> DataFrame:
    """Shift from each occasion to the person's next, with a status instead of a filled gap.

    Occasions are at most four per person by protocol.
    """
    order = W.partitionBy("participant_id").orderBy("occasion")
    e = rows.withColumn("e", clock_evidence())
    e = e.withColumn("n", F.lead("e").over(order)).withColumn("next_offset", F.lead("offset").over(order)).withColumn("has_next", F.lead("occasion").over(order).isNotNull())
    sleep, meals, joint = _shift(F.col("e"), F.col("n"))
    status = (F.when(~F.col("has_next"), None).when(F.col("offset").isNull() | F.col("next_offset").isNull(), "unavailable_date").when(F.col("next_offset") <= F.col("offset"), "nonincreasing_date")
              .when(F.col("e").isNull() | F.col("n").isNull(), "missing_clock_evidence").otherwise("observed_timing_shift"))
    e = e.withColumn("status", status).filter("has_next")
    seen = F.col("status") == "observed_timing_shift"
    return e.select("participant_id", "occasion", "status", F.when(seen, sleep).alias("sleep_shift_min"), F.when(seen, meals).alias("meal_shift_min"), F.when(seen, joint).alias("joint_shift_min"))


def person_label(rows: DataFrame, cutoff: float) -> DataFrame:
    """Strongest joint shift among complete later occasions (three at most), labelled against a cutoff.

    The three occasions are pivoted into one row per person, so their three pairs are plain columns.
    """
    e = rows.withColumn("e", clock_evidence())
    wide = e.groupBy("participant_id").agg(*[F.max(F.when(F.col("occasion") == k, F.col("e"))).alias(f"e{k}") for k in (2, 3, 4)],
                                           F.count(F.when(F.col("occasion") > 1, F.col("e"))).alias("complete_occasions"), F.array_sort(F.collect_set("occasion")).alias("occasions"))
    pairs = [F.when(F.col(f"e{a}").isNotNull() & F.col(f"e{b}").isNotNull(), _shift(F.col(f"e{a}"), F.col(f"e{b}"))[2]) for a, b in ((2, 3), (2, 4), (3, 4))]
    joint = F.greatest(*pairs)
    return wide.filter(F.col("occasions") == F.array(*[F.lit(k) for k in (1, 2, 3, 4)])).select(
        "participant_id", joint.alias("joint_shift_min"), (joint >= cutoff).cast("int").alias("label"), "complete_occasions")
