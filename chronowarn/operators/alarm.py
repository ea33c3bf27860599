"""Daily alarm policy as one ordered fold per person.

A person contributes at most one row per calendar day, so the sorted array a fold walks
is bounded by the length of the calendar.
"""

from pyspark.sql import Column, DataFrame, functions as F

STATE = "struct<last_day:date,last_alarm:date,run:int,warning:int,status:string,out:array<struct<day:date,warning:int,status:string>>>"


def _advance(state: Column, item: Column, threshold: Column, consecutive: int, cooldown_days: int):
    adjacent = state["last_day"] == F.date_sub(item["day"], 1)
    exceeds = F.coalesce(item["score"] > threshold, F.lit(False))
    run = F.when(exceeds, F.when(F.coalesce(adjacent, F.lit(False)), state["run"]).otherwise(0) + 1).otherwise(0)
    cooling = F.coalesce(F.datediff(item["day"], state["last_alarm"]) < cooldown_days, F.lit(False))
    known = item["score"].isNotNull() & threshold.isNotNull()
    fires = known & ~cooling & (run >= consecutive)
    status = (F.when(item["score"].isNull(), "insufficient_data").when(threshold.isNull(), "uncalibrated")
              .when(cooling, "cooldown").when(fires, "warning").otherwise("monitoring"))
    warning = F.when(known, fires.cast("int"))
    return run, fires, warning, status


def replay(scores: DataFrame, threshold, *, consecutive: int = 2, cooldown_days: int = 7,
           keys=("participant_id",), day: str = "day", score: str = "score") -> DataFrame:
    """Rows (keys, day, score, warning, status) for every day of every person.

    ``threshold`` is a number, NULL, or a column constant within the keys.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold).cast("double")
    rows = scores.select(*keys, F.col(day).alias("day"), F.col(score).cast("double").alias("score"), limit.alias("threshold"))
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "score"))).alias("days"),
                                      F.first("threshold").alias("threshold"))
    empty = F.from_json(F.lit('{"run":0,"out":[]}'), STATE)

    def step(state, item):
        run, fires, warning, status = _advance(state, item, F.col("threshold"), consecutive, cooldown_days)
        return F.struct(
            item["day"].alias("last_day"), F.when(fires, item["day"]).otherwise(state["last_alarm"]).alias("last_alarm"),
            F.when(fires, 0).otherwise(run).cast("int").alias("run"), warning.alias("warning"), status.alias("status"),
            F.concat(state["out"], F.array(F.struct(item["day"].alias("day"), warning.alias("warning"), status.alias("status")))).alias("out"),
        ).cast(STATE)

    folded = grouped.select(*keys, "days", F.aggregate("days", empty, step, lambda s: s["out"]).alias("out"))
    pairs = folded.select(*keys, F.explode(F.arrays_zip("days", "out")).alias("z"))
    return pairs.select(*keys, F.col("z.days.day").alias("day"), F.col("z.days.score").alias("score"),
                        F.col("z.out.warning").alias("warning"), F.col("z.out.status").alias("status"))
