"""Streaming twins of the daily panel and the alarm policy."""

from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DateType, DoubleType, IntegerType, StringType, StructField, StructType

from chronowarn.functions import clock
from chronowarn.sources.store import append_new, table_exists

EPOCH = date(1970, 1, 1)
OUTPUT = "participant_id long, day date, score double, warning int, status string"
STATE = StructType([StructField("last_day", DateType()), StructField("last_alarm", DateType()), StructField("run", IntegerType())])


def replay_days(days: np.ndarray, scores: np.ndarray, threshold: float | None, consecutive: int, cooldown_days: int, carried=(None, None, 0)):
    """Warnings and statuses of one person's ascending days (whole numbers), and what later days need to know.

    The same policy as ``operators.alarm.replay``, as array steps: streaks of exceeding days are measured for all days
    at once, and only the alarms themselves, which cut a streak and open a cooldown, are walked.  ``carried`` is
    (last day, last alarm, streak so far); NaN is a missing score.
    """
    last_day, last_alarm, streak = carried
    n, here = len(days), np.arange(len(days))
    above = scores > (np.inf if threshold is None else threshold)
    follows = np.diff(days, prepend=days[0] if last_day is None else last_day) == 1
    joins = above & follows & np.r_[streak > 0, above[:-1]]
    opened = np.maximum.accumulate(np.where(joins, -1, here))   # where each day's streak began; -1: before these days
    length = np.where(above, here - opened + np.where(opened < 0, streak, 1), 0)
    fires, cooling, reset, at = np.zeros(n, bool), np.zeros(n, bool), -1, 0
    while at < n:
        if last_alarm is not None:
            until = int(np.searchsorted(days, last_alarm + cooldown_days))
            cooling[at:until] = True
            at = max(at, until)
        ready = np.flatnonzero(np.minimum(length[at:], here[at:] - reset if reset >= 0 else length[at:]) >= consecutive)
        if not len(ready):
            break
        reset = at + int(ready[0])
        fires[reset], last_alarm, at = True, int(days[reset]), reset + 1
    missing = np.isnan(scores)
    status = np.select([missing, np.full(n, threshold is None), cooling, fires], ["insufficient_data", "uncalibrated", "cooldown", "warning"], "monitoring")
    warning = [None if m or threshold is None else int(f) for m, f in zip(missing, fires)]
    left = int(length[-1]) if reset < 0 else min(int(length[-1]), n - 1 - reset)
    return warning, status.tolist(), (int(days[-1]), last_alarm, left)


class AlarmProcessor(StatefulProcessor):
    """Keeps a person's last day, last alarm and run; replayed or late days go out as rejects."""

    def __init__(self, threshold: float | None, consecutive: int = 2, cooldown_days: int = 7):
        self.threshold, self.consecutive, self.cooldown_days = threshold, consecutive, cooldown_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alarm", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("day", kind="stable")
        day = pd.to_datetime(batch["day"]).to_numpy("datetime64[D]").astype(np.int64)
        carried = tuple(self.state.get()) if self.state.exists() else (None, None, 0)
        known = -np.inf if carried[0] is None else (carried[0] - EPOCH).days
        fresh = (day > known) & np.r_[True, day[1:] != day[:-1]]
        batch["warning"], batch["status"] = None, "rejected_replay"
        if fresh.any():
            state = tuple(None if d is None else (d - EPOCH).days for d in carried[:2]) + (carried[2],)
            scores = batch["score"].astype(float).to_numpy()[fresh]
            warning, status, state = replay_days(day[fresh], scores, self.threshold, self.consecutive, self.cooldown_days, state)
            batch.loc[fresh, "warning"], batch.loc[fresh, "status"] = pd.Series(warning, index=batch.index[fresh], dtype=object), status
            self.state.update(tuple(None if d is None else EPOCH + timedelta(days=d) for d in state[:2]) + (state[2],))
        batch["warning"] = batch["warning"].astype("Int32")
        yield batch.assign(participant_id=key[0])[["participant_id", "day", "score", "warning", "status"]]

    def close(self) -> None:
        pass


def alarm_stream(scores: DataFrame, threshold: float | None, *, consecutive: int = 2, cooldown_days: int = 7) -> DataFrame:
    """Warnings of a stream of (participant_id, day, score) rows with state carried between batches."""
    processor = AlarmProcessor(threshold, consecutive, cooldown_days)
    return scores.groupBy("participant_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def daily_counts(observations: DataFrame, delay: str = "2 days") -> DataFrame:
    """Research-day sums of a stream; rows later than the watermark affect no emitted day."""
    day = clock.research_day("start_at", "timezone")
    opened = clock.local_boundary(day, "timezone")
    timed = observations.withColumn("day", day).withColumn("opened_at", opened).withWatermark("opened_at", delay)
    return timed.groupBy("participant_id", "day", F.window("opened_at", "1 hour").alias("slot")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("value_sum")).drop("slot")


def fixed_zone_days(observations: DataFrame, delay: str = "1 day") -> DataFrame:
    """04:00 to 04:00 tumbling windows for a stream in one fixed-offset zone."""
    return (observations.withWatermark("start_at", delay).groupBy("variable", F.window("start_at", "1 day", startTime="4 hours").alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("variable", F.to_date("w.start").alias("day"), "n", "total"))


def issue_once(forecasts: DataFrame, path: str, checkpoint: str, keys=("participant_id", "issued_at")):
    """Write each forecast once: duplicates inside the watermark are dropped, replayed batches are ignored."""
    once = forecasts.withWatermark("issued_at", "3 days").dropDuplicatesWithinWatermark(list(keys))
    return once.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: append_new(df, path, list(keys))).trigger(availableNow=True).start()


def resume_tasks(tasks: DataFrame, path: str, score, checkpoint: str):
    """Score only tasks whose key has no stored result yet; ``score`` maps a batch DataFrame to (task_id, result)."""
    def run(batch: DataFrame, _):
        spark = batch.sparkSession
        todo = batch.dropDuplicates(["task_id"])
        if table_exists(spark, path):
            todo = todo.join(spark.read.parquet(path).select("task_id"), "task_id", "left_anti")
        score(todo).write.mode("append").parquet(path)
    return tasks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()
