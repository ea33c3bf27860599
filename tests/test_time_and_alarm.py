"""Local days against zoneinfo, circular clocks, and the alarm policy's known traces."""

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from chronowarn.functions import clock
from chronowarn.operators import alarm
from chronowarn.streaming.alarms import alarm_stream, replay_days

ZONES = ["UTC", "Europe/London", "America/New_York", "Asia/Shanghai"]


def test_research_day_matches_zoneinfo(spark):
    rng = np.random.default_rng(1)
    base = datetime(2025, 3, 1, tzinfo=timezone.utc)
    rows = [((base + timedelta(minutes=int(m))).replace(tzinfo=None).isoformat(sep=" "), ZONES[int(m) % 4]) for m in rng.integers(0, 60 * 24 * 300, 400)]
    df = spark.createDataFrame(rows, "t string, tz string").withColumn("ts", F.col("t").cast("timestamp"))
    got = df.select("t", "tz", clock.research_day("ts", "tz").alias("d"), F.unix_seconds(clock.local_boundary(clock.research_day("ts", "tz"), "tz")).alias("b")).collect()
    for r in got:
        local = datetime.fromisoformat(r["t"]).replace(tzinfo=timezone.utc).astimezone(ZoneInfo(r["tz"]))
        day = local.date() - timedelta(days=int(local.hour < 4))
        assert r["d"] == day
        assert r["b"] == int(datetime(day.year, day.month, day.day, 4, tzinfo=ZoneInfo(r["tz"])).timestamp())


def test_nonexistent_and_ambiguous_local_times(spark):
    df = spark.createDataFrame([("2025-03-30 01:30:00",), ("2025-10-26 01:30:00",), ("2025-06-01 12:00:00",)], "t string").select(
        F.col("t").cast("timestamp").alias("l"), F.lit("Europe/London").alias("tz"))
    got = df.select(clock.is_nonexistent("l", "tz"), clock.is_ambiguous("l", "tz")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, False)]


def test_instants_need_an_offset(spark):
    df = spark.createDataFrame([("2025-01-01T00:00:00Z",), ("2025-01-01T08:00:00+08:00",), ("2025-01-01T00:00:00",), ("soon",)], "t string")
    got = [r[0] for r in df.select(F.unix_seconds(clock.parse_instant("t"))).collect()]
    assert got == [1735689600, 1735689600, None, None]


def test_circular_summary_edges(spark):
    df = spark.createDataFrame([("even", h) for h in (0.0, 6.0, 12.0, 18.0)] + [("wrap", 23.5), ("wrap", 0.5)], "k string, h double")
    mean, sd = clock.circular_summary("h")
    got = {r["k"]: (r["m"], r["s"]) for r in df.groupBy("k").agg(mean.alias("m"), sd.alias("s")).collect()}
    assert got["even"] == (None, None)
    assert min(got["wrap"][0], 24 - got["wrap"][0]) < 1e-9


def replay(spark, scores, threshold, **kw):
    rows = [(1, date(2025, 1, 1) + timedelta(days=i), s) for i, s in scores]
    df = spark.createDataFrame(rows, "participant_id long, day date, score double")
    return [(r["warning"], r["status"]) for r in alarm.replay(df, threshold, **kw).orderBy("day").collect()]


def test_known_alarm_traces(spark):
    assert [w for w, _ in replay(spark, enumerate([3.0, None, 3.0, 3.0]), 2.0)] == [0, None, 0, 1]
    ten = [w for w, _ in replay(spark, enumerate([3.0] * 10), 2.0)]
    assert [i for i, w in enumerate(ten) if w == 1] == [1, 8]
    assert replay(spark, enumerate([2.0, 2.0]), 2.0)[1] == (0, "monitoring")
    assert replay(spark, enumerate([3.0]), None) == [(None, "uncalibrated")]
    assert [w for w, _ in replay(spark, [(0, 3.0), (2, 3.0), (3, 3.0)], 2.0)] == [0, 0, 1]


def policy(rows, threshold, consecutive, cooldown):
    """The policy day by day."""
    out, before, alarm, run = [], None, None, 0
    for day, score in rows:
        over = score is not None and score > threshold
        run = (run + 1 if before == day - 1 else 1) if over else 0
        cool = alarm is not None and day - alarm < cooldown
        fire = score is not None and not cool and run >= consecutive
        before, alarm, run = day, day if fire else alarm, 0 if fire else run
        out.append((None, "insufficient_data") if score is None else (int(fire), "cooldown" if cool else "warning" if fire else "monitoring"))
    return out


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.one_of(st.none(), st.sampled_from([0.5, 1.0, 1.5, 2.5]))), min_size=1, max_size=40))
def test_batch_fold_equals_stepwise_policy(spark, steps):
    day, rows = -1, []
    for gap, score in steps:
        day += gap
        rows.append((day, score))
    assert replay(spark, rows, 1.0) == policy(rows, 1.0, 2, 7)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.one_of(st.none(), st.sampled_from([0.5, 1.5, 2.5]))), min_size=1, max_size=60), st.integers(1, 4), st.integers(0, 9), st.integers(1, 60))
def test_streamed_days_equal_stepwise_policy(steps, consecutive, cooldown, cut):
    rows, day = [], 0
    for gap, score in steps:
        day += gap
        rows.append((day, score))
    got, state = [], (None, None, 0)
    for part in (rows[:cut], rows[cut:]):
        if part:
            warning, status, state = replay_days(np.array([d for d, _ in part]), np.array([np.nan if s is None else s for _, s in part]), 1.0, consecutive, cooldown, state)
            got += list(zip(warning, status))
    assert got == policy(rows, 1.0, consecutive, cooldown)


def test_stream_carries_state_and_rejects_replays(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "participant_id long, day date, score double"
    days = [date(2025, 1, 1) + timedelta(days=i) for i in range(3)]
    q = None
    for batch in ([(1, days[0], 3.0)], [(1, days[1], 3.0)], [(1, days[1], 9.0), (1, days[2], 3.0)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = alarm_stream(spark.readStream.schema(schema).parquet(str(src)), 2.0).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "chk")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r["day"], r["status"]) for r in spark.read.parquet(str(out)).collect())
    assert got == [(days[0], "monitoring"), (days[1], "rejected_replay"), (days[1], "warning"), (days[2], "cooldown")]
