"""Streamed windows equal the batch windows, whatever the batches, with late and repeated rows."""

import random
import uuid
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
from pyspark.sql import functions as F

from chronowarn.functions import clock
from chronowarn.operators import network, windows
from chronowarn.streaming.windows import WindowRule, module_scores, window_reason, window_stream

RULES = (WindowRule(7, 6, 2), WindowRule(28, 23, 2))
MODULES = {"a": (0, 1), "b": (1, 2)}
SCHEMA = "participant_id long, day date, vec array<double>, available_at timestamp, timezone string"


def closing(day, zone):
    return datetime(day.year, day.month, day.day, 12, tzinfo=ZoneInfo(zone)) + timedelta(days=1)


def make_rows():
    rng, out = random.Random(4), []
    for person in range(6):
        zone = ("UTC", "America/New_York", "Asia/Shanghai")[person % 3]
        for k in range(60):
            if rng.random() < 0.12 and k not in (0, 59):
                continue
            day = date(2026, 2, 20) + timedelta(days=k)
            vec = [rng.gauss(0, 1) for _ in range(4)]
            if rng.random() < 0.05:
                vec[2] = None
            late = rng.choice([-5, -3, -1, -1, -1, 2, 30]) if k < 58 else -1
            out.append((person, day, vec, (closing(day, zone) + timedelta(hours=late)).astimezone(timezone.utc).replace(tzinfo=None), zone))
    return out


def run(spark, tmp_path, batches):
    folder = tmp_path / uuid.uuid4().hex
    folder.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in" / f"b={i:03d}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder / "in"))
    out = window_stream(source, RULES, MODULES, minimum=5)
    q = out.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "chk")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(str(folder / "out"))


def batch_windows(spark, rows):
    """The same days by the batch operators, with scores over vectors known at each closing hour."""
    d = spark.createDataFrame(rows, SCHEMA).withColumn("complete", F.lit(True))
    zones = d.select("participant_id", "timezone").distinct()
    spine = windows.calendar_spine(d.drop("timezone")).join(zones, "participant_id")
    spine = spine.withColumn("as_of", clock.local_boundary(F.date_add("day", 1), "timezone", clock.ISSUE_HOUR))
    out = {}
    for rule in RULES:
        w = windows.select_window(spine, days=rule.days, minimum=rule.minimum, max_missing_run=rule.max_missing_run)
        for r in w.select("participant_id", "day", "complete_days", "longest_missing_run", "reason").collect():
            out[r[0], r[1], rule.days] = tuple(r)[2:]
    return out


def test_stream_equals_batch_in_any_batches(spark, tmp_path):
    rows = make_rows()
    want = batch_windows(spark, rows)
    arrived = sorted(rows, key=lambda r: r[3])
    many = [arrived[i : i + 40] for i in range(0, len(arrived), 40)]
    many[3] = many[3] + many[2][:7]                                # repeated rows
    end = [(99, date(2026, 6, 1), [0.0] * 4, datetime(2026, 6, 3), "UTC")]     # moves the watermark past every day
    got = {}
    for name, batches in (("one", [arrived, end]), ("many", [*many, end])):
        found = run(spark, tmp_path, batches).where("participant_id < 99").collect()
        refused = [r for r in found if r["window_days"] is None]
        assert {r["reason"] for r in refused} == ({"rejected_replay"} if name == "many" else set())
        got[name] = {(r["participant_id"], r["day"], r["window_days"]): r for r in found if r["window_days"] is not None}
        assert len(got[name]) == len(found) - len(refused)
        assert {k: (r["complete_days"], r["longest_missing_run"], r["reason"]) for k, r in got[name].items()} == want
    assert all(got["one"][k]["scores"] == got["many"][k]["scores"] for k in want)
    assert {r["reason"] for r in got["one"].values()} == {None, "missing_target_day", "insufficient_complete_days", "missing_run_too_long"}
    assert sum(v is not None for r in got["one"].values() for v in r["scores"].values()) > 100


def test_rows_out_of_reach_are_refused(spark, tmp_path):
    zone, start = "UTC", date(2026, 1, 1)
    row = lambda k, lag=0: (1, start + timedelta(days=k), [1.0, 2.0, 3.0, 4.0], datetime(2026, 1, 1) + timedelta(days=k + 1 + lag), zone)
    late = [(1, start + timedelta(days=2), [9.0] * 4, datetime(2026, 3, 20), zone), (1, start + timedelta(days=65), [9.0] * 4, datetime(2026, 3, 20), zone)]
    batches = [[row(k) for k in range(1, 70) if k not in (2, 65)], [(2, date(2026, 3, 14), [0.0] * 4, datetime(2026, 3, 15), zone)], late, [(2, date(2026, 3, 30), [0.0] * 4, datetime(2026, 4, 2), zone)]]
    found = run(spark, tmp_path, batches).where("participant_id = 1").collect()
    assert [(r["day"], r["reason"]) for r in found if r["window_days"] is None] == [(date(2026, 1, 3), "rejected_late")]


def test_pieces_equal_batch_scores(spark):
    rng = np.random.default_rng(1)
    for n in (3, 9, 14):
        rows = rng.normal(size=(n, 4))
        rows[:, 3] = rows[:, 0] if n == 14 else rows[:, 3]
        df = spark.createDataFrame([(r.tolist(),) for r in rows], "vec array<double>")
        want = {m["module"]: m["score"] for m in network.window_scores(df, 4, MODULES, minimum=5).first()["modules"]}
        got = module_scores(rows, MODULES, 5)
        assert all((got[k] is None) == (want[k] is None) and (got[k] is None or abs(got[k] - want[k]) < 1e-9) for k in MODULES)
    assert window_reason(np.array([False, True, True]), WindowRule(3, 2, 1)) == (2, 1, None)
    assert window_reason(np.array([True, True, False]), WindowRule(3, 2, 1)) == (2, 1, "missing_target_day")


def test_a_person_has_one_timer_at_a_time():
    """Rows set a timer for the earliest open day only; closing sets the next one."""
    from types import SimpleNamespace
    import pandas as pd
    from chronowarn.streaming.windows import WindowProcessor
    box, timers = {}, []
    state = SimpleNamespace(exists=lambda: "v" in box, get=lambda: box["v"], update=lambda v: box.update(v=v))
    p = WindowProcessor(RULES, MODULES, 5)
    p.init(SimpleNamespace(getValueState=lambda *_: state, registerTimer=timers.append))
    days = [date(2026, 1, 1) + timedelta(days=k) for k in range(40)]
    rows = pd.DataFrame({"day": pd.to_datetime(pd.Series(days)), "at": [0] * 40, "vec": [np.array([k, k * k % 7, -k, 1.0 + k % 3]) for k in range(40)], "timezone": "UTC"})
    assert list(p.handleInputRows((1,), iter([rows.iloc[5:]]), None)) == [] and len(timers) == 1
    assert list(p.handleInputRows((1,), iter([rows.iloc[:5]]), None)) == [] and len(timers) == 2 and timers[1] < timers[0]
    middle = int(datetime(2026, 1, 21, tzinfo=timezone.utc).timestamp() * 1000)
    clock_ = lambda now: SimpleNamespace(getCurrentWatermarkInMs=lambda: now)
    first = list(p.handleExpiredTimer((1,), clock_(middle), None))[0]
    assert len(timers) == 3 and timers[2] > middle and first["day"].nunique() == 19
    assert list(p.handleExpiredTimer((1,), clock_(middle), None)) == []
    second = list(p.handleExpiredTimer((1,), clock_(10**14), None))[0]
    assert sorted({*first["day"], *second["day"]}) == days and len(first) + len(second) == 80
