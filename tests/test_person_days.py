"""Days, profiles and arrivals in one pass; spines and coverage with one move (F34)."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronowarn.operators import endpoints, panel, windows
from chronowarn.plans import base, load_plans, q_endpoints, q_windows
from chronowarn.session import forget_shared_tables

FOLDER = "/root/testdata/sf0.001"


def _count(df, node: str) -> int:
    """Nodes of that name in the plan of a frame that has not run yet."""
    return df._jdf.queryExecution().executedPlan().toString().count(node)


def _observations(spark):
    """Two zones, a repeated hour at a clock change, a missing value, arrival, start and person."""
    rng, rows = np.random.default_rng(7), []
    for person, zone in ((1, "UTC"), (2, "Europe/London")):
        for i in range(60):
            start = datetime(2025, 10, 25) + timedelta(minutes=int(rng.integers(0, 4320)))
            rows.append((person, zone, start, None if i % 9 == 0 else float(rng.uniform(1, 9)), None if i % 7 == 0 else start + timedelta(hours=2)))
    rows += [(2, "Europe/London", datetime(2025, 10, 26, h, 30), 1.0, None) for h in (0, 1, 1)]
    rows += [(1, "UTC", None, 2.0, None), (None, None, datetime(2025, 10, 26), 3.0, None), (3, "UTC", datetime(2025, 10, 27, 9), None, None)]
    return spark.createDataFrame(rows, "participant_id long, timezone string, start_at timestamp, value double, available_at timestamp")


def test_person_days_equal_the_daily_panel_and_counts_by_hour(spark):
    o = _observations(spark)
    key = lambda r: (r["participant_id"], r["timezone"], r["day"])
    got, want = ({key(r): r for r in df.collect()} for df in (panel.person_days(o), panel.daily_panel(o)))
    assert got.keys() == want.keys() and len(got) > 6
    for k, w in want.items():
        for c in w.asDict():
            assert got[k][c] == (pytest.approx(w[c], abs=1e-12) if isinstance(w[c], float) else w[c]), (k, c)
    local = o.withColumn("l", F.from_utc_timestamp("start_at", F.col("timezone"))).select("*", F.hour("l").alias("hour"), F.to_date(F.col("l") - F.expr("INTERVAL 4 HOURS")).alias("day")).collect()
    for k, g in got.items():
        mine = [r for r in local if key(r) == k]
        assert g["hours"] == [float(sum(r["hour"] == h for r in mine)) for h in range(24)]
        assert g["arrived"] == max((r["available_at"] for r in mine if r["available_at"]), default=None)


def test_spine_fills_gaps_and_reads_its_rows_once(spark):
    d = lambda i: date(2025, 1, 1) + timedelta(days=i)
    rows = [(1, d(0), 1.0), (1, d(1), 2.0), (1, d(5), None), (2, d(3), 4.0), (2, None, 5.0), (None, d(0), 6.0), (None, d(2), 7.0)]
    df = spark.createDataFrame(rows, "participant_id long, day date, x double")
    spine = windows.calendar_spine(df)
    assert spine.columns == ["participant_id", "day", "x"]
    assert _count(spine, "Exchange ") == 1 and _count(spine, "Join") == 0
    got = sorted((-1 if r["participant_id"] is None else r["participant_id"], r["day"], -1 if r["x"] is None else r["x"]) for r in spine.collect())
    assert got == [(-1, d(0), -1), (-1, d(1), -1), (-1, d(2), -1), (1, d(0), 1.0), (1, d(1), 2.0), (1, d(2), -1), (1, d(3), -1), (1, d(4), -1), (1, d(5), -1), (2, d(3), 4.0)]


def test_labels_need_every_required_day_observed(spark):
    noon = lambda i: datetime(2025, 1, 1, 12) + timedelta(days=i)
    holes = {1: set(), 2: {9}, 3: {0, 1, 2}, 4: {18, 19}}
    observed = spark.createDataFrame([(p, date(2025, 1, 1) + timedelta(days=i)) for p, gone in holes.items() for i in range(20) if i not in gone] + [(1, date(2025, 1, 3)), (None, date(2025, 1, 1))],
                                     "participant_id long, day date")
    forecasts = spark.createDataFrame([(p, "UTC", noon(i), noon(40), noon(40)) for p in (*holes, 5) for i in range(16)],
                                      "participant_id long, timezone string, issued_at timestamp, followup_end timestamp, known_until timestamp")
    events = spark.createDataFrame([], "participant_id long, onset timestamp, confirmed_at timestamp")
    out = endpoints.future_labels(forecasts, events, observed)
    assert _count(out, "Join") <= 2
    got = {(r["participant_id"], (r["issued_at"] - noon(0)).days): r["reason"] for r in out.collect()}
    assert len(got) == 80
    for (p, i), reason in got.items():
        need = range(i, i + 9)    # the day of issue to the last whole day of the horizon and its confirmation
        covered = p in holes and not any(j in holes[p] or j >= 20 for j in need)
        assert reason == ("complete_event_free_followup" if covered else "outcome_coverage_gap"), (p, i)


def test_labels_build_the_days_in_one_pass(spark):
    load_plans()
    forget_shared_tables()
    from chronowarn import session
    q_endpoints.labels(spark, FOLDER).count()
    built = {key[3] for key in session._WRITTEN}
    assert "person_days" in built and "daily" not in built
    whole, alone = base.daily(spark, FOLDER), panel.daily_panel(base.observations(spark, FOLDER))
    assert whole.columns == alone.columns and whole.count() == alone.count()
    assert _count(q_endpoints.outcomes_as_of(spark, FOLDER), "Exchange") == 0
    assert _count(q_windows.outcomes(spark, FOLDER), "Scan") == 1
    forget_shared_tables()
