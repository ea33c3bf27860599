from datetime import date, datetime, timedelta

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from chronowarn.functions.ordering import linear_quantiles, previous_row, running_totals, weighted_quantile
from chronowarn.operators import measures, windows


def test_sleep_across_a_clock_change(spark):
    df = spark.createDataFrame([(1, "Europe/London", datetime(2025, 3, 29, 23), datetime(2025, 3, 30, 6))], "participant_id long, timezone string, start_at timestamp, end_at timestamp")
    got = {str(r["day"]): r["sleep_duration_h"] for r in measures.daily_sleep(df).collect()}
    assert got == {"2025-03-29": 4.0, "2025-03-30": 3.0}


def test_overlapping_sleep_abstains(spark):
    df = spark.createDataFrame([(1, "UTC", datetime(2025, 1, 1, 22), datetime(2025, 1, 2, 1)), (1, "UTC", datetime(2025, 1, 2, 0), datetime(2025, 1, 2, 2))], "participant_id long, timezone string, start_at timestamp, end_at timestamp")
    r = measures.daily_sleep(df).first()
    assert r["sleep_duration_h"] is None and r["reason"] == "overlapping_episodes"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 20)), min_size=1, max_size=25))
def test_union_length_brute_force(spark, pieces):
    df = spark.createDataFrame([(1, float(a), float(a + n)) for a, n in pieces], "k long, s double, e double")
    covered = len({x for a, n in pieces for x in range(a, a + n)})
    assert measures.union_length(df, ["k"], "s", "e").first()["covered"] == covered


def test_activity_profile(spark):
    hours = [float(h == 3) * 5 + h for h in range(24)]
    df = spark.createDataFrame([(1, hours)], "k long, hours array<double>")
    r = measures.activity_summary(df).first()
    ring = np.r_[hours, hours]
    ten, five = [ring[i:i + 10].mean() for i in range(24)], [ring[i:i + 5].mean() for i in range(24)]
    assert np.isclose(r["m10"], max(ten)) and np.isclose(r["l5"], min(five)) and r["activity_m10_start_h"] == int(np.argmax(ten))
    flat = measures.activity_summary(spark.createDataFrame([(1, [1.0] * 24)], "k long, hours array<double>")).first()
    assert flat["activity_m10_start_h"] is None and flat["activity_ra"] == 0.0


def test_regularity_index(spark):
    df = spark.createDataFrame([(1, i, int(i % 4 < 2)) for i in range(12)], "k long, e int, s int")
    assert measures.sleep_regularity_index(df, ["k"], "e", "s", 4).first()["sri"] == 100.0
    assert measures.sleep_regularity_index(df, ["k"], "e", "s", 2).first()["sri"] == -100.0


def test_calendar_capacity_literal(spark):
    days = [(1, date(2025, 1, 1) + timedelta(days=i)) for i in range(14)]
    r = windows.calendar_capacity(spark.createDataFrame(days, "p long, day date"), ["p"], 9).first()
    assert (r["longest_streak"], r["windows"]) == (14, 5)


def test_history_ignores_later_edits(spark):
    rows = [(1, date(2025, 1, 1) + timedelta(days=i), float(i)) for i in range(20)]
    def run(data):
        df = spark.createDataFrame(data, "participant_id long, day date, x double").withColumn("issued_at", F.col("day").cast("timestamp"))
        return [tuple(r) for r in windows.causal_history(df, ["x"], 7).orderBy("day").limit(10).collect()]
    edited = rows[:10] + [(p, d, x + 100) for p, d, x in rows[10:]]
    assert run(rows) == run(edited)


def test_smoothing_matches_direct_sum(spark):
    rows = [(1, date(2025, 1, 1), 1.0), (1, date(2025, 1, 3), None), (1, date(2025, 1, 4), 5.0)]
    df = spark.createDataFrame(rows, "participant_id long, day date, score double")
    got = [r["smoothed"] for r in windows.causal_smooth(df, 2.0).orderBy("day").collect()]
    w = 2 ** (-3 / 2)
    assert got[1] is None and np.allclose([got[0], got[2]], [1.0, (w + 5) / (w + 1)])
    assert windows.causal_smooth(df, 0).orderBy("day").collect()[2]["smoothed"] == 5.0


def test_bucketed_order_helpers_on_a_hot_group(spark):
    rng = np.random.default_rng(3)
    x = rng.permutation(500)
    df = spark.createDataFrame([("hot" if v % 10 else "cold", int(v), float(v % 7)) for v in x], "g string, o int, v double")
    got = {(r["g"], r["o"]): r["cum_v"] for r in running_totals(df, "o", ["v"], by=["g"], buckets=9).collect()}
    for g in ("hot", "cold"):
        own = [o for o in range(500) if (o % 10 != 0) == (g == "hot")]
        assert np.allclose([got[g, o] for o in own], np.cumsum([o % 7 for o in own]))
    prev = {(r["g"], r["o"]): r["prev"] for r in previous_row(df, ["g"], "o", ["o"], buckets=9).collect()}
    own = [o for o in range(500) if o % 10]
    assert prev["hot", own[0]] is None and all(prev["hot", b]["o"] == a for a, b in zip(own, own[1:]))
    q = linear_quantiles(df, "v", {"a": 0.25, "b": 0.9}, ["g"]).filter("g = 'hot'").first()
    assert np.allclose([q["a"], q["b"]], np.quantile([o % 7 for o in own], [0.25, 0.9]))


def test_weighted_quantile_left_inverse(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 0.25), (3.0, 0.25)], "x double, w double")
    assert weighted_quantile(df, "x", "w", 0.5).first()["quantile"] == 1.0
    assert weighted_quantile(df, "x", "w", 0.75).first()["quantile"] == 2.0


def _outcome_days(spark):
    """Two people over 12 days; the second lacks a day and has an incomplete profile and a missing clock."""
    rng, rows = np.random.default_rng(5), []
    for person in (1, 2):
        for i in range(12):
            if (person, i) == (2, 4):
                continue
            hours = [float(v) for v in rng.integers(0, 4, 24)]
            hours[3] = None if (person, i) == (2, 7) else hours[3]
            rows.append((person, date(2025, 1, 1) + timedelta(days=i), *map(float, rng.uniform(0, 24, 2)), None if (person, i) == (1, 9) else 22.0, hours))
    return spark.createDataFrame(rows, "participant_id long, day date, midpoint_h double, first_h double, last_h double, hours array<double>")


def test_rolling_outcomes_equal_a_loop_over_windows(spark):
    rows = {(r["participant_id"], r["day"]): r for r in _outcome_days(spark).collect()}
    for r in windows.rolling_outcomes(windows.calendar_spine(_outcome_days(spark))).collect():
        span = [rows[k] for k in ((r["participant_id"], r["day"] - timedelta(days=i)) for i in range(7)) if k in rows]
        whole = np.array([d["hours"] for d in span if None not in d["hours"]])
        mean = lambda v: np.sqrt(-2 * np.log(abs(np.exp(2j * np.pi * np.array(v) / 24).mean()))) * 24 / (2 * np.pi) if len(v) >= 6 else None
        pairs = [d for d in span if d["first_h"] is not None and d["last_h"] is not None]
        a1 = 1 - len(whole) * ((whole.mean(0) - whole.mean()) ** 2).sum() / ((whole - whole.mean()) ** 2).sum() if len(whole) >= 6 else None
        want = mean([d["midpoint_h"] for d in span]), max(mean([d["first_h"] for d in pairs]), mean([d["last_h"] for d in pairs])) if len(pairs) >= 6 else None, a1
        for got, expected in zip((r["S1"], r["E1"], r["A1"]), want):
            assert got is None and expected is None or np.isclose(got, expected, atol=1e-7)


def test_rolling_outcomes_gather_no_profiles_and_use_every_core(spark):
    out = windows.rolling_outcomes(windows.calendar_spine(_outcome_days(spark)))
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
