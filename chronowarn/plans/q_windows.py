"""Measures and window operators over the provided tables."""

from pyspark.sql import Window as W, functions as F

from chronowarn.functions import clock
from chronowarn.functions.ordering import average_ranks
from chronowarn.operators import measures, windows
from chronowarn.plans import base
from chronowarn.session import shared_table
from chronowarn.plans.registry import cte, query, rnd, sql_direction, sql_pmod, sql_rnd, sql_turn, table, with_ctes


def episodes(spark, folder):
    return base.observations(spark, folder).filter("variable = 'view'")


cte("parts", """
SELECT participant_id, d.day, greatest(start_at, lo) AS a, least(end_at, hi) AS b FROM (
 SELECT o.participant_id, o.start_at, o.end_at, g.day, ((CAST(g.day AS TIMESTAMP) + INTERVAL 4 HOUR) AT TIME ZONE o.timezone) AT TIME ZONE 'UTC' AS lo,
  ((CAST(g.day + 1 AS TIMESTAMP) + INTERVAL 4 HOUR) AT TIME ZONE o.timezone) AT TIME ZONE 'UTC' AS hi
 FROM obs_day o, (SELECT CAST(unnest(generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day) g
 WHERE o.variable = 'view' AND g.day BETWEEN o.day AND o.day + 1) d WHERE least(end_at, hi) > greatest(start_at, lo)""", "obs_day")


@query("j05_interval_day_overlap", "J5", with_ctes("parts", f"""
SELECT participant_id, day, CAST(count(*) AS BIGINT) AS pieces, {sql_rnd('sum(epoch_us(b) - epoch_us(a)) / 60e6')} AS minutes FROM parts GROUP BY ALL"""))
def _(spark, folder):
    p = measures.split_by_day(episodes(spark, folder))
    m = (F.unix_micros("part_end") - F.unix_micros("part_start")) / F.lit(6e7)
    return p.groupBy("participant_id", "day").agg(F.count(F.lit(1)).alias("pieces"), rnd(F.sum(m)).alias("minutes"))


@query("a01_daily_sleep", "A1", with_ctes("parts", f"""
SELECT participant_id, day, CAST(count(*) AS BIGINT) AS episodes, CASE WHEN NOT bool_or(o) THEN {sql_rnd('sum(epoch_us(b) - epoch_us(a)) / 3.6e9')} END AS sleep_duration_h,
 CASE WHEN bool_or(o) THEN 'overlapping_episodes' END AS reason
FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY participant_id, day ORDER BY a, b) > a, FALSE) AS o FROM parts) GROUP BY ALL"""))
def _(spark, folder):
    return measures.daily_sleep(episodes(spark, folder)).withColumn("sleep_duration_h", F.round("sleep_duration_h", 6))


@query("a14_interval_union", "A14", with_ctes("parts", f"""
SELECT participant_id, day, {sql_rnd('sum(CASE WHEN e > greatest(s, coalesce(m, s)) THEN e - greatest(s, coalesce(m, s)) ELSE 0 END)', 4)} AS covered FROM (
 SELECT *, max(e) OVER (PARTITION BY participant_id, day ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
 FROM (SELECT participant_id, day, epoch_us(a) / 1e6 AS s, epoch_us(b) / 1e6 AS e FROM parts)) GROUP BY ALL"""))
def _(spark, folder):
    p = measures.split_by_day(episodes(spark, folder)).select(
        "participant_id", "day", (F.unix_micros("part_start") / F.lit(1e6)).alias("s"), (F.unix_micros("part_end") / F.lit(1e6)).alias("e"))
    return measures.union_length(p, ["participant_id", "day"], "s", "e").withColumn("covered", F.round("covered", 4))


@query("a02_daily_eating", "A2", with_ctes("obs_day", f"""
SELECT participant_id, day, CASE WHEN bool_and(value < 300) THEN {sql_rnd("arg_min(h, start_at) FILTER (value > 10)")} END AS first_caloric_h,
 CASE WHEN bool_and(value < 300) THEN {sql_rnd("arg_max(h, start_at) FILTER (value > 10)")} END AS last_caloric_h FROM obs_day GROUP BY ALL"""))
def _(spark, folder):
    o = base.observations(spark, folder).withColumn("energy", F.when(F.col("value") > 10, F.col("value")).otherwise(0.0)).withColumn("complete", F.col("value") < 300)
    d = measures.daily_eating(o)
    return d.select("participant_id", "day", rnd("first_caloric_h").alias("first_caloric_h"), rnd("last_caloric_h").alias("last_caloric_h"))


def hourly(spark, folder):
    e = table(spark, folder, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.to_date("t").alias("day"), F.hour("t").alias("hour")).agg(
        F.sum("value").alias("total"), F.count(F.lit(1)).cast("double").alias("count"),
        F.least(F.lit(60.0), F.sum("value")).alias("wear"))


cte("hourly", """SELECT event_type, CAST(ts AS DATE) AS day, hour(ts) AS hour, sum(value) AS total, CAST(count(*) AS DOUBLE) AS count, least(60.0::DOUBLE, sum(value)) AS wear FROM events GROUP BY ALL""")
cte("grid24", """SELECT k.event_type, k.day, h.hour, coalesce(x.total, 0) AS total, coalesce(x.count, 0) AS count
FROM (SELECT DISTINCT event_type, day FROM hourly) k CROSS JOIN (SELECT unnest(range(24)) AS hour) h
LEFT JOIN hourly x ON x.event_type = k.event_type AND x.day = k.day AND x.hour = h.hour""", "hourly")


@query("a03_wear_normalised_hours", "A3", with_ctes("hourly", f"""
SELECT event_type, day, CAST(hour AS INTEGER) AS hour, CASE WHEN sum(wear) OVER (PARTITION BY event_type, day) >= 1200 AND wear >= 45 THEN {sql_rnd('count * (60.0::DOUBLE / wear)')} END AS rate FROM hourly"""))
def _(spark, folder):
    n = measures.normalise_wear(hourly(spark, folder), ["event_type", "day"])
    return n.select("event_type", "day", "hour", rnd("rate").alias("rate"))


@query("a04_daily_activity", "A4", with_ctes("grid24", f"""
, m AS (SELECT a.event_type, a.day, a.hour AS s, sum(CASE WHEN (b.hour - a.hour + 24) % 24 < 10 THEN b.total END) / 10 AS ten, sum(CASE WHEN (b.hour - a.hour + 24) % 24 < 5 THEN b.total END) / 5 AS five
 FROM grid24 a JOIN grid24 b USING (event_type, day) GROUP BY ALL),
x AS (SELECT event_type, day, max(ten) AS m10, min(five) AS l5 FROM m GROUP BY ALL)
SELECT x.event_type, x.day, {sql_rnd('m10')} AS m10, {sql_rnd('l5')} AS l5, CASE WHEN m10 + l5 > 0 THEN {sql_rnd('(m10 - l5) / (m10 + l5)')} END AS activity_ra,
 CASE WHEN m10 > l5 AND c = 1 THEN CAST(s AS DOUBLE) END AS activity_m10_start_h, {sql_rnd('t')} AS activity_total
FROM x JOIN (SELECT m.event_type, m.day, count(*) AS c, min(s) AS s FROM m JOIN x USING (event_type, day) WHERE abs(ten - m10) <= 1e-12 * abs(m10) GROUP BY ALL) USING (event_type, day)
JOIN (SELECT event_type, day, sum(total) AS t FROM grid24 GROUP BY ALL) USING (event_type, day)"""))
def _(spark, folder):
    p = measures.hour_array(hourly(spark, folder), ["event_type", "day"], "hour", "total", 0.0)
    a = measures.activity_summary(p)
    return a.select("event_type", "day", *[rnd(c).alias(c) for c in ("m10", "l5", "activity_ra", "activity_m10_start_h", "activity_total")])


@query("a11_intradaily_variability", "A11", with_ctes("grid24", f"""
SELECT event_type, day, CASE WHEN sum((total - m)**2) > 0 THEN {sql_rnd('24 * sum(d * d) / (23 * sum((total - m)**2))')} END AS iv
FROM (SELECT *, total - lag(total) OVER (PARTITION BY event_type, day ORDER BY hour) AS d, avg(total) OVER (PARTITION BY event_type, day) AS m FROM grid24) GROUP BY ALL"""))
def _(spark, folder):
    p = measures.hour_array(hourly(spark, folder), ["event_type", "day"], "hour", "total", 0.0)
    return p.select("event_type", "day", rnd(measures.intradaily_variability(F.col("hours"))).alias("iv"))


@query("a12_sleep_regularity_index", "A12", """
WITH g AS (SELECT u.user_id, t.e, CASE WHEN x.e IS NULL THEN 0 ELSE 1 END AS s FROM (SELECT DISTINCT user_id FROM events) u
 CROSS JOIN (SELECT unnest(range(mn, mx + 1)) AS e FROM (SELECT min(epoch_us(ts) // 3600000000) AS mn, max(epoch_us(ts) // 3600000000) AS mx FROM events)) t
 LEFT JOIN (SELECT DISTINCT user_id, epoch_us(ts) // 3600000000 AS e FROM events) x ON x.user_id = u.user_id AND x.e = t.e)
SELECT user_id, round(avg(CASE WHEN p IS NOT NULL THEN CASE WHEN p = s THEN 1.0::DOUBLE ELSE 0 END END) * 200 - 100, 6) + 0.0 AS sri, CAST(count(*) AS BIGINT) AS epochs
FROM (SELECT *, lag(s, 24) OVER (PARTITION BY user_id ORDER BY e) AS p FROM g) GROUP BY 1""")
def _(spark, folder):
    e = table(spark, folder, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("e"))
    active = e.distinct().withColumn("on", F.lit(1))
    span = e.agg(F.sequence(F.min("e"), F.max("e")).alias("s")).scalar()
    grid = active.select("user_id").distinct().select("user_id", F.explode(span).alias("e"))
    states = grid.join(active, ["user_id", "e"], "left").select("user_id", "e", F.coalesce("on", F.lit(0)).alias("s"))
    return measures.sleep_regularity_index(states, ["user_id"], "e", "s", 24).withColumn("sri", F.round("sri", 6))


@query("a13_prior_day_exercise", "A13 J7", with_ctes("obs_day", f"""
SELECT participant_id, day + 1 AS day, {sql_rnd('sum(value)')} AS minutes, CASE WHEN sqrt(sum(value*cos(a))**2 + sum(value*sin(a))**2) > 1e-9 THEN {sql_rnd(sql_pmod('atan2(sum(value*sin(a)), sum(value*cos(a)))*24/(2*pi())', 24))} END AS clock_h
FROM (SELECT *, (h + value / 120) * 2 * pi() / 24 AS a FROM obs_day WHERE variable = 'click') GROUP BY ALL"""))
def _(spark, folder):
    o = base.observations(spark, folder).filter("variable = 'click'")
    o = o.withColumn("day", F.date_add(clock.research_day("start_at", "timezone"), 1)).withColumn("mid", clock.clock_hour("start_at", "timezone") + F.col("value") / 120)
    w = measures.weighted_clock(o, ["participant_id", "day"], "mid", "value")
    return w.select("participant_id", "day", rnd("minutes").alias("minutes"), rnd("clock_h").alias("clock_h"))


@query("a15_main_episode", "A15", with_ctes("obs_day", """
SELECT participant_id, day, observation_id, value FROM (SELECT *, row_number() OVER (PARTITION BY participant_id, day ORDER BY value DESC, observation_id) AS rn FROM obs_day) WHERE rn = 1"""))
def _(spark, folder):
    o = base.observations(spark, folder).withColumn("day", clock.research_day("start_at", "timezone")).select("participant_id", "day", "observation_id", "value")
    return measures.main_episode(o, ["participant_id", "day"], "value", "observation_id")


@query("a16_agreed_value", "A16", """
SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS agreed, count(DISTINCT o_orderstatus) > 1 AS conflict FROM orders GROUP BY ALL""")
def _(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    return measures.agreed_value(o, ["o_custkey", "day"], "o_orderstatus")


@query("a17_sd_of_hourly_means", "A17", f"""
SELECT event_type, day, {sql_rnd('stddev_samp(m)')} AS hourly_sd FROM (SELECT event_type, CAST(ts AS DATE) AS day, hour(ts) AS h, avg(value) AS m FROM events GROUP BY ALL) GROUP BY ALL HAVING count(*) >= 8""")
def _(spark, folder):
    e = table(spark, folder, "events").withColumn("t", F.col("ts").cast("timestamp"))
    m = e.groupBy("event_type", F.to_date("t").alias("day"), F.hour("t").alias("h")).agg(F.avg("value").alias("m"))
    return m.groupBy("event_type", "day").agg(F.count("m").alias("k"), rnd(F.stddev_samp("m")).alias("hourly_sd")).filter("k >= 8").drop("k")


@query("a05_daily_physiology", "A5", with_ctes("obs", f"""
SELECT participant_id, {sql_rnd("median(x) FILTER (r)")} AS resting_hr_bpm, {sql_rnd('avg(x)')} AS heart_rate_bpm, {sql_rnd('stddev_samp(x)')} AS hr_sd_bpm
FROM (SELECT participant_id, variable = 'view' AS r, CASE WHEN value BETWEEN 20 AND 250 THEN value END AS x FROM obs) GROUP BY 1"""))
def _(spark, folder):
    o = base.observations(spark, folder).withColumn("resting", F.col("variable") == "view")
    p = measures.physiology(o, ["participant_id"])
    return p.select("participant_id", *[rnd(c).alias(c) for c in ("resting_hr_bpm", "heart_rate_bpm", "hr_sd_bpm")])


@query("a54_circular_spread", "A54", with_ctes("obs_day", f"""
SELECT participant_id, CASE WHEN r >= 1e-12 THEN {sql_rnd('sqrt(greatest(0::DOUBLE, -2*ln(least(1.0::DOUBLE, r))))*24/(2*pi())')} END AS spread_h
FROM (SELECT participant_id, sqrt(avg(cos(h*2*pi()/24))**2 + avg(sin(h*2*pi()/24))**2) AS r FROM obs_day GROUP BY 1)"""))
def _(spark, folder):
    o = base.observations(spark, folder).withColumn("h", clock.clock_hour("start_at", "timezone"))
    return o.groupBy("participant_id").agg(rnd(clock.circular_summary("h")[1]).alias("spread_h"))


# ---- windows -------------------------------------------------------------------------

def daily_profiles(spark, folder):
    """Daily panel plus a 24-slot profile of event counts on each active day."""
    return base.person_days(spark, folder).dropna(subset=["participant_id", "day"]).withColumnRenamed("mean_h", "midpoint_h")


def outcomes(spark, folder):
    """Rolling outcomes with the last arrival of each window (``known``) and the person's first day (``baseline_start``).

    One move by person serves the spine and all windows.
    """
    def build():
        spine = windows.calendar_spine(windows.spread_people(daily_profiles(spark, folder)))
        rolled = windows.rolling_outcomes(spine.select("participant_id", "day", "midpoint_h", "first_h", "last_h", "hours", "arrived"))
        return rolled.select("participant_id", "day", "S1", "E1", "A1", F.max("arrived").over(windows.trailing(["participant_id"], "day", 7)).alias("known"),
                             F.min("day").over(W.partitionBy("participant_id")).alias("baseline_start"))
    return shared_table(spark, folder, "outcomes", build)


cte("spine", """SELECT participant_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT participant_id, min(day) AS a, max(day) AS b FROM daily GROUP BY 1)""", "daily")
cte("hourcounts", """SELECT participant_id, day, hour(local_at) AS hr, CAST(count(*) AS DOUBLE) AS x FROM obs_day GROUP BY ALL""", "obs_day")


def _csd(c, s, n):
    r = f"sqrt(({c})**2 + ({s})**2) / ({n})"
    return f"CASE WHEN {n} >= 6 AND {r} > 1e-12 THEN sqrt(-2*ln(least(1.0::DOUBLE, {r})))*24/(2*pi()) END"


def _cs(x):
    return f"sum(cos({x}*2*pi()/24))", f"sum(sin({x}*2*pi()/24))", f"count({x})"


cte("outcomes", f"""
SELECT s.participant_id, s.day, c.S1, CASE WHEN c.f IS NOT NULL AND c.l IS NOT NULL THEN greatest(c.f, c.l) END AS E1, a.A1
FROM spine s
JOIN (SELECT s.participant_id, s.day, {_csd(*_cs('mean_h'))} AS S1, {_csd(*_cs('first_h'))} AS f, {_csd(*_cs('last_h'))} AS l
      FROM spine s LEFT JOIN daily d ON d.participant_id = s.participant_id AND d.day BETWEEN s.day - 6 AND s.day GROUP BY ALL) c
  ON c.participant_id = s.participant_id AND c.day = s.day
LEFT JOIN (SELECT participant_id, day, CASE WHEN q - t*t/(24*n) > 0 AND n >= 6 THEN 1 - least(1.0::DOUBLE, greatest(0.0::DOUBLE, n * (sum_m2 - 24*(t/(24*n))**2) / (q - t*t/(24*n)))) END AS A1
  FROM (SELECT participant_id, day, any_value(n) AS n, sum(hs) AS t, sum(hq) AS q, sum((hs/n)**2) AS sum_m2
    FROM (SELECT s.participant_id, s.day, h.hr, sum(h.x) AS hs, sum(h.x*h.x) AS hq, any_value(k.n) AS n
      FROM spine s JOIN hourcounts h ON h.participant_id = s.participant_id AND h.day BETWEEN s.day - 6 AND s.day
      JOIN (SELECT s.participant_id, s.day, count(*) AS n FROM spine s JOIN daily d ON d.participant_id = s.participant_id AND d.day BETWEEN s.day - 6 AND s.day GROUP BY ALL) k
        ON k.participant_id = s.participant_id AND k.day = s.day GROUP BY ALL) GROUP BY ALL)) a
  ON a.participant_id = s.participant_id AND a.day = s.day""", "spine hourcounts daily")


@query("w01_rolling_outcomes", "W1 A8 A9 A10", with_ctes("outcomes", f"""
SELECT participant_id, day, {sql_rnd('S1')} AS S1, {sql_rnd('E1')} AS E1, {sql_rnd('A1', 9)} AS A1 FROM outcomes"""))
def _(spark, folder):
    return outcomes(spark, folder).select("participant_id", "day", rnd("S1").alias("S1"), rnd("E1").alias("E1"), rnd("A1", 9).alias("A1"))


@query("w02_window_coverage", "W2 R3", with_ctes("daily spine obs_day", """
, av AS (SELECT participant_id, day, max(available_at) AS av FROM obs_day GROUP BY ALL),
s AS (SELECT s.*, ((CAST(s.day + 1 AS TIMESTAMP) + INTERVAL 12 HOUR) AT TIME ZONE z.timezone) AT TIME ZONE 'UTC' AS as_of FROM spine s JOIN (SELECT DISTINCT participant_id, timezone FROM daily) z USING (participant_id)),
w AS (SELECT s.participant_id, s.day, o.o, s.day - o.o AS hd, coalesce(av.av <= s.as_of, FALSE) AS ok FROM s CROSS JOIN (SELECT CAST(unnest(range(14)) AS INTEGER) AS o) o LEFT JOIN av ON av.participant_id = s.participant_id AND av.day = s.day - o.o),
r AS (SELECT *, o - row_number() OVER (PARTITION BY participant_id, day, ok ORDER BY o) AS g FROM w),
l AS (SELECT participant_id, day, max(k) AS longest FROM (SELECT participant_id, day, g, count(*) AS k FROM r WHERE NOT ok GROUP BY ALL) GROUP BY ALL)
SELECT w.participant_id, w.day, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS INTEGER) AS complete_days, CAST(coalesce(any_value(l.longest), 0) AS INTEGER) AS longest_missing_run,
 CASE WHEN NOT bool_or(ok AND o = 0) THEN 'missing_target_day' WHEN sum(CASE WHEN ok THEN 1 ELSE 0 END) < 11 THEN 'insufficient_complete_days' WHEN coalesce(any_value(l.longest), 0) > 2 THEN 'missing_run_too_long' END AS reason
FROM w LEFT JOIN l ON l.participant_id = w.participant_id AND l.day = w.day GROUP BY w.participant_id, w.day"""))
def _(spark, folder):
    o = base.observations(spark, folder)
    arrived = o.groupBy("participant_id", clock.research_day("start_at", "timezone").alias("day")).agg(
        F.max("available_at").alias("available_at"), F.lit(True).alias("complete"))
    zones = o.select("participant_id", "timezone").distinct()
    spine = windows.calendar_spine(arrived).join(zones, "participant_id")
    spine = spine.withColumn("as_of", clock.local_boundary(F.date_add("day", 1), "timezone", clock.ISSUE_HOUR))
    w = windows.select_window(spine, days=14, minimum=11, max_missing_run=2)
    return w.select("participant_id", "day", "complete_days", "longest_missing_run", "reason")


@query("w03_causal_history", "W3", with_ctes("daily", f"""
SELECT participant_id, day, {sql_rnd('n_events')} AS n_events, {sql_rnd('avg(n_events) OVER f')} AS mean_n_events, {sql_rnd('stddev_samp(n_events) OVER f')} AS sd_n_events,
 CASE WHEN lag(day) OVER p = day - 1 THEN {sql_rnd('n_events - lag(n_events) OVER p')} END AS change_n_events,
 {sql_rnd('avg(value_mean) OVER f')} AS mean_value_mean, {sql_rnd('stddev_samp(value_mean) OVER f')} AS sd_value_mean
FROM daily WINDOW p AS (PARTITION BY participant_id ORDER BY day), f AS (PARTITION BY participant_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)"""))
def _(spark, folder):
    d = base.daily(spark, folder).withColumn("issued_at", F.date_add("day", 1).cast("timestamp"))
    h = windows.causal_history(d, ["n_events", "value_mean"], 7)
    cols = ("n_events", "mean_n_events", "sd_n_events", "change_n_events", "mean_value_mean", "sd_value_mean")
    return h.select("participant_id", "day", *[rnd(c).alias(c) for c in cols])


@query("w04_causal_smoothing", "W4", with_ctes("daily", f"""
, s AS (SELECT participant_id, day, CASE WHEN n_events > 1 THEN value_mean END AS score FROM daily)
SELECT a.participant_id, a.day, {sql_rnd('a.score')} AS score, CASE WHEN a.score IS NOT NULL THEN {sql_rnd('sum(b.score * 2.0::DOUBLE ** (-(a.day - b.day) / 3.0::DOUBLE)) / sum(CASE WHEN b.score IS NOT NULL THEN 2.0::DOUBLE ** (-(a.day - b.day) / 3.0::DOUBLE) END)')} END AS smoothed
FROM s a JOIN s b ON b.participant_id = a.participant_id AND b.day <= a.day GROUP BY a.participant_id, a.day, a.score"""))
def _(spark, folder):
    d = base.daily(spark, folder).select("participant_id", "day", F.when(F.col("n_events") > 1, F.col("value_mean")).alias("score"))
    s = windows.causal_smooth(d, 3.0)
    return s.select("participant_id", "day", rnd("score").alias("score"), rnd("smoothed").alias("smoothed"))


@query("w05_previous_day_change", "W5", with_ctes("zlong", f"""
SELECT a.participant_id, a.day, CASE WHEN count(a.z - b.z) = {len(base.FEATURES)} THEN {sql_rnd('avg(abs(a.z - b.z))')} END AS previous_day_change FROM zlong a LEFT JOIN zlong b ON b.participant_id = a.participant_id AND b.j = a.j AND b.day = a.day - 1 GROUP BY ALL"""))
def _(spark, folder):
    return windows.previous_day_change(base.scaled(spark, folder)).select("participant_id", "day", rnd("previous_day_change").alias("previous_day_change"))


@query("w06_trailing_trends", "W6", with_ctes("daily", "SELECT participant_id, day, " + ", ".join(
    f"{sql_rnd(f'avg(value_sum) OVER w{w}', 7)} AS mean{w}_value_sum, {sql_rnd(f'stddev_samp(value_sum) OVER w{w}', 7)} AS sd{w}_value_sum, CASE WHEN count(*) OVER w{w} > 1 THEN {sql_rnd(f'regr_slope(value_sum, i) OVER w{w}', 7)} END AS slope{w}_value_sum" for w in (7, 14, 28)) +
    " FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY day) AS i FROM daily) WINDOW " + ", ".join(
    f"w{w} AS (PARTITION BY participant_id ORDER BY i ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in (7, 14, 28))))
def _(spark, folder):
    t = windows.trailing_trends(base.daily(spark, folder), ["value_sum"], (7, 14, 28))
    return t.select("participant_id", "day", *[rnd(f"{k}{w}_value_sum", 7).alias(f"{k}{w}_value_sum") for w in (7, 14, 28) for k in ("mean", "sd", "slope")])


CAPACITY_SQL = """
WITH c AS (SELECT {key} AS person, {day} AS day, count(*) AS n FROM {src} GROUP BY ALL), s AS (SELECT person, day, day - CAST(row_number() OVER (PARTITION BY person ORDER BY day) AS INTEGER) AS g FROM c WHERE n = 1),
r AS (SELECT person, g, count(*) AS len FROM s GROUP BY ALL)
SELECT c.person, CAST(count(*) AS BIGINT) AS unique_days, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_days,
 CAST(coalesce((SELECT max(len) FROM r WHERE r.person = c.person), 0) AS BIGINT) AS longest_streak, CAST(coalesce((SELECT sum(greatest(0, len - {cut})) FROM r WHERE r.person = c.person), 0) AS BIGINT) AS windows
FROM c GROUP BY c.person"""


@query("w07_calendar_capacity", "W7", CAPACITY_SQL.format(key="o_custkey", day="CAST(o_orderdate AS DATE)", src="orders", cut="1"))
def _(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("person"), F.to_date("o_orderdate").alias("day"))
    return windows.calendar_capacity(o, ["person"], 1)


@query("w08_history_future_windows", "W8", CAPACITY_SQL.format(key="user_id", day="CAST(ts AS DATE)", src="(SELECT DISTINCT user_id, CAST(ts AS DATE) AS ts FROM events)", cut="(4 + 3)"))
def _(spark, folder):
    e = table(spark, folder, "events").select(F.col("user_id").alias("person"), F.to_date("ts").alias("day")).distinct()
    return windows.calendar_capacity(e, ["person"], 3, 4)


@query("w09_average_ranks", "W9", f"""
SELECT l_quantity AS value, CAST(count(*) AS BIGINT) AS n, {sql_rnd('any_value(r)')} AS avg_rank, CAST(any_value(t) AS BIGINT) AS total_n FROM (SELECT l_quantity, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS r, count(*) OVER () AS t FROM lineitem) GROUP BY 1""")
def _(spark, folder):
    l = table(spark, folder, "lineitem").select(F.col("l_quantity").alias("value"))
    return average_ranks(l, "value").select("value", "n", rnd("avg_rank").alias("avg_rank"), "total_n")


@query("w10_forecast_prefix", "W10", with_ctes("daily", """
SELECT participant_id, day, CAST(rn AS INTEGER) AS rn, n >= 7 AS enough FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY day) AS rn, count(*) OVER (PARTITION BY participant_id) AS n FROM daily) WHERE rn <= 7"""))
def _(spark, folder):
    return windows.first_n(base.daily(spark, folder), 7).select("participant_id", "day", "rn", "enough")


@query("w11_occasion_number", "W11", """
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS occasion FROM conversations""")
def _(spark, folder):
    c = table(spark, folder, "conversations").select("conv_id", "turn")
    return windows.occasion_numbers(c, "conv_id", "turn")


PB = ("n_events", "value_mean", "mean_h")
cte("pb", f"""
SELECT participant_id, day, f, x, di, c, CASE WHEN f = 'mean_h' THEN {sql_turn('x - c + 12', 24)} - 12 ELSE x - c END AS u FROM (
 SELECT *, CASE WHEN f = 'mean_h' THEN {sql_direction('co', 'si')} ELSE m END AS c FROM (
  SELECT *, avg(x) FILTER (di < 14) OVER w AS m, avg(cos(x*2*pi()/24)) FILTER (di < 14) OVER w AS co, avg(sin(x*2*pi()/24)) FILTER (di < 14) OVER w AS si
  FROM (SELECT participant_id, day, f, x, di FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY day) - 1 AS di FROM daily) UNPIVOT INCLUDE NULLS (x FOR f IN (n_events, value_mean, mean_h)))
  WINDOW w AS (PARTITION BY participant_id, f)))""", "daily")
cte("pbz", "SELECT participant_id, day, f, di, CASE WHEN s > 1e-8 THEN u / s END AS z FROM (SELECT *, stddev_samp(CASE WHEN di < 14 THEN u END) OVER (PARTITION BY participant_id, f) AS s FROM pb)", "pb")


@query("w12_personal_baseline", "W12", with_ctes("pbz", "SELECT participant_id, day, CAST(any_value(di) AS INTEGER) AS day_index, " + ", ".join(
    f"max(CASE WHEN f = '{f}' THEN {sql_rnd('z')} END) AS z_{f}" for f in PB) + " FROM pbz GROUP BY ALL"))
def _(spark, folder):
    z = windows.personal_baseline(base.daily(spark, folder), PB, ("mean_h",), 14)
    return z.select("participant_id", "day", "day_index", *[rnd(F.col("z")[i]).alias(f"z_{f}") for i, f in enumerate(PB)])


@query("w15_persistence_runs", "W15", with_ctes("dayscore", """
, q AS (SELECT *, coalesce(score > 0.8, FALSE) AS hit FROM dayscore), g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY participant_id, hit ORDER BY day) AS INTEGER) AS grp FROM q)
SELECT participant_id, day, hit AS qualifies, CASE WHEN hit THEN min(day) OVER w END AS run_start, CASE WHEN hit THEN CAST(count(*) OVER w AS BIGINT) END AS run_length,
 CASE WHEN hit THEN CAST(day - min(day) OVER w + 1 AS INTEGER) END AS run_position, hit AND count(*) OVER w >= 3 AS confirmed
FROM g WINDOW w AS (PARTITION BY participant_id, hit, grp)"""))
def _(spark, folder):
    r = windows.qualifying_runs(base.scaled(spark, folder), F.col("score") > 0.8, 3)
    return r.select("participant_id", "day", "qualifies", "run_start", "run_length", "run_position", "confirmed")


@query("w16_relative_days", "W16", """
SELECT user_id, event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS day_index, bad_step FROM (
 SELECT user_id, event_id, CASE WHEN p <> w THEN 1 ELSE 0 END AS c, coalesce(p <> w AND w <> (p + 1) % 7, FALSE) AS bad_step FROM (
  SELECT user_id, event_id, isodow(ts) - 1 AS w, lag(isodow(ts) - 1) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events))""")
def _(spark, folder):
    e = table(spark, folder, "events").select("user_id", "event_id", F.weekday("ts").alias("w"))
    return windows.relative_days(e, "user_id", "event_id", "w").select("user_id", "event_id", "day_index", "bad_step")


@query("w18_level_and_trend", "W18", with_ctes("spine daily", f"""
SELECT participant_id, day, {sql_rnd('last_value(n_events IGNORE NULLS) OVER f')} AS level_n_events, {sql_rnd('avg(abs(n_events)) OVER f')} AS deviation_n_events,
 CASE WHEN count(n_events) OVER f > 1 THEN {sql_rnd('regr_slope(n_events, t) OVER f')} END AS trend_n_events FROM (SELECT s.participant_id, s.day, d.n_events, CAST(s.day - DATE '1970-01-01' AS DOUBLE) AS t FROM spine s LEFT JOIN daily d USING (participant_id, day))
WINDOW f AS (PARTITION BY participant_id ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"""))
def _(spark, folder):
    s = windows.level_and_trend(windows.calendar_spine(base.daily(spark, folder)), ["n_events"], 14)
    return s.select("participant_id", "day", *[rnd(f"{k}_n_events").alias(f"{k}_n_events") for k in ("level", "deviation", "trend")])
