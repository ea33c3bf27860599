"""How the provided tables play the roles of the data model, in Spark and in SQL."""

from pyspark.sql import DataFrame, functions as F

from chronowarn.functions import clock
from chronowarn.operators import panel, splits
from chronowarn.plans.registry import cte, sql_direction, sql_turn, table
from chronowarn.session import built_table, shared_table

SEED = 20261001
FEATURES = ("n_events", "value_sum", "value_mean", "value_max", "first_h", "last_h", "mean_h")
CLOCKS = ("first_h", "last_h", "mean_h")
ZONES = ("UTC", "Europe/London", "Asia/Shanghai", "America/New_York")


def zone_of(person):
    return F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.pmod(person, F.lit(4)) + 1).cast("int"))


def observations(spark, folder) -> DataFrame:
    """``events`` as timed measurements: value minutes long, arriving k minutes after the end."""
    e = table(spark, folder, "events")
    start = F.col("ts").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(start) + F.round(F.col("value") * F.lit(6e7)).cast("long"))
    lag = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("observation_id"), F.col("user_id").alias("participant_id"),
        F.col("event_type").alias("variable"), "value", start.alias("start_at"), end.alias("end_at"),
        F.timestamp_micros(F.unix_micros(end) + lag * 60_000_000).alias("available_at"),
        zone_of(F.col("user_id")).alias("timezone"))


cte("obs", """
SELECT event_id AS observation_id, user_id AS participant_id, event_type AS variable, value, ts AS start_at,
  ts + to_microseconds(CAST(round(value * 6e7) AS BIGINT)) AS end_at,
  ts + to_microseconds(CAST(round(value * 6e7) AS BIGINT)) + to_minutes(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS available_at,
  CASE user_id % 4 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Europe/London' WHEN 2 THEN 'Asia/Shanghai' ELSE 'America/New_York' END AS timezone
FROM events""")
cte("obs_local", """
SELECT *, (start_at AT TIME ZONE 'UTC') AT TIME ZONE timezone AS local_at FROM obs""", "obs")
cte("obs_day", """
SELECT *, CAST(local_at AS DATE) - CASE WHEN hour(local_at) < 4 THEN 1 ELSE 0 END AS day,
  hour(local_at) + minute(local_at) / 60.0::DOUBLE + floor(second(local_at)) / 3600.0::DOUBLE AS h
FROM obs_local""", "obs_local")


def person_days(spark, folder) -> DataFrame:
    """Days, profiles and arrivals in one pass over the events, for queries that need more than ``daily``."""
    return shared_table(spark, folder, "person_days", lambda: panel.person_days(observations(spark, folder)))


def daily(spark, folder) -> DataFrame:
    """The daily panel, read off ``person_days`` where a query has built that."""
    built = built_table(spark, folder, "person_days")
    if built is not None:
        return built.drop("hours", "arrived")
    return shared_table(spark, folder, "daily", lambda: panel.daily_panel(observations(spark, folder)))


cte("daily", f"""
SELECT participant_id, timezone, day, CAST(count(*) AS DOUBLE) AS n_events, sum(value) AS value_sum, avg(value) AS value_mean,
  max(value) AS value_max, arg_min(h, start_at) AS first_h, arg_max(h, start_at) AS last_h,
  CASE WHEN sqrt(avg(cos(h*2*pi()/24))**2 + avg(sin(h*2*pi()/24))**2) > 1e-12
       THEN {sql_turn("atan2(sum(sin(h*2*pi()/24)), sum(cos(h*2*pi()/24))) * 24 / (2*pi())")} END AS mean_h
FROM obs_day GROUP BY ALL""", "obs_day")


def roles(spark, folder) -> DataFrame:
    people = table(spark, folder, "events").select(F.col("user_id").alias("participant_id"))
    return shared_table(spark, folder, "roles", lambda: splits.split_people(people, "participant_id", SEED))


cte("roles", f"""
SELECT participant_id, CASE WHEN r <= floor(0.25*n) THEN 'reference' WHEN r <= floor(0.6*n) THEN 'development'
  WHEN r <= floor(0.8*n) THEN 'calibration' ELSE 'test' END AS role
FROM (SELECT participant_id, row_number() OVER (ORDER BY md5('{SEED}|' || participant_id), participant_id) AS r,
      count(*) OVER () AS n FROM (SELECT DISTINCT user_id AS participant_id FROM events))""")


def reference(spark, folder) -> DataFrame:
    pool = daily(spark, folder).join(roles(spark, folder).filter("role = 'reference'"), "participant_id", "left_semi")
    return panel.freeze_reference(pool, SEED)


cte("refdays", f"""
SELECT * EXCLUDE (rn) FROM (SELECT d.*, row_number() OVER (PARTITION BY participant_id
   ORDER BY md5('{SEED}|' || participant_id || '|' || CAST(day AS VARCHAR)), day) AS rn
 FROM daily d WHERE participant_id IN (SELECT participant_id FROM roles WHERE role = 'reference')) WHERE rn = 1""", "daily roles")


def _long(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT participant_id, day, {i} AS j, '{f}' AS feature, {'TRUE' if f in CLOCKS else 'FALSE'} AS is_clock, {f} AS x FROM {source}"
        for i, f in enumerate(FEATURES))


cte("reflong", _long("refdays"), "refdays")
cte("scaler", f"""
SELECT j, feature, any_value(is_clock) AS is_clock, any_value(c) AS center, avg(u) AS mean, CASE WHEN count(*) >= 9 AND stddev_samp(u) > 1e-12 THEN stddev_samp(u) END AS scale, count(*) AS n
FROM (SELECT l.*, c, CASE WHEN l.is_clock THEN {sql_turn("x - c + 12", 24)} - 12 ELSE x END AS u
      FROM reflong l JOIN (SELECT j AS cj, CASE WHEN any_value(is_clock) THEN {sql_direction("avg(cos(x*2*pi()/24))", "avg(sin(x*2*pi()/24))")} ELSE 0 END AS c
                           FROM reflong GROUP BY j) ON cj = l.j)
GROUP BY j, feature""", "reflong")
cte("daylong", _long("daily"), "daily")
cte("zlong", f"""
SELECT participant_id, day, l.j, ((CASE WHEN l.is_clock THEN {sql_turn("x - center + 12", 24)} - 12 ELSE x END) - mean) / scale AS z
FROM daylong l JOIN scaler s ON s.j = l.j""", "daylong scaler")


def frozen_scaler(spark, folder) -> panel.FrozenScaler:
    return panel.freeze_scaler(reference(spark, folder), FEATURES, CLOCKS)


def scaled(spark, folder) -> DataFrame:
    """Every person-day with its standardised vector ``vec`` and mean absolute deviation ``score``."""
    def build():
        out = daily(spark, folder).withColumn("vec", frozen_scaler(spark, folder).vector())
        return out.withColumn("score", panel.mean_abs_deviation(F.col("vec")))
    return shared_table(spark, folder, "scaled", build)


# a vector with a missing feature is not scored and takes no part in a reference
cte("zwhole", f"SELECT * FROM zlong QUALIFY count(z) OVER (PARTITION BY participant_id, day) = {len(FEATURES)}", "zlong")
cte("dayscore", f"SELECT participant_id, day, CASE WHEN count(z) = {len(FEATURES)} THEN avg(abs(z)) END AS score FROM zlong GROUP BY ALL", "zlong")
THRESHOLD = 1.2


def alarm_sql(scores: str, threshold: str, keys: str = "participant_id", consecutive: int = 2, cooldown: int = 7) -> str:
    """Alarm policy as a recursive walk over (keys, day, score), producing relation ``walk``."""
    k = [c.strip() for c in keys.split(",")]
    match = " AND ".join(f"n.{c} IS NOT DISTINCT FROM w.{c}" for c in k)
    pk = ", ".join(f"n.{c}" for c in k)
    run = f"""CASE WHEN n.score > {threshold} THEN (CASE WHEN w.day = n.day - 1 THEN w.run ELSE 0 END) + 1 ELSE 0 END"""
    return f"""
seqd AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY day) AS i FROM {scores}),
walk AS (
  SELECT {', '.join('n.' + c for c in k)}, CAST(0 AS BIGINT) AS i, DATE '1900-01-01' AS day, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS DATE) AS last_alarm, 0 AS run, CAST(NULL AS INTEGER) AS warning, '' AS status
  FROM (SELECT DISTINCT {keys} FROM {scores}) n
  UNION ALL
  SELECT {pk}, i, day, score, CASE WHEN fires THEN day ELSE last_alarm END, CASE WHEN fires THEN 0 ELSE run END,
    CASE WHEN score IS NULL OR lim IS NULL THEN NULL WHEN fires THEN 1 ELSE 0 END,
    CASE WHEN score IS NULL THEN 'insufficient_data' WHEN lim IS NULL THEN 'uncalibrated' WHEN cooling THEN 'cooldown' WHEN fires THEN 'warning' ELSE 'monitoring' END
  FROM (SELECT *, score IS NOT NULL AND lim IS NOT NULL AND NOT cooling AND run >= {consecutive} AS fires FROM (
    SELECT {pk}, n.i, n.day, n.score, w.last_alarm, {run} AS run, {threshold} AS lim,
      coalesce(n.day - w.last_alarm < {cooldown}, FALSE) AS cooling
    FROM walk w JOIN seqd n ON {match} AND n.i = w.i + 1)) n)"""
