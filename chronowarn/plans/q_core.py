"""Time columns, daily panel, frozen scaling, deviation scores and daily warnings."""

from pyspark.sql import functions as F

from chronowarn.functions import clock
from chronowarn.operators import alarm, panel, splits
from chronowarn.plans import base
from chronowarn.plans.registry import query, rnd, sql_rnd, sql_turn, table, with_ctes

LINE_CLOCK = "l.l_shipdate + to_minutes(CAST((l_orderkey * 37 + l_linenumber * 11) % 1440 AS BIGINT))"


def _line_local(spark, folder):
    """``lineitem`` ship dates with a wall-clock minute, in four zones over seven years."""
    l = table(spark, folder, "lineitem")
    minute = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 1440
    at = F.timestamp_micros(F.unix_micros(F.col("l_shipdate").cast("timestamp")) + minute * 60_000_000)
    return l.select("l_orderkey", "l_linenumber", at.alias("moment"), base.zone_of(F.col("l_suppkey")).alias("timezone"))


LINE_SQL = f"""SELECT l_orderkey, l_linenumber, {LINE_CLOCK} AS moment,
 CASE l_suppkey % 4 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Europe/London' WHEN 2 THEN 'Asia/Shanghai' ELSE 'America/New_York' END AS timezone FROM lineitem l"""


@query("p01_parse_instant", "P1 V29", """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_valid, CAST(sum(CASE WHEN ok THEN epoch_us(u) % 1000003 ELSE 0 END) AS BIGINT) AS checksum
FROM (SELECT event_id % 3 <> 2 AS ok, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) ELSE date_trunc('second', ts) - INTERVAL 8 HOUR END AS u FROM events)""")
def _(spark, folder):
    e = table(spark, folder, "events")
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    suffix = F.element_at(F.array(F.lit("Z"), F.lit("+08:00"), F.lit("")), (F.col("event_id") % 3 + 1).cast("int"))
    parsed = e.select(clock.parse_instant(F.concat(text, suffix)).alias("u"))
    return parsed.agg(F.count(F.lit(1)).alias("n"), F.count("u").alias("n_valid"),
                      F.sum(F.coalesce(F.unix_micros("u") % 1000003, F.lit(0))).alias("checksum"))


@query("p02_local_boundary", "P2", f"""
SELECT timezone, CAST(moment AS DATE) AS day, CAST(epoch_us((CAST(CAST(moment AS DATE) AS TIMESTAMP) + INTERVAL 4 HOUR) AT TIME ZONE timezone) AS BIGINT) AS boundary_us, CAST(count(*) AS BIGINT) AS n
FROM ({LINE_SQL}) GROUP BY ALL""")
def _(spark, folder):
    rows = _line_local(spark, folder).groupBy("timezone", F.to_date("moment").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("boundary_us", F.unix_micros(clock.local_boundary("day", "timezone")))


@query("p03_research_day", "P3 R2", with_ctes("obs_day", """
SELECT timezone, day, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT participant_id) AS BIGINT) AS people FROM obs_day GROUP BY ALL"""))
def _(spark, folder):
    o = base.observations(spark, folder).withColumn("day", clock.research_day("start_at", "timezone"))
    per_person = o.groupBy("timezone", "day", "participant_id").agg(F.count(F.lit(1)).alias("k"))
    return per_person.groupBy("timezone", "day").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("people"))


@query("p03_research_day_clock_changes", "P3", f"""
SELECT timezone, day, CAST(count(*) AS BIGINT) AS n FROM (SELECT timezone, CAST(loc AS DATE) - CASE WHEN hour(loc) < 4 THEN 1 ELSE 0 END AS day
 FROM (SELECT timezone, (moment AT TIME ZONE 'UTC') AT TIME ZONE timezone AS loc FROM ({LINE_SQL}))) GROUP BY ALL""")
def _(spark, folder):
    rows = _line_local(spark, folder)
    return rows.groupBy("timezone", clock.research_day("moment", "timezone").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("p01_nonexistent_local_times", "P1 P2", f"""
SELECT l_orderkey, l_linenumber, timezone FROM ({LINE_SQL})
WHERE ((moment AT TIME ZONE timezone) AT TIME ZONE timezone) <> moment
UNION ALL SELECT -1, 0, 'checked'""")
def _(spark, folder):
    rows = _line_local(spark, folder)
    bad = rows.filter(clock.is_nonexistent("moment", "timezone")).select("l_orderkey", "l_linenumber", "timezone")
    marker = spark.range(1).select(F.lit(-1).cast("long").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit("checked").alias("timezone"))
    return bad.unionByName(marker)


@query("p04_forecast_bounds", "P4", with_ctes("daily", """
SELECT timezone, day + 1 AS issue_day, day AS completed_day, CAST(epoch_us((CAST(day + 1 AS TIMESTAMP) + INTERVAL 4 HOUR) AT TIME ZONE timezone) AS BIGINT) AS cutoff_us, TRUE AS on_schedule, CAST(count(*) AS BIGINT) AS n
FROM daily GROUP BY ALL"""))
def _(spark, folder):
    d = base.daily(spark, folder).withColumn("issue_day", F.date_add("day", 1))
    issued = clock.local_boundary("issue_day", "timezone", clock.ISSUE_HOUR)
    b = d.withColumn("b", clock.forecast_bounds(issued, "timezone"))
    return b.groupBy("timezone", "issue_day", F.col("b.day").alias("completed_day"), F.unix_micros("b.cutoff").alias("cutoff_us"),
                     F.col("b.on_schedule").alias("on_schedule")).agg(F.count(F.lit(1)).alias("n"))


@query("p05_clock_delta", "P5", with_ctes("daily", f"""
SELECT participant_id, day, {sql_rnd(sql_turn('last_h - first_h + 12', 24) + ' - 12')} AS delta FROM daily"""))
def _(spark, folder):
    return base.daily(spark, folder).select("participant_id", "day", rnd(clock.clock_delta("last_h", "first_h")).alias("delta"))


@query("p06_circular_minutes", "P6", """
SELECT l_orderkey, CAST(max(abs(((a - b + 720) % 1440 + 1440) % 1440 - 720)) AS DOUBLE) AS widest FROM
 (SELECT l_orderkey, (l_partkey * 7) % 1440 AS a, (l_suppkey * 13) % 1440 AS b FROM lineitem) GROUP BY 1""")
def _(spark, folder):
    l = table(spark, folder, "lineitem")
    a = ((F.col("l_partkey") * 7) % 1440).cast("double")
    b = ((F.col("l_suppkey") * 13) % 1440).cast("double")
    return l.select("l_orderkey", clock.circular_distance(a, b).alias("d")).groupBy("l_orderkey").agg(F.max("d").alias("widest"))


@query("p07_clock_hour", "P7", with_ctes("obs_day", f"""
SELECT timezone, variable, {sql_rnd('sum(h)', 4)} AS hours, {sql_rnd('max(h)')} AS latest FROM obs_day GROUP BY ALL"""))
def _(spark, folder):
    o = base.observations(spark, folder).withColumn("h", clock.clock_hour("start_at", "timezone"))
    return o.groupBy("timezone", "variable").agg(rnd(F.sum("h"), 4).alias("hours"), rnd(F.max("h")).alias("latest"))


@query("v06_available_as_of", "V6 R1", with_ctes("obs_day", """
SELECT participant_id, day, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN start_at < cutoff AND end_at <= cutoff AND available_at <= issued THEN 1 ELSE 0 END) AS BIGINT) AS n_available
FROM (SELECT o.*, ((CAST(day + 1 AS TIMESTAMP) + INTERVAL 4 HOUR) AT TIME ZONE timezone) AT TIME ZONE 'UTC' AS cutoff,
  ((CAST(day + 1 AS TIMESTAMP) + INTERVAL 12 HOUR) AT TIME ZONE timezone) AT TIME ZONE 'UTC' AS issued FROM obs_day o) GROUP BY ALL"""))
def _(spark, folder):
    o = base.observations(spark, folder).withColumn("day", clock.research_day("start_at", "timezone"))
    nxt = F.date_add("day", 1)
    o = o.withColumn("cutoff", clock.local_boundary(nxt, "timezone")).withColumn("issued", clock.local_boundary(nxt, "timezone", 12))
    ok = clock.available_as_of("start_at", "end_at", "available_at", "cutoff", "issued")
    return o.groupBy("participant_id", "day").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_available"))


@query("a06_daily_panel", "A6", with_ctes("daily", "SELECT participant_id, timezone, day, " + ", ".join(
    f"{sql_rnd(f)} AS {f}" for f in base.FEATURES) + " FROM daily"))
def _(spark, folder):
    d = panel.daily_panel(base.observations(spark, folder))
    return d.select("participant_id", "timezone", "day", *[rnd(f).alias(f) for f in base.FEATURES])


@query("a07_circular_summary", "A7", with_ctes("obs_day", f"""
SELECT participant_id, variable, CASE WHEN r > 1e-12 AND n >= 3 THEN {sql_rnd(sql_turn('m'))} END AS circ_mean,
  CASE WHEN r > 1e-12 AND n >= 3 THEN {sql_rnd('sqrt(-2*ln(least(1.0::DOUBLE, r)))*24/(2*pi())')} END AS circ_sd
FROM (SELECT participant_id, variable, count(*) AS n, sqrt(avg(cos(h*2*pi()/24))**2 + avg(sin(h*2*pi()/24))**2) AS r,
  atan2(avg(sin(h*2*pi()/24)), avg(cos(h*2*pi()/24)))*24/(2*pi()) AS m FROM obs_day GROUP BY ALL)"""))
def _(spark, folder):
    o = base.observations(spark, folder).withColumn("h", clock.clock_hour("start_at", "timezone"))
    mean, sd = clock.circular_summary("h", minimum=3)
    return o.groupBy("participant_id", "variable").agg(rnd(mean).alias("circ_mean"), rnd(sd).alias("circ_sd"))


@query("t06_people_roles", "T6", with_ctes("roles", "SELECT * FROM roles"))
def _(spark, folder):
    people = table(spark, folder, "events").select(F.col("user_id").alias("participant_id"))
    return splits.split_people(people, "participant_id", base.SEED)


@query("a21_reference_freeze", "A21", with_ctes("refdays", "SELECT participant_id, day, " + ", ".join(
    f"{sql_rnd(f)} AS {f}" for f in base.FEATURES) + " FROM refdays"))
def _(spark, folder):
    r = base.reference(spark, folder)
    return r.select("participant_id", "day", *[rnd(f).alias(f) for f in base.FEATURES])


@query("a22_scaler_fit", "A22", with_ctes("scaler", f"""
SELECT feature, {sql_rnd('center')} AS center, {sql_rnd('mean')} AS mean, {sql_rnd('scale')} AS scale, CAST(n AS BIGINT) AS n FROM scaler"""))
def _(spark, folder):
    s = panel.fit_scaler(base.reference(spark, folder), base.FEATURES, base.CLOCKS)
    names = F.array(*[F.lit(f) for f in base.FEATURES])
    z = s.select("n", F.explode(F.arrays_zip(names.alias("feature"), "center", "mean", "scale")).alias("z"))
    return z.select("z.feature", rnd("z.center").alias("center"), rnd("z.mean").alias("mean"), rnd("z.scale").alias("scale"), "n")


@query("p16_frozen_scaling", "P16 J13", with_ctes("zlong", "SELECT participant_id, day, " + ", ".join(
    f"max(CASE WHEN j = {i} THEN {sql_rnd('z')} END) AS z_{f}" for i, f in enumerate(base.FEATURES)) + " FROM zlong GROUP BY ALL"))
def _(spark, folder):
    z = base.scaled(spark, folder)
    return z.select("participant_id", "day", *[rnd(F.col("vec")[i]).alias(f"z_{f}") for i, f in enumerate(base.FEATURES)])


@query("p17_mean_abs_deviation", "P17", with_ctes("dayscore", f"SELECT participant_id, day, {sql_rnd('score')} AS score FROM dayscore"))
def _(spark, folder):
    return base.scaled(spark, folder).select("participant_id", "day", rnd("score").alias("score"))


@query("l02_daily_warnings", "L1 L2", with_ctes("dayscore", f"""
SELECT participant_id, day, {sql_rnd('score')} AS score, warning, status FROM walk WHERE i > 0""",
    local=base.alarm_sql("dayscore", f"{base.THRESHOLD}::DOUBLE")))
def _(spark, folder):
    out = alarm.replay(base.scaled(spark, folder), base.THRESHOLD)
    return out.withColumn("score", F.round("score", 6))
