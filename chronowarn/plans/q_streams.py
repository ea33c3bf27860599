"""Streaming queries driven to completion over the provided events; results equal the batch plans."""

import uuid

from pyspark.sql import functions as F

from chronowarn.functions import clock, textkeys
from chronowarn.plans import base
from chronowarn.plans.q_network import MODULES, module_sql
from chronowarn.plans.registry import query, rnd, sql_rnd, table, with_ctes
from chronowarn.session import checkpoint_root
from chronowarn.streaming import alarms
from chronowarn.streaming.windows import WindowRule, window_stream


def _drain(stream, folder_name, mode="append"):
    """Run a stream over everything available into a Parquet folder and read it back."""
    spark = stream.sparkSession
    root = f"{checkpoint_root(spark)}/{folder_name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/chk").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _stream_of(df, name):
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query("r04_alarm_stream", "R4 R3 L1", with_ctes("dayscore", f"""
SELECT participant_id, day, {sql_rnd('score')} AS score, warning, status FROM walk WHERE i > 0""", local=base.alarm_sql("dayscore", f"{base.THRESHOLD}::DOUBLE")))
def _(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s = base.scaled(spark, folder).select("participant_id", "day", "score")
    return _drain(alarms.alarm_stream(_stream_of(s, "scores"), base.THRESHOLD), "alarms").withColumn("score", F.round("score", 6))


RULES = (WindowRule(7, 6, 2), WindowRule(28, 23, 2))
LEAST = 5  # complete vectors that a score needs
STREAMED = f""", av AS (SELECT participant_id, day, any_value(timezone) AS timezone, max(available_at) AS av FROM obs_day GROUP BY ALL),
rules(n, least, run) AS (VALUES {", ".join(str(tuple(r)) for r in RULES)}),
z AS (SELECT DISTINCT participant_id, timezone FROM av),
s AS (SELECT s.participant_id, s.day, ((CAST(s.day + 1 AS TIMESTAMP) + INTERVAL 12 HOUR) AT TIME ZONE z.timezone) AT TIME ZONE 'UTC' AS as_of FROM spine s JOIN z USING (participant_id)),
done AS (SELECT participant_id, max(day) AS last FROM s JOIN av USING (participant_id, day) WHERE as_of < (SELECT max(av) - INTERVAL 1 HOUR FROM av) GROUP BY ALL),
t AS MATERIALIZED (SELECT s.* FROM s JOIN done USING (participant_id) WHERE day <= last),
w AS MATERIALIZED (SELECT t.participant_id, t.day, n, o.o, t.day - o.o AS d, coalesce(av.av <= t.as_of, FALSE) AS ok FROM t CROSS JOIN rules JOIN (SELECT CAST(unnest(range(28)) AS INTEGER) AS o) o ON o.o < n
  LEFT JOIN av ON av.participant_id = t.participant_id AND av.day = t.day - o.o),
r AS (SELECT *, o - row_number() OVER (PARTITION BY participant_id, day, n, ok ORDER BY o) AS g FROM w),
l AS (SELECT participant_id, day, n, max(k) AS longest FROM (SELECT participant_id, day, n, g, count(*) AS k FROM r WHERE NOT ok GROUP BY ALL) GROUP BY ALL),
c AS (SELECT participant_id, day, n, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS INTEGER) AS complete_days, bool_or(ok AND o = 0) AS here FROM w GROUP BY ALL),
zw AS MATERIALIZED (SELECT w.participant_id, w.day, w.n, w.d, z.j, z.z FROM w JOIN zwhole z ON z.participant_id = w.participant_id AND z.day = w.d WHERE w.ok),
pr AS MATERIALIZED (SELECT participant_id, day, n, a.j AS i, b.j AS j, covar_samp(a.z, b.z) / (stddev_samp(a.z) * stddev_samp(b.z)) AS r FROM zw a JOIN zw b USING (participant_id, day, n, d) WHERE a.j < b.j GROUP BY ALL HAVING count(*) >= {LEAST}),
sds AS MATERIALIZED (SELECT participant_id, day, n, j, stddev_samp(z) AS a FROM zw GROUP BY ALL),
{module_sql("pr", "sds", "r", ("participant_id", "day", "n"))},
sc AS (SELECT participant_id, day, n, {", ".join(f"{sql_rnd(f"max(CASE WHEN module = '{m}' THEN score END)", 4)} AS {m}" for m in MODULES)} FROM ms
  SEMI JOIN (SELECT participant_id, day, n FROM sds GROUP BY ALL HAVING min(a) > 1e-12) varied USING (participant_id, day, n) GROUP BY ALL)
SELECT c.participant_id, c.day, CAST(c.n AS INTEGER) AS window_days, complete_days, CAST(coalesce(longest, 0) AS INTEGER) AS longest_missing_run,
 CASE WHEN NOT here THEN 'missing_target_day' WHEN complete_days < least THEN 'insufficient_complete_days' WHEN coalesce(longest, 0) > run THEN 'missing_run_too_long' END AS reason, {", ".join(MODULES)}
FROM c JOIN rules USING (n) LEFT JOIN l ON l.participant_id = c.participant_id AND l.day = c.day AND l.n = c.n LEFT JOIN sc ON sc.participant_id = c.participant_id AND sc.day = c.day AND sc.n = c.n"""


@query("r03_window_stream", "R3 W2 D3", with_ctes("spine obs_day zwhole", STREAMED))
def _(spark, folder):
    """7- and 28-day windows of every person and day that the stream's watermark has closed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    arrived = base.observations(spark, folder).groupBy("participant_id", clock.research_day("start_at", "timezone").alias("day")).agg(
        F.max("available_at").alias("available_at"), F.max("timezone").alias("timezone"))
    vectors = arrived.join(base.scaled(spark, folder).select("participant_id", "day", "vec"), ["participant_id", "day"], "left")
    out = _drain(window_stream(_stream_of(vectors, "vectors"), RULES, MODULES, minimum=LEAST), "windows")
    return out.select("participant_id", "day", "window_days", "complete_days", "longest_missing_run", "reason", *[rnd(F.col("scores")[m], 4).alias(m) for m in MODULES])


@query("r02_research_day_stream", "R2 R1", with_ctes("obs_day", """
, d AS (SELECT participant_id, day, value, ((CAST(day AS TIMESTAMP) + INTERVAL 4 HOUR) AT TIME ZONE timezone) AT TIME ZONE 'UTC' AS opened FROM obs_day)
SELECT participant_id, day, CAST(count(*) AS BIGINT) AS n_events, round(sum(value), 4) AS value_sum FROM d WHERE date_trunc('hour', opened) + INTERVAL 1 HOUR <= (SELECT max(opened) FROM d) - INTERVAL 48 HOUR GROUP BY ALL"""))
def _(spark, folder):
    """Days the watermark has closed, per person."""
    o = base.observations(spark, folder).select("participant_id", "timezone", "start_at", "value")
    out = _drain(alarms.daily_counts(_stream_of(o, "observations")), "days")
    return out.select("participant_id", "day", "n_events", rnd("value_sum", 4).alias("value_sum"))


@query("r02_fixed_zone_windows", "R2", """
SELECT variable, day, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM (SELECT event_type AS variable, CAST(ts - INTERVAL 4 HOUR AS DATE) AS day, value FROM events)
WHERE CAST(day AS TIMESTAMP) + INTERVAL 28 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY variable, day""")
def _(spark, folder):
    o = base.observations(spark, folder).select("variable", "start_at", "value")
    return _drain(alarms.fixed_zone_days(_stream_of(o, "fixed")), "windows").withColumn("total", F.round("total", 4))


@query("r05_issue_once", "R5 S8", "SELECT CAST(count(DISTINCT user_id || '|' || CAST(CAST(ts AS DATE) AS VARCHAR)) AS BIGINT) AS issued FROM events")
def _(spark, folder):
    f = table(spark, folder, "events").select(F.col("user_id").alias("participant_id"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("issued_at"))
    root = f"{checkpoint_root(spark)}/issue-{uuid.uuid4().hex}"
    alarms.issue_once(_stream_of(f, "forecasts"), f"{root}/out", f"{root}/chk").awaitTermination()
    return spark.read.parquet(f"{root}/out").agg(F.count(F.lit(1)).alias("issued"))


@query("r06_resume_tasks", "R6 U2", "SELECT CAST(count(*) AS BIGINT) AS scored, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT sha256(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g')) AS k, min(length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g'))) AS n FROM documents GROUP BY 1)")
def _(spark, folder):
    d = table(spark, folder, "documents").select(textkeys.content_key("text").alias("task_id"), F.length(F.regexp_replace("text", r"\s+", "")).alias("n"))
    root = f"{checkpoint_root(spark)}/tasks-{uuid.uuid4().hex}"
    for turn in range(2):  # the second pass finds everything stored
        alarms.resume_tasks(_stream_of(d, f"tasks{turn}"), f"{root}/out", lambda b: b, f"{root}/chk{turn}").awaitTermination()
    return spark.read.parquet(f"{root}/out").agg(F.count(F.lit(1)).alias("scored"), F.sum("n").alias("chars"))
