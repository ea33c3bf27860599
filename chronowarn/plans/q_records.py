"""Sources, stores, validation rules, joins and set operations over the provided tables."""

import uuid

from pyspark.sql import Window as W, functions as F, types as T

from chronowarn.functions.stats import with_row
from chronowarn.functions import clock, textkeys
from chronowarn.operators import inventory, measures, validate, wards, windows
from chronowarn.plans import base
from chronowarn.plans.registry import cte, query, rnd, sql_pmod, sql_rnd, table, with_ctes
from chronowarn.session import checkpoint_root
from chronowarn.sources import adapters, store, tabular

DIGEST = "CAST(count(*) AS BIGINT) AS rows, CAST(sum(('0x' || substring(md5({t}), 1, 8))::UBIGINT) AS BIGINT) AS digest_a, CAST(sum(('0x' || substring(md5({t}), 9, 8))::UBIGINT) AS BIGINT) AS digest_b"


def _scratch(spark, label):
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


@query("s01_json_lines_round_trip", "S1 S2", f"SELECT {DIGEST.format(t=chr(39) + chr(39) + ' || o_orderkey || ' + chr(39) + '|' + chr(39) + ' || o_custkey || ' + chr(39) + '|' + chr(39) + ' || o_orderstatus || ' + chr(39) + '|' + chr(39) + ' || o_orderpriority')}, round(sum(o_totalprice), 2) AS total FROM orders")
def _(spark, folder):
    o = table(spark, folder, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    path = _scratch(spark, "orders") + ".jsonl"
    tabular.export_view(o, path)
    back = tabular.read_table(spark, path, o.schema)
    d = store.digest(back, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    return d.transform(with_row, back.agg(F.round(F.sum("o_totalprice"), 2).alias("total")))


@query("s01_csv_round_trip", "S1 S2", "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1")
def _(spark, folder):
    l = table(spark, folder, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    path = _scratch(spark, "lineitem") + ".csv"
    tabular.export_view(l, path, "csv")
    back = tabular.read_table(spark, path, l.schema)
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("s03_column_mapped_ingest", "S3 S4", with_ctes("obs", f"SELECT variable, CAST(count(*) AS BIGINT) AS n, {sql_rnd('sum(value)', 4)} AS total, CAST(sum(epoch_us(available_at) // 1000000 % 1000003) AS BIGINT) AS arrival_checksum FROM obs GROUP BY 1"))
def _(spark, folder):
    o = base.observations(spark, folder).withColumn("unit", F.lit("minute")).withColumn("kind", F.lit("observed"))
    m = {"participant_id": "participant_id", "variable": "variable", "value": "value", "unit": "unit", "start_at": "start_at", "end_at": "end_at", "available_at": "available_at", "kind": "provenance_kind"}
    rows = tabular.map_columns(o, m, "UTC", "events")
    return rows.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("value_num"), 4).alias("total"), F.sum(F.unix_seconds("available_at") % 1000003).alias("arrival_checksum"))


@query("s05_append_only_store", "S5 S6 S8 S9 R5", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def _(spark, folder):
    e = table(spark, folder, "events")
    path = _scratch(spark, "store")
    store.append(e.filter("event_type IN ('view', 'click')"), path, ["event_id"])
    store.append(e.filter("event_type NOT IN ('view', 'click')"), path, ["event_id"])
    store.append_new(e, path, ["event_id"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("s07_features_as_of", "S7 R1", with_ctes("obs_day", f"""
, f AS (SELECT participant_id, day, variable, sum(value) AS v, max(available_at) AS av, CAST(((CAST(day + 1 AS TIMESTAMP) + INTERVAL 4 HOUR) AT TIME ZONE timezone) AT TIME ZONE 'UTC' AS TIMESTAMP) AS as_of FROM obs_day GROUP BY participant_id, day, variable, timezone)
SELECT participant_id, day, string_agg(variable, ',' ORDER BY variable) AS names, {sql_rnd('sum(v)', 4)} AS total FROM f WHERE av <= as_of GROUP BY ALL"""))
def _(spark, folder):
    o = base.observations(spark, folder).withColumn("day", clock.research_day("start_at", "timezone"))
    f = o.groupBy("participant_id", "day", "timezone", F.col("variable").alias("name")).agg(F.sum("value").alias("value"), F.max("available_at").alias("available_at"))
    f = f.withColumn("as_of", clock.local_boundary(F.date_add("day", 1), "timezone"))
    a = store.features_as_of(f)
    return a.select("participant_id", "day", F.concat_ws(",", F.col("features.name")).alias("names"), rnd(F.aggregate("features.value", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query("a47_content_digest", "A47", f"SELECT {DIGEST.format(t='c_custkey || chr(124) || c_name || chr(124) || c_mktsegment')} FROM customer")
def _(spark, folder):
    return store.digest(table(spark, folder, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


@query("s10_snapshot_join", "S10 J1", """
SELECT n_name, o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def _(spark, folder):
    o, c, n = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("j02_optional_annotations", "J2 S24", "SELECT lang, quality, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unannotated FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL")
def _(spark, folder):
    d = table(spark, folder, "documents").join(table(spark, folder, "labels").withColumn("has", F.lit(True)), "doc_id", "left")
    return d.groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("has").isNull()).alias("unannotated"))


@query("j04_latest_survey", "J4 S13", with_ctes("obs", """
SELECT a.observation_id AS anchor_id, CAST(epoch_us(max(s.start_at)) AS BIGINT) AS survey_us, arg_max(s.value, s.start_at) AS survey_value FROM obs a LEFT JOIN obs s ON s.participant_id = a.participant_id AND s.variable = 'purchase' AND s.start_at <= a.start_at AND s.start_at >= a.start_at - INTERVAL 24 HOUR WHERE a.variable = 'view' GROUP BY 1"""))
def _(spark, folder):
    o = base.observations(spark, folder)
    a = o.filter("variable = 'view'").select("participant_id", F.col("observation_id").alias("anchor_id"), F.col("start_at").alias("anchor_at"))
    s = o.filter("variable = 'purchase'").select("participant_id", F.col("start_at").alias("at"), "value")
    return adapters.latest_before(a, s).select("anchor_id", F.unix_micros("survey_at").alias("survey_us"), "survey_value")


@query("j06_naps_before_wake", "J6 S17", with_ctes("obs", f"""
SELECT a.observation_id AS night_id, {sql_rnd("coalesce(sum((epoch_us(n.end_at) - epoch_us(n.start_at)) / 6e7), 0)", 4)} AS nap_minutes, CAST(count(n.observation_id) AS BIGINT) AS naps FROM obs a LEFT JOIN obs n ON n.participant_id = a.participant_id AND n.variable = 'signup' AND n.end_at <= a.start_at AND n.start_at >= a.end_at - INTERVAL 24 HOUR WHERE a.variable = 'view' GROUP BY 1"""))
def _(spark, folder):
    o = base.observations(spark, folder)
    n = o.filter("variable = 'view'").select("participant_id", F.col("observation_id").alias("night_id"), F.col("start_at").alias("onset_at"), F.col("end_at").alias("wake_at"))
    return adapters.naps_before(n, o.filter("variable = 'signup'")).select("night_id", rnd("nap_minutes", 4).alias("nap_minutes"), "naps")


@query("j07_previous_day", "J7", with_ctes("daily", f"SELECT a.participant_id, a.day, {sql_rnd('b.value_sum', 4)} AS prior_sum FROM daily a LEFT JOIN daily b ON b.participant_id = a.participant_id AND b.day = a.day - 1"))
def _(spark, folder):
    d = base.daily(spark, folder)
    prior = d.select("participant_id", F.date_add("day", 1).alias("day"), F.col("value_sum").alias("prior_sum"))
    return d.select("participant_id", "day").join(prior, ["participant_id", "day"], "left").withColumn("prior_sum", F.round("prior_sum", 4))


@query("j09_randomised_only", "J9 S15", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 5000) GROUP BY 1")
def _(spark, folder):
    c = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING' OR c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, folder, "orders").join(c, "o_custkey", "left_semi").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("j14_day_pairing", "J14 S19", """
WITH a AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderdate AS DATE) AS day, o_orderstatus FROM orders), ac AS (SELECT k, day, count(*) AS n FROM a GROUP BY ALL),
s AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderdate AS DATE) AS day, l_quantity AS dur, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey), sl AS (SELECT s.*, max(dur) OVER (PARTITION BY k, day) AS m FROM s), sc AS (SELECT k, day, count(*) AS n FROM sl WHERE dur = m GROUP BY ALL)
SELECT CAST((SELECT count(*) FROM orders) AS BIGINT) AS activity_rows, CAST((SELECT count(*) FROM a) AS BIGINT) AS activity_unique, CAST((SELECT count(*) FROM ac WHERE n > 1) AS BIGINT) AS conflicting_days, CAST((SELECT count(*) FROM sc WHERE n > 1) AS BIGINT) AS tied_days,
 CAST((SELECT count(*) FROM ac JOIN sc USING (k, day) WHERE ac.n = 1 AND sc.n = 1) AS BIGINT) AS paired_days""")
def _(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    s = table(spark, folder, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("k", "day", F.col("l_quantity").alias("dur"), "l_linenumber")
    return adapters.pair_days(o.drop("o_orderkey"), s, ["k", "day"], "dur")[1]


@query("j15_attach_by_content", "J15 U2 R6", """
WITH t AS (SELECT DISTINCT sha256(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g')) AS k, length(text) AS n FROM documents), d AS (SELECT doc_id, sha256(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g')) AS k FROM documents)
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT d.k) AS BIGINT) AS tasks, CAST(sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS BIGINT) AS rows_sharing FROM (SELECT d.k, count(*) OVER (PARTITION BY k) AS c FROM d) d""")
def _(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", textkeys.content_key("text").alias("task_id"))
    tasks = d.groupBy("task_id").agg(F.count(F.lit(1)).alias("uses"))
    attached = d.join(tasks, "task_id")
    return attached.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("uses") > 1).alias("rows_sharing")).transform(with_row, tasks.agg(F.count(F.lit(1)).alias("tasks")))


@query("j22_refresh_by_source", "J22 V26 V37", """
SELECT 'c_acctbal' AS "column", CAST(count(*) AS BIGINT) AS cells, CAST(0 AS BIGINT) AS missing_right, CAST(0 AS BIGINT) AS missing_left, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS different FROM customer""")
def _(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    edited = c.withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(0.0)))
    return validate.compare_cells(c, edited, "c_custkey", ["c_acctbal"])


@query("s12_fitness_days", "S12 A17", with_ctes("obs_day", f"""
, d AS (SELECT participant_id, day, sum(CASE WHEN variable = 'view' THEN value END) / 60 AS asleep, sum(CASE WHEN variable IN ('view', 'signup') THEN value END) / 75 AS bed FROM obs_day GROUP BY ALL),
h AS (SELECT participant_id, day, stddev_samp(m) AS hsd FROM (SELECT participant_id, day, hour(local_at) AS hr, avg(value) AS m FROM obs_day GROUP BY ALL) GROUP BY ALL HAVING count(*) >= 3),
x AS (SELECT participant_id, day, CASE WHEN asleep BETWEEN 0 AND 24 THEN asleep END AS asleep, CASE WHEN bed BETWEEN 0 AND 24 THEN bed END AS bed, hsd FROM d LEFT JOIN h USING (participant_id, day))
SELECT participant_id, day, CASE WHEN NOT coalesce(bed < asleep, FALSE) THEN {sql_rnd('asleep')} END AS asleep_h, CASE WHEN NOT coalesce(bed < asleep, FALSE) THEN {sql_rnd('bed')} END AS in_bed_h, {sql_rnd('hsd')} AS hourly_sd, coalesce(bed < asleep, FALSE) AS dropped_sleep
FROM x WHERE hsd IS NOT NULL OR (NOT coalesce(bed < asleep, FALSE) AND (asleep IS NOT NULL OR bed IS NOT NULL))"""))
def _(spark, folder):
    o = base.observations(spark, folder).withColumn("day", clock.research_day("start_at", "timezone")).withColumn("hr", F.hour(clock.local_time("start_at", "timezone")))
    d = o.groupBy("participant_id", "day").agg((F.sum(F.when(F.col("variable") == "view", F.col("value"))) / 60).alias("asleep_h"), (F.sum(F.when(F.col("variable").isin("view", "signup"), F.col("value"))) / 75).alias("in_bed_h"))
    h = o.groupBy("participant_id", "day", "hr").agg(F.avg("value").alias("m")).groupBy("participant_id", "day").agg(F.stddev_samp("m").alias("hourly_sd"), F.count("m").alias("k")).filter("k >= 3").drop("k")
    f = adapters.fitness_days(d, h)
    return f.select("participant_id", "day", *[rnd(c).alias(c) for c in ("asleep_h", "in_bed_h", "hourly_sd")], "dropped_sleep")


@query("s16_sensor_or_diary", "S16 P13", with_ctes("obs_day", f"""
, s AS (SELECT participant_id, day, max(value) AS v FROM obs_day WHERE variable = 'view' GROUP BY ALL), d AS (SELECT participant_id, day, max(value) AS v FROM obs_day WHERE variable = 'signup' GROUP BY ALL)
SELECT participant_id, day, coalesce(s.v, d.v) AS value, CASE WHEN s.v IS NOT NULL THEN 'sensor' ELSE 'diary' END AS side, CASE WHEN s.v IS NOT NULL AND d.v IS NOT NULL THEN 'both' WHEN s.v IS NOT NULL THEN 'sensor_only' ELSE 'diary_only' END AS coverage FROM s FULL JOIN d USING (participant_id, day)"""))
def _(spark, folder):
    o = base.observations(spark, folder).withColumn("day", clock.research_day("start_at", "timezone"))
    side = lambda v: o.filter(F.col("variable") == v).groupBy("participant_id", "day").agg(F.max("value").alias("value"))
    return adapters.sensor_or_diary(side("view"), side("signup"), "value")


@query("s20_disjoint_shards", "S20 U3 S22", """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS uncovered, CAST(sum(CASE WHEN value > 400 THEN 1 ELSE 0 END) AS BIGINT) AS out_of_bounds FROM events""")
def _(spark, folder):
    e = table(spark, folder, "events").select("event_id", "event_type", "value")
    shards = [e.filter(F.col("event_type") == t) for t in ("view", "click")] + [e.filter(~F.col("event_type").isin("view", "click"))]
    merged = shards[0].unionByName(shards[1]).unionByName(shards[2])
    repeated = store.repeated_keys(merged, ["event_id"]).agg(F.count(F.lit(1)).alias("repeated"))
    uncovered = e.join(merged.select("event_id"), "event_id", "left_anti").agg(F.count(F.lit(1)).alias("uncovered"))
    return merged.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value") > 400).alias("out_of_bounds")).transform(with_row, repeated).transform(with_row, uncovered)


@query("s21_matrix_interchange", "S21", with_ctes("daily", " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST(count({f}) AS BIGINT) AS n, {sql_rnd(f'sum({f})', 3)} AS total FROM daily" for f in base.FEATURES)))
def _(spark, folder):
    m = tabular.matrix_long(base.daily(spark, folder).withColumn("record", F.concat_ws("|", "participant_id", "day")), "record", base.FEATURES)
    return m.groupBy("feature").agg(F.count("value").alias("n"), rnd(F.sum("value"), 3).alias("total"))


@query("s31_scores_by_method", "S31", "SELECT o_custkey, " + ", ".join(f"round(sum(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END), 2) AS {s.lower()}_total" for s in "FOP") + " FROM orders GROUP BY 1")
def _(spark, folder):
    o = table(spark, folder, "orders").groupBy("o_custkey").pivot("o_orderstatus", list("FOP")).agg(F.round(F.sum("o_totalprice"), 2))
    return o.select("o_custkey", *[F.col(s).alias(f"{s.lower()}_total") for s in "FOP"])


@query("u01_padded_union", "U1 S25", """
SELECT kind, segment, priority, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'customer' AS kind, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS priority FROM customer UNION ALL SELECT 'order', NULL, o_orderpriority FROM orders) GROUP BY ALL""")
def _(spark, folder):
    c = table(spark, folder, "customer").select(F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment"))
    o = table(spark, folder, "orders").select(F.lit("order").alias("kind"), F.col("o_orderpriority").alias("priority"))
    return c.unionByName(o, allowMissingColumns=True).groupBy("kind", "segment", "priority").agg(F.count(F.lit(1)).alias("n"))


@query("u03_inventory_difference", "U3 U4 V13", """
SELECT * FROM (SELECT o_custkey AS key, 'left_only' AS side FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT o_custkey, 'right_only' FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'))""")
def _(spark, folder):
    o = table(spark, folder, "orders")
    side = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("key")).distinct()
    return validate.inventory_difference(side("F"), side("O"))


# ---- validation ------------------------------------------------------------------------------------

@query("v01_observation_validation", "V1", with_ctes("obs", """
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN observation_id % 10 = 0 THEN 'unknown_provenance_kind' WHEN available_at < end_at THEN 'time_order' END AS reason FROM obs) GROUP BY 1"""))
def _(spark, folder):
    o = base.observations(spark, folder).withColumn("kind", F.when(F.col("observation_id") % 10 == 0, "guess").otherwise("observed"))
    return validate.validate_observations(o).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("v02_wide_record_rules", "V2 V3 V4 P14", """
SELECT field, reason, CAST(count(*) AS BIGINT) AS n FROM (
 SELECT 'quantity' AS field, CASE WHEN l_quantity < 5 THEN 'below_minimum' WHEN l_quantity > 45 THEN 'above_maximum' WHEN l_quantity <> floor(l_quantity) THEN 'not_an_integer' END AS reason FROM lineitem
 UNION ALL SELECT 'discount', CASE WHEN l_discount < 0 THEN 'below_minimum' WHEN l_discount >= 0.1 THEN 'above_maximum' END FROM lineitem) GROUP BY ALL""")
def _(spark, folder):
    specs = spark.createDataFrame([("quantity", 5.0, 45.0, False, True), ("discount", 0.0, 0.1, True, False)], "field string, low double, high double, exclusive boolean, integral boolean")
    l = table(spark, folder, "lineitem")
    long = l.select(F.explode(F.array(F.struct(F.lit("quantity").alias("field"), F.col("l_quantity").alias("v")), F.struct(F.lit("discount").alias("field"), F.col("l_discount").alias("v")))).alias("z")).select("z.*")
    j = long.join(F.broadcast(specs), "field")
    return j.withColumn("reason", validate.bound_reason("v", "low", "high", "exclusive", "integral")).groupBy("field", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("v07_panel_gating", "V5 V7 V8", with_ctes("obs_day", """
, f AS (SELECT participant_id, day, timezone, variable, sum(value) AS v, count(*) AS n, max(available_at) AS av, max(end_at) AS mu, ((CAST(day AS TIMESTAMP) + INTERVAL 4 HOUR) AT TIME ZONE timezone) AT TIME ZONE 'UTC' AS lo, ((CAST(day + 1 AS TIMESTAMP) + INTERVAL 4 HOUR) AT TIME ZONE timezone) AT TIME ZONE 'UTC' AS hi,
 ((CAST(day + 1 AS TIMESTAMP) + INTERVAL 12 HOUR) AT TIME ZONE timezone) AT TIME ZONE 'UTC' AS as_of FROM obs_day GROUP BY ALL)
SELECT variable, reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT variable, CASE WHEN av > as_of THEN 'not_available' WHEN mu > hi THEN 'unverified_measurement_cutoff' WHEN variable = 'error' THEN 'ineligible_provenance' WHEN n / 4.0 > 1 THEN 'no_coverage' WHEN variable = 'click' AND v >= 24 THEN 'clock_out_of_range' END AS reason FROM f) GROUP BY ALL"""))
def _(spark, folder):
    o = base.observations(spark, folder).withColumn("day", clock.research_day("start_at", "timezone"))
    f = o.groupBy("participant_id", "day", "timezone", F.col("variable").alias("name")).agg(
        F.sum("value").alias("value"), (F.count(F.lit(1)) / 4.0).alias("coverage"), F.max("available_at").alias("available_at"), F.max("end_at").alias("measured_until"))
    nxt = F.date_add("day", 1)
    f = (f.withColumn("day_start", clock.local_boundary("day", "timezone")).withColumn("day_end", clock.local_boundary(nxt, "timezone")).withColumn("as_of", clock.local_boundary(nxt, "timezone", 12))
         .withColumn("unit", F.lit("minute")).withColumn("expected_unit", F.lit("minute")).withColumn("definition", F.lit("v1")).withColumn("expected_definition", F.lit("v1")).withColumn("reason", F.lit(None).cast("string"))
         .withColumn("is_clock", F.col("name") == "click").withColumn("provenance", F.struct(F.when(F.col("name") == "error", "constructed").otherwise("observed").alias("kind"), F.lit("events").alias("source_id"), F.lit("h").alias("source_hash"), F.lit(True).alias("independent"))))
    return f.withColumn("gate", validate.gate_feature()).groupBy(F.col("name").alias("variable"), F.col("gate").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("v09_cohort_checks", "V9 S19", """
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS rows, CAST(sum(CASE WHEN l_quantity BETWEEN 1 AND 49 THEN 0 ELSE 1 END) AS BIGINT) AS bounds, CAST(sum(CASE WHEN l_discount + l_tax <= 0.12 THEN 0 ELSE 1 END) AS BIGINT) AS equation,
 CAST(sum(CASE WHEN l_quantity BETWEEN 1 AND 49 AND l_discount + l_tax <= 0.12 THEN 1 ELSE 0 END) AS BIGINT) AS all_passed FROM lineitem GROUP BY 1""")
def _(spark, folder):
    return validate.failure_counts(table(spark, folder, "lineitem"), {"bounds": F.col("l_quantity").between(1, 49), "equation": F.col("l_discount") + F.col("l_tax") <= 0.12}, ["l_returnflag"])


@query("v10_cross_conflicts", "V10 V33", """
SELECT conflicts, CAST(count(*) AS BIGINT) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN l_discount > l_tax THEN 'discount_over_tax' END, CASE WHEN l_quantity > 40 AND l_discount = 0 THEN 'large_without_discount' END], lambda x: x IS NOT NULL), ',') AS conflicts FROM lineitem) GROUP BY 1""")
def _(spark, folder):
    c = validate.cross_conflicts([("discount_over_tax", F.col("l_discount") > F.col("l_tax")), ("large_without_discount", (F.col("l_quantity") > 40) & (F.col("l_discount") == 0))])
    return table(spark, folder, "lineitem").select(F.concat_ws(",", c).alias("conflicts")).groupBy("conflicts").agg(F.count(F.lit(1)).alias("n"))


@query("v15_corpus_validation", "V15 V16 V20", """
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'unknown_category' WHEN length(trim(text)) = 0 THEN 'empty_text' WHEN length(trim(text)) > 10000 THEN 'too_long' ELSE 'not_chinese' END AS reason FROM documents) GROUP BY 1""")
def _(spark, folder):
    d = table(spark, folder, "documents")
    return d.select(textkeys.input_problem("lang", "text", {"en": "a", "fr": "b", "de": "c"}).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("v19_span_validation", "V19 P28", """
SELECT problem, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN n_chars % 50 + 10 > length(text) THEN 'offsets_out_of_text' WHEN substr(text, CAST(n_chars % 50 AS BIGINT) + 1, 10) <> substr(text, 1, 10) THEN 'quote_differs' END AS problem FROM documents) GROUP BY 1""")
def _(spark, folder):
    d = table(spark, folder, "documents").withColumn("s", (F.col("n_chars") % 50).cast("int"))
    p = textkeys.span_problem("text", F.col("s"), F.col("s") + 10, F.substring("text", 1, 10))
    return d.select(p.alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("v23_sequence_audit", "V23 V12", with_ctes("daily", """
SELECT participant_id, CAST(count(*) AS BIGINT) AS rows, CAST(sum(CASE WHEN s > 1 THEN 1 ELSE 0 END) AS BIGINT) AS gaps, CAST(sum(CASE WHEN s = 0 THEN 1 ELSE 0 END) AS BIGINT) AS repeats, CAST(max(s) AS INTEGER) AS longest_step FROM (SELECT participant_id, day - lag(day) OVER (PARTITION BY participant_id ORDER BY day) AS s FROM daily) GROUP BY 1"""))
def _(spark, folder):
    return validate.audit_sequence(base.daily(spark, folder))


@query("v24_fill_only_blank", "V24 A56", """
SELECT fate, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN v IS NULL AND q IS NOT NULL THEN 'restored' WHEN v IS NULL THEN 'still_blank' WHEN q IS NULL OR v = q THEN 'unchanged' ELSE 'conflict' END AS fate FROM (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN CASE WHEN n_chars > 800 THEN 1 ELSE 0 END END AS v FROM documents) d LEFT JOIN (SELECT doc_id, quality AS q FROM labels) USING (doc_id)) GROUP BY 1""")
def _(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, (F.col("n_chars") > 800).cast("int")).alias("quality"))
    return validate.fill_only_blank(d, table(spark, folder, "labels"), "doc_id", "quality").groupBy("fate").agg(F.count(F.lit(1)).alias("n"))


@query("a56_missing_cells", "A56", """
SELECT 'quality' AS "column", CAST(sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_before, CAST(0 AS BIGINT) AS missing_after FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', CAST(sum(CASE WHEN toxic IS NULL THEN 1 ELSE 0 END) AS BIGINT), CAST(0 AS BIGINT) FROM documents LEFT JOIN labels USING (doc_id)""")
def _(spark, folder):
    d = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    return validate.missing_cells(d, d.fillna(0, ["quality", "toxic"]), ["quality", "toxic"])


@query("v28_ambiguous_local_times", "V28", f"""
SELECT timezone, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN (((u - INTERVAL 1 HOUR) AT TIME ZONE timezone) = moment OR ((u + INTERVAL 1 HOUR) AT TIME ZONE timezone) = moment) THEN 1 ELSE 0 END) AS BIGINT) AS ambiguous FROM (SELECT timezone, moment, moment AT TIME ZONE timezone AS u FROM (
 SELECT l_shipdate + to_minutes(CAST((l_orderkey * 37 + l_linenumber * 11) % 1440 AS BIGINT)) AS moment, CASE l_suppkey % 4 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Europe/London' WHEN 2 THEN 'Asia/Shanghai' ELSE 'America/New_York' END AS timezone FROM lineitem)) GROUP BY 1""")
def _(spark, folder):
    l = table(spark, folder, "lineitem")
    minute = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 1440
    at = F.timestamp_micros(F.unix_micros(F.col("l_shipdate").cast("timestamp")) + minute * 60_000_000)
    rows = l.select(at.alias("moment"), base.zone_of(F.col("l_suppkey")).alias("timezone"))
    return rows.groupBy("timezone").agg(F.count(F.lit(1)).alias("n"), F.count_if(clock.is_ambiguous("moment", "timezone")).alias("ambiguous"))


@query("v30_manifest_check", "V30", """SELECT CAST(0 AS BIGINT) AS problems, CAST(1 AS BIGINT) AS listed""")
def _(spark, folder):
    files = spark.read.format("binaryFile").load(f"{folder}/events.parquet").select("path", "content")
    manifest = files.select("path", F.sha2("content", 256).alias("sha256"))
    return store.verify_manifest(files, manifest).agg(F.count(F.lit(1)).alias("problems")).transform(with_row, manifest.agg(F.count(F.lit(1)).alias("listed")))


@query("v38_four_occasions", "V38 W11 J11 O9", f"""
WITH o AS (SELECT o_custkey AS participant_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS occasion, * FROM orders),
c AS (SELECT participant_id, occasion, CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS off, CASE WHEN o_orderstatus <> 'P' THEN CAST((o_orderkey * 7) % 1440 AS DOUBLE) END AS ss, CAST((o_orderkey * 13) % 1440 AS DOUBLE) AS se, CAST((o_custkey + o_orderkey) % 1440 AS DOUBLE) AS a, CAST((o_orderkey * 3) % 1440 AS DOUBLE) AS b, CAST((o_orderkey * 5) % 1440 AS DOUBLE) AS c FROM o WHERE occasion <= 4),
e AS (SELECT *, CASE WHEN ss IS NOT NULL AND ((se - ss) % 1440 + 1440) % 1440 > 0 THEN (ss + (((se - ss) % 1440 + 1440) % 1440) / 2) % 1440 END AS mid FROM c),
n AS (SELECT *, lead(occasion) OVER w AS no, lead(off) OVER w AS noff, lead(mid) OVER w AS nmid, lead(a) OVER w AS na, lead(b) OVER w AS nb, lead(c) OVER w AS nc FROM e WINDOW w AS (PARTITION BY participant_id ORDER BY occasion)),
s AS (SELECT participant_id, occasion, CASE WHEN noff <= off THEN 'nonincreasing_date' WHEN mid IS NULL OR nmid IS NULL THEN 'missing_clock_evidence' ELSE 'observed_timing_shift' END AS status, abs(((mid - nmid + 720) % 1440 + 1440) % 1440 - 720) AS sl,
 (abs(((a - na + 720) % 1440 + 1440) % 1440 - 720) + abs(((b - nb + 720) % 1440 + 1440) % 1440 - 720) + abs(((c - nc + 720) % 1440 + 1440) % 1440 - 720)) / 3 AS ml FROM n WHERE no IS NOT NULL)
SELECT participant_id, occasion, status, CASE WHEN status = 'observed_timing_shift' THEN {sql_rnd('sl')} END AS sleep_shift_min, CASE WHEN status = 'observed_timing_shift' THEN {sql_rnd('ml')} END AS meal_shift_min, CASE WHEN status = 'observed_timing_shift' THEN {sql_rnd('least(sl, ml)')} END AS joint_shift_min FROM s""")
def _(spark, folder):
    s = wards.next_shift(ward_rows(spark, folder))
    return s.select("participant_id", "occasion", "status", *[rnd(c).alias(c) for c in ("sleep_shift_min", "meal_shift_min", "joint_shift_min")])


def ward_rows(spark, folder):
    """First four orders of a customer as ordered occasions with clock minutes from their keys."""
    o = table(spark, folder, "orders")
    first = o.withColumn("occasion", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).filter("occasion <= 4")
    k = F.col("o_orderkey")
    return first.select(F.col("o_custkey").alias("participant_id"), "occasion", F.datediff("o_orderdate", F.lit("1995-01-01")).alias("offset"),
                        F.when(F.col("o_orderstatus") != "P", ((k * 7) % 1440).cast("double")).alias("sleep_start"), ((k * 13) % 1440).cast("double").alias("sleep_end"),
                        ((F.col("o_custkey") + k) % 1440).cast("double").alias("meal_a"), ((k * 3) % 1440).cast("double").alias("meal_b"), ((k * 5) % 1440).cast("double").alias("meal_c"))


@query("o10_person_label", "O10 J10", f"""
WITH o AS (SELECT o_custkey AS participant_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS occasion, * FROM orders),
c AS (SELECT participant_id, occasion, CASE WHEN o_orderstatus <> 'P' THEN CAST((o_orderkey * 7) % 1440 AS DOUBLE) END AS ss, CAST((o_orderkey * 13) % 1440 AS DOUBLE) AS se, CAST((o_custkey + o_orderkey) % 1440 AS DOUBLE) AS a, CAST((o_orderkey * 3) % 1440 AS DOUBLE) AS b, CAST((o_orderkey * 5) % 1440 AS DOUBLE) AS c FROM o WHERE occasion <= 4),
e AS (SELECT *, CASE WHEN ss IS NOT NULL AND ((se - ss) % 1440 + 1440) % 1440 > 0 THEN (ss + (((se - ss) % 1440 + 1440) % 1440) / 2) % 1440 END AS mid FROM c),
p AS (SELECT x.participant_id, least(abs(((x.mid - y.mid + 720) % 1440 + 1440) % 1440 - 720), (abs(((x.a - y.a + 720) % 1440 + 1440) % 1440 - 720) + abs(((x.b - y.b + 720) % 1440 + 1440) % 1440 - 720) + abs(((x.c - y.c + 720) % 1440 + 1440) % 1440 - 720)) / 3) AS j
 FROM e x JOIN e y ON x.participant_id = y.participant_id AND x.occasion < y.occasion AND x.occasion > 1 WHERE x.mid IS NOT NULL AND y.mid IS NOT NULL)
SELECT g.participant_id, {sql_rnd('m')} AS joint_shift_min, CAST(m >= 200 AS INTEGER) AS label, CAST(k AS BIGINT) AS complete_occasions FROM (SELECT participant_id, count(mid) FILTER (occasion > 1) AS k FROM e GROUP BY 1 HAVING count(*) = 4) g LEFT JOIN (SELECT participant_id, max(j) AS m FROM p GROUP BY 1) USING (participant_id)""")
def _(spark, folder):
    return wards.person_label(ward_rows(spark, folder), 200.0).withColumn("joint_shift_min", F.round("joint_shift_min", 6))


@query("p08_clock_minutes", "P8 V4", """
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(count(m) AS BIGINT) AS parsed, round(sum(m), 4) AS minutes FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 26 < 24 THEN CAST((o_orderkey % 26) * 60 + o_custkey % 60 AS DOUBLE) END AS m FROM orders) GROUP BY 1""")
def _(spark, folder):
    o = table(spark, folder, "orders").withColumn("t", F.format_string("%02d:%02d", F.col("o_orderkey") % 26, F.col("o_custkey") % 60)).withColumn("m", adapters.clock_minutes("t").cast("double"))
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count("m").alias("parsed"), F.round(F.sum("m"), 4).alias("minutes"))


@query("p09_partial_dates", "P9 P15 P33", """
SELECT status, CAST(count(*) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS candidates FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'calendar_date' WHEN x = 1 THEN 'month_day' WHEN x = 2 THEN 'ambiguous' ELSE 'invalid' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE x END AS k FROM (
 SELECT o_orderkey, CASE WHEN a = b THEN CAST(f AS INTEGER) ELSE CAST(f AS INTEGER) + CAST(g AS INTEGER) END AS x FROM (SELECT o_orderkey, a, b, a BETWEEN 1 AND 12 AND b BETWEEN 1 AND ([31,29,31,30,31,30,31,31,30,31,30,31])[greatest(1, least(a, 12))] AS f, b BETWEEN 1 AND 12 AND a BETWEEN 1 AND ([31,29,31,30,31,30,31,31,30,31,30,31])[greatest(1, least(b, 12))] AS g
  FROM (SELECT o_orderkey, CAST(o_orderkey % 16 AS INTEGER) AS a, CAST(o_custkey % 34 AS INTEGER) AS b FROM orders)))) GROUP BY 1""")
def _(spark, folder):
    o = table(spark, folder, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.format_string("%d-%d", F.col("o_orderkey") % 16, F.col("o_custkey") % 34))
    d = o.select(adapters.partial_date(text).alias("d"))
    return d.groupBy("d.status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("d.candidates")).cast("long").alias("candidates"))


@query("p10_sleep_midpoints", "P10 P11", with_ctes("daily", f"""
SELECT participant_id, day, CASE WHEN {sql_pmod('last_h - first_h', 24)} > 0 THEN {sql_rnd(sql_pmod(f"first_h + ({sql_pmod('last_h - first_h', 24)}) / 2", 24))} END AS midpoint FROM daily"""))
def _(spark, folder):
    return base.daily(spark, folder).select("participant_id", "day", rnd(clock.sleep_midpoint("first_h", "last_h")).alias("midpoint"))


@query("p12_rescaled_answers", "P12", "SELECT o_orderpriority, CAST(floor((CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1) * 2.5 + 0.5) AS INTEGER) AS score, CAST(floor((5 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) * 2.5 + 0.5) AS INTEGER) AS reversed, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL")
def _(spark, folder):
    o = table(spark, folder, "orders").withColumn("a", F.substring("o_orderpriority", 1, 1).cast("int"))
    return o.groupBy("o_orderpriority", adapters.rescale_five("a").alias("score"), adapters.rescale_five("a", True).alias("reversed")).agg(F.count(F.lit(1)).alias("n"))


@query("p18_fingerprints", "P18", "SELECT c_custkey, sha256('{\"c_acctbal_cents\":' || CAST(round(c_acctbal * 100) AS BIGINT) || ',\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\"}') AS id FROM customer")
def _(spark, folder):
    c = table(spark, folder, "customer").withColumn("c_acctbal_cents", F.round(F.col("c_acctbal") * 100).cast("long"))
    return c.select("c_custkey", textkeys.fingerprint("c_custkey", "c_mktsegment", "c_acctbal_cents").alias("id"))


@query("p19_derived_lineage", "P19", """
SELECT o_custkey, CASE WHEN s > 0 AND s < n THEN 'unknown' WHEN r <= 2 THEN 'derived' WHEN r = 3 THEN 'synthetic' WHEN r = 4 THEN 'constructed' ELSE 'unknown' END AS kind, CAST(n AS BIGINT) AS parents, TRUE AS independent FROM (
 SELECT o_custkey, max(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) AS r, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS s, count(*) AS n FROM orders GROUP BY 1)""")
def _(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "observed").when(F.col("o_orderstatus") == "O", "derived").otherwise("synthetic").alias("kind"),
                                             F.col("o_orderkey").cast("string").alias("source_id"), F.md5(F.col("o_orderkey").cast("string")).alias("source_hash"), F.lit(True).alias("independent"))
    return validate.merge_lineage(o, ["o_custkey"]).drop("parent_digest")


@query("p32_written_dates", "P32 P30", "SELECT CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS DATE) AS day, CAST(count(*) AS BIGINT) AS n, CAST(max(CAST(o_orderdate AS DATE) - DATE '1995-01-01') AS INTEGER) AS study_day FROM orders GROUP BY 1")
def _(spark, folder):
    t = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+08:00'")
    o = table(spark, folder, "orders").select(F.when(clock.parse_instant(t).isNotNull(), F.to_date(F.substring(t, 1, 10))).alias("day"))
    return o.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.max(F.datediff("day", F.lit("1995-01-01"))).alias("study_day"))


@query("a27_source_audit", "A27 A28", """
SELECT source, lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN n_chars > 5000 THEN 1 ELSE 0 END) AS BIGINT) AS long_texts FROM documents GROUP BY GROUPING SETS ((source), (lang), ())""")
def _(spark, folder):
    d = table(spark, folder, "documents").groupingSets([["source"], ["lang"], []], "source", "lang")
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 5000).alias("long_texts")).select("source", "lang", "n", "long_texts")


@query("a28_expansion_inventory", "A28", """
SELECT source, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT lang) AS BIGINT) AS categories, CAST(count(DISTINCT lang || '|' || md5(text)) AS BIGINT) AS distinct_pairs FROM documents GROUP BY 1""")
def _(spark, folder):
    d = table(spark, folder, "documents").select("source", "lang", F.md5("text").alias("t"))
    pairs = d.groupBy("source", "lang", "t").agg(F.count(F.lit(1)).alias("k")).groupBy("source", "lang").agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("p"))
    return pairs.groupBy("source").agg(F.sum("k").alias("rows"), F.count(F.lit(1)).alias("categories"), F.sum("p").alias("distinct_pairs"))


@query("a28_expansion_audit", "A28 A27", """
WITH e AS (SELECT event_type AS source, user_id AS p, event_id AS r, CAST(ts AS DATE) AS day, CASE WHEN event_id % 7 > 0 THEN value END AS v, event_id % 3 = 0 AS tv, event_id % 5 < 3 AS tw FROM events),
x AS (SELECT DISTINCT doc_id % 311 AS p FROM labels WHERE quality = 0 UNION SELECT e.p FROM e WHERE r IN (SELECT doc_id FROM labels WHERE toxic = 1)),
c AS (SELECT source, count(*) AS records, count(*) FILTER ((v IS NOT NULL AND tv) OR tw) AS rows_with_traced, count(*) FILTER (v IS NOT NULL AND tv) AS traced_value, count(*) FILTER (tw) AS traced_hour, count(*) FILTER (v IS NOT NULL AND tv AND tw) AS panel_both FROM e GROUP BY 1),
d AS (SELECT source, p, day, count(*) AS k FROM e GROUP BY ALL),
i AS (SELECT source, p, day - CAST(row_number() OVER (PARTITION BY source, p ORDER BY day) AS INTEGER) AS run FROM d WHERE k = 1),
n AS (SELECT source, p, run, count(*) AS n FROM i GROUP BY ALL),
b AS (SELECT source, p, max(n) AS streak, sum(greatest(n - 2, 0)) AS room FROM n GROUP BY ALL),
t AS (SELECT source, p, count(*) FILTER (k > 1) AS dup FROM d GROUP BY ALL),
s AS (SELECT t.source, count(*) AS people, count(x.p) AS exposed_people, count(*) FILTER (streak >= 14) AS people_14_days, count(*) FILTER (streak >= 30) AS people_30_days, sum(dup) AS duplicate_days, sum(coalesce(room, 0)) AS bound FROM t LEFT JOIN b USING (source, p) LEFT JOIN x ON x.p = t.p GROUP BY 1)
SELECT c.*, CAST(people AS BIGINT) AS people, CAST(exposed_people AS BIGINT) AS exposed_people, CAST(people_14_days AS BIGINT) AS people_14_days, CAST(people_30_days AS BIGINT) AS people_30_days, CAST(duplicate_days AS BIGINT) AS duplicate_days, CAST(bound AS BIGINT) AS window_upper_bound FROM c JOIN s USING (source)""")
def _(spark, folder):
    """Traceable cells, exposed people and calendar room of every source of events."""
    i = F.col("event_id")
    kind = lambda c: F.when(c, inventory.TRACED).otherwise("constructed")
    cells = F.map_from_arrays(F.array(F.lit("value"), F.lit("hour")), F.array(F.when(i % 7 > 0, F.col("value")), F.hour("ts").cast("double")))
    evidence = F.map_from_arrays(F.array(F.lit("value"), F.lit("hour")), F.array(kind(i % 3 == 0), kind(i % 5 < 3)))
    e = table(spark, folder, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("participant_id"), i.alias("record_id"), F.to_date("ts").alias("day"), cells.alias("cells"), evidence.alias("evidence"))
    labels = table(spark, folder, "labels")
    used = labels.select(F.when(F.col("quality") == 0, F.col("doc_id") % 311).alias("participant_id"), F.when(F.col("toxic") == 1, F.col("doc_id")).alias("record_id"))
    return inventory.expansion_inventory(e, used, ["value", "hour"], {"both": ("value", "hour")}, future_days=2)


@query("a41_capacity_grid", "A41 W8", """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS wear FROM events GROUP BY ALL), g AS (SELECT w, h FROM (SELECT unnest([0, 60, 120]) AS w), (SELECT unnest([3, 5]) AS h)),
k AS (SELECT DISTINCT w, user_id, day FROM d JOIN (SELECT DISTINCT w FROM g) ON wear >= w), i AS (SELECT w, user_id, day - CAST(row_number() OVER (PARTITION BY w, user_id ORDER BY day) AS INTEGER) AS x FROM k), r AS (SELECT w, user_id, x, count(*) AS len FROM i GROUP BY ALL)
SELECT CAST(r.w AS INTEGER) AS wear, CAST(g.h AS INTEGER) AS history, CAST(sum(greatest(0, len - h - 2)) AS BIGINT) AS windows, CAST(count(DISTINCT CASE WHEN len - h - 2 > 0 THEN user_id END) AS BIGINT) AS people FROM r JOIN g ON g.w = r.w GROUP BY ALL""")
def _(spark, folder):
    d = table(spark, folder, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("wear_sum"))
    kept = d.withColumn("wear", F.explode(F.array(*[F.lit(w) for w in (0, 60, 120)]))).filter("wear_sum >= wear")
    runs = windows.streaks(kept, ["wear", "user_id"]).withColumn("history", F.explode(F.array(F.lit(3), F.lit(5))))
    per = runs.withColumn("w", F.greatest(F.lit(0), F.col("length") - F.col("history") - 2)).groupBy("wear", "history", "user_id").agg(F.sum("w").alias("w"))
    return per.groupBy("wear", "history").agg(F.sum("w").alias("windows"), F.count_if(F.col("w") > 0).alias("people"))


@query("a42_measurement_error", "A42", f"""
SELECT lang, metric, CAST(count(*) AS BIGINT) AS n, {sql_rnd('avg(abs(d))', 4)} AS mae, {sql_rnd('stddev_samp(d)', 4)} AS sd FROM (SELECT lang, 'chars' AS metric, CAST(length(text) - n_chars AS DOUBLE) AS d FROM documents) GROUP BY ALL""")
def _(spark, folder):
    d = table(spark, folder, "documents").select("lang", F.lit("chars").alias("metric"), (F.length("text") - F.col("n_chars")).cast("double").alias("d"))
    return d.groupBy("lang", "metric").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(F.abs("d")), 4).alias("mae"), rnd(F.stddev_samp("d"), 4).alias("sd"))


@query("a45_repeated_runs", "A45", f"""
SELECT arm, {sql_rnd('avg(v)', 3)} AS mean, {sql_rnd('stddev_samp(v)', 3)} AS sd, string_agg(CAST(seed AS VARCHAR), ',' ORDER BY seed) AS seeds FROM (SELECT o_orderpriority AS arm, year(o_orderdate) AS seed, avg(o_totalprice) AS v FROM orders GROUP BY ALL) GROUP BY 1""")
def _(spark, folder):
    r = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("arm"), F.year("o_orderdate").alias("seed")).agg(F.avg("o_totalprice").alias("v"))
    return r.groupBy("arm").agg(rnd(F.avg("v"), 3).alias("mean"), rnd(F.stddev_samp("v"), 3).alias("sd"), F.concat_ws(",", F.array_sort(F.collect_set("seed"))).alias("seeds"))


@query("m02_person_weights", "M2", "SELECT o_custkey, round(1.0::DOUBLE / count(*) / (SELECT count(DISTINCT o_custkey) FROM orders), 10) AS weight, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def _(spark, folder):
    from chronowarn.operators.learners import person_weights
    w = person_weights(table(spark, folder, "orders").select("o_custkey"), "o_custkey")
    return w.groupBy("o_custkey").agg(F.round(F.first("weight"), 10).alias("weight"), F.count(F.lit(1)).alias("n"))


@query("p34_context_variants", "P34", "SELECT role, mode, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text) + CASE mode WHEN 'instructed' THEN 10 WHEN 'clean' THEN 0 ELSE 0 END) AS BIGINT) AS chars FROM conversations, (SELECT unnest(['clean', 'original', 'instructed']) AS mode) GROUP BY ALL")
def _(spark, folder):
    c = table(spark, folder, "conversations")
    v = F.array(F.struct(F.lit("clean").alias("mode"), F.col("text").alias("t")), F.struct(F.lit("original").alias("mode"), F.col("text").alias("t")), F.struct(F.lit("instructed").alias("mode"), F.concat(F.lit("Read this: ").substr(1, 10), F.col("text")).alias("t")))
    return c.select("role", F.explode(v).alias("z")).groupBy("role", "z.mode").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("z.t")).alias("chars"))


@query("p31_policy_decisions", "P31", with_ctes("dayscore", f"SELECT participant_id, day, CASE WHEN score > {base.THRESHOLD} THEN 1 WHEN score IS NOT NULL THEN 0 END AS decision FROM dayscore"))
def _(spark, folder):
    s = base.scaled(spark, folder)
    return s.select("participant_id", "day", F.when(F.col("score").isNotNull(), (F.col("score") > base.THRESHOLD).cast("int")).alias("decision"))


MARKERS = (*adapters.MISSING, "N/A", " None ", "nan", "无", "0", "1.5")
MARKERS_SQL = "[" + ", ".join(f"'{m}'" for m in MARKERS) + "]"


@query("v04_missing_markers", "V4", f"""
WITH m AS (SELECT event_type, {MARKERS_SQL}[event_id % {len(MARKERS)} + 1] AS raw FROM events)
SELECT event_type, raw, lower(trim(raw)) IN ({", ".join(f"'{m}'" for m in adapters.MISSING)}) AS record_missing, trim(raw) IN ('', '—', '–', '-') AS ward_missing, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY ALL""")
def _(spark, folder):
    """Every marker of both sources, some look-alikes and numbers, per kind of event."""
    e = table(spark, folder, "events")
    m = e.select("event_type", F.element_at(F.array(*[F.lit(x) for x in MARKERS]), (F.col("event_id") % len(MARKERS) + 1).cast("int")).alias("raw"))
    flags = m.select("event_type", "raw", adapters.is_missing("raw").alias("record_missing"), adapters.is_missing("raw", adapters.WARD_MISSING).alias("ward_missing"))
    return flags.groupBy("event_type", "raw", "record_missing", "ward_missing").agg(F.count(F.lit(1)).alias("n"))


STEPS = (("runs", "event_type = 'view'"), ("annotations", "event_type = 'click'"), ("strangers", "event_id % 10 = 0"), ("again", "event_type = 'view'"), ("follow_up", "event_type NOT IN ('view', 'click')"))
STEP_DIGEST = DIGEST.format(t="event_id || chr(124) || user_id || chr(124) || event_type")


@query("s27_audited_appends", "S27 S28 S29 S9 A47", f"""
WITH s AS (SELECT 0 AS step, 'runs' AS operation, 'appended' AS status, 1 AS upto, 'view' AS part UNION ALL SELECT 1, 'annotations', 'appended', 2, 'click'
  UNION ALL SELECT 2, 'strangers', 'refused_orphans', 2, '' UNION ALL SELECT 3, 'again', 'refused_repeats', 2, '' UNION ALL SELECT 4, 'follow_up', 'appended', 3, 'rest'),
e AS (SELECT *, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS stage FROM events),
d AS (SELECT upto, d.* FROM (SELECT unnest([1, 2, 3]) AS upto) u, LATERAL (SELECT {STEP_DIGEST} FROM e WHERE stage <= upto) d),
n AS (SELECT stage, count(*) AS n FROM e GROUP BY 1)
SELECT CAST(step AS INTEGER) AS step, operation, status, CAST(d.rows - CASE WHEN status = 'appended' THEN coalesce(n.n, 0) ELSE 0 END AS BIGINT) AS rows_before,
 CAST(CASE WHEN status = 'appended' THEN coalesce(n.n, 0) ELSE 0 END AS BIGINT) AS rows_added, d.digest_a, d.digest_b FROM s JOIN d USING (upto) LEFT JOIN n ON n.stage = s.upto""")
def _(spark, folder):
    """Three appends to one store, and two batches that are refused: without parents, and with stored keys."""
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    people = e.select("user_id").distinct()
    path, audit = _scratch(spark, "audited"), _scratch(spark, "audit")
    for name, part in STEPS:
        batch = e.where(part)
        if name == "strangers":  # people that nobody knows
            batch = batch.withColumns({"event_id": -F.col("event_id") - 1, "user_id": -F.col("user_id") - 1})
        store.append_audited(batch, path, ["event_id"], audit, name, people)
    return spark.read.parquet(audit)
