"""Calibration, event metrics, resampling and method comparison on the labelled forecasts."""

from pyspark.sql import functions as F

from chronowarn.functions import clock
from chronowarn.operators import evaluate, resample, windows
from chronowarn.plans import base, q_endpoints
from chronowarn.plans.registry import cte, query, rnd, sql_rnd, table, with_ctes
from chronowarn.session import materialise, shared_table

BUDGET = 4.0
REPS = 2000
METHODS = ("deviation", "change")


def method_days(spark, folder, *roles):
    """Labelled forecast days of the given roles for two scoring methods.

    Scores are given to nine decimals, so that equal days tie whatever the order of their sums.
    """
    def build():
        lab = q_endpoints.labels(spark, folder).select("participant_id", "day", "issued_at", "label", F.col("label_onset").alias("onset"))
        s = windows.previous_day_change(base.scaled(spark, folder)).select("participant_id", "day", F.col("score").alias("deviation"), F.col("previous_day_change").alias("change"))
        wide = lab.join(s, ["participant_id", "day"], "left").join(base.roles(spark, folder), "participant_id")
        pair = F.array(*[F.struct(F.lit(m).alias("method"), F.round(m, 9).alias("score")) for m in METHODS])
        return wide.select("participant_id", "role", "day", "issued_at", "label", "onset", F.explode(pair).alias("z")).select("*", "z.method", "z.score").drop("z")
    return shared_table(spark, folder, "method_days", build).filter(F.col("role").isin(*roles)).drop("role")


def method_events(spark, folder, *roles):
    e = q_endpoints.events(spark, folder).join(base.roles(spark, folder).filter(F.col("role").isin(*roles)), "participant_id", "left_semi")
    return e.select("participant_id", "onset", F.explode(F.array(*[F.lit(m) for m in METHODS])).alias("method"))


cte("mdays", """
SELECT f.participant_id, r.role, f.day, f.issued_at, f.label, f.onset, m.method, round(CASE m.method WHEN 'deviation' THEN s.score ELSE c.pdc END, 9) AS score
FROM labels_ f JOIN roles r USING (participant_id) CROSS JOIN (SELECT unnest(['deviation', 'change']) AS method) m
LEFT JOIN dayscore s ON s.participant_id = f.participant_id AND s.day = f.day
LEFT JOIN (SELECT a.participant_id, a.day, CASE WHEN count(a.z - b.z) = 7 THEN avg(abs(a.z - b.z)) END AS pdc FROM zlong a JOIN zlong b ON b.participant_id = a.participant_id AND b.j = a.j AND b.day = a.day - 1 GROUP BY ALL) c ON c.participant_id = f.participant_id AND c.day = f.day""",
    "labels_ roles dayscore zlong")
cte("mevents", "SELECT e.participant_id, e.onset, r.role, m.method FROM events_found e JOIN roles r USING (participant_id) CROSS JOIN (SELECT unnest(['deviation', 'change']) AS method) m", "events_found roles")
T = 0.8


def person_sql(walkrel, days, thr):
    """Per-person counts from a walked relation, as SQL."""
    return f"""
SELECT d.method, d.participant_id, count(*) AS forecast_days, count(d.score) AS scored_days, count(d.label) AS labelled_days, sum(CASE WHEN d.score IS NOT NULL AND d.label IS NOT NULL THEN 1 ELSE 0 END) AS valid_risk_days,
 sum(CASE WHEN w.warning = 1 AND d.label = 1 THEN 1 ELSE 0 END) AS true_alarms, sum(CASE WHEN w.warning = 1 AND d.label = 0 THEN 1 ELSE 0 END) AS false_alarms, sum(CASE WHEN w.warning = 1 AND d.label IS NULL THEN 1 ELSE 0 END) AS unknown_alarms,
 max(CASE WHEN w.warning = 1 AND d.label = 1 THEN (epoch_us(d.onset) - epoch_us(d.issued_at)) / 8.64e10 END) AS lead,
 sum(CASE WHEN d.label = 1 AND d.score > {thr} THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN d.label = 0 AND d.score <= {thr} THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN d.label = 0 AND d.score > {thr} THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN d.label = 1 AND d.score <= {thr} THEN 1 ELSE 0 END) AS fn
FROM {days} d JOIN {walkrel} w ON w.method = d.method AND w.participant_id = d.participant_id AND w.day = d.day GROUP BY ALL"""


cte("caldays", "SELECT method, participant_id, day, issued_at, label, onset, score FROM mdays WHERE role IN ('calibration', 'development')", "mdays")
RATES = """, CAST(detected AS DOUBLE) / nullif(events, 0) AS event_sensitivity, CAST(false_alarms * 30 AS DOUBLE) / nullif(valid_risk_days, 0) AS false_alarms_per_30_days, CAST(true_alarms AS DOUBLE) / nullif(true_alarms + false_alarms, 0) AS alarm_ppv,
 CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS risk_sensitivity, CAST(tn AS DOUBLE) / nullif(tn + fp, 0) AS risk_specificity, CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0) AS risk_accuracy,
 (CAST(tp AS DOUBLE) / nullif(tp + fn, 0) + CAST(tn AS DOUBLE) / nullif(tn + fp, 0)) / 2 AS risk_balanced_accuracy"""
RATE_NAMES = ("event_sensitivity", "false_alarms_per_30_days", "alarm_ppv", "risk_sensitivity", "risk_specificity", "risk_accuracy", "risk_balanced_accuracy")
COUNT_NAMES = ("events", "detected_events", "true_alarms", "false_alarms", "unknown_alarms", "valid_risk_days", "tp", "tn", "fp", "fn")

METRIC_LOCAL = base.alarm_sql("caldays", f"{T}::DOUBLE", "method, participant_id") + f""",
person AS (SELECT coalesce(p.method, e.method) AS method, coalesce(p.participant_id, e.participant_id) AS participant_id, p.* EXCLUDE (method, participant_id), CASE WHEN e.onset IS NULL THEN 0 ELSE 1 END AS events
 FROM ({person_sql('walk', 'caldays', T)}) p FULL JOIN (SELECT * FROM mevents WHERE role IN ('calibration', 'development')) e ON e.method = p.method AND e.participant_id = p.participant_id),
total AS (SELECT method, sum(events) AS events, count(lead) AS detected, median(lead) AS median_lead_days, {', '.join(f'sum({c}) AS {c}' for c in ('forecast_days', 'scored_days', 'labelled_days', 'valid_risk_days', 'true_alarms', 'false_alarms', 'unknown_alarms', 'tp', 'tn', 'fp', 'fn'))} FROM person GROUP BY 1)"""


@query("l03_event_metrics", "L3 J12", with_ctes("caldays mevents", f"""
SELECT t.method, {', '.join(f'CAST({"detected" if c == "detected_events" else c} AS BIGINT) AS {c}' for c in COUNT_NAMES)}, {', '.join(f'{sql_rnd(c)} AS {c}' for c in RATE_NAMES)}, {sql_rnd('median_lead_days')} AS median_lead_days,
 {sql_rnd('auc')} AS roc_auc, {sql_rnd('ap')} AS average_precision
FROM (SELECT *{RATES} FROM total) t
JOIN (SELECT method, (sum(CASE WHEN label = 1 THEN rk ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * sum(1 - label)) AS auc FROM (
   SELECT method, label, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0::DOUBLE AS rk FROM caldays WHERE label IS NOT NULL AND score IS NOT NULL) GROUP BY 1) a USING (method)
JOIN (SELECT method, sum(p * k) / sum(p) AS ap FROM (SELECT method, score, sum(label) AS p, any_value(cp) * 1.0::DOUBLE / any_value(cn) AS k FROM (
   SELECT method, score, label, sum(label) OVER (PARTITION BY method ORDER BY score DESC) AS cp, count(*) OVER (PARTITION BY method ORDER BY score DESC) AS cn FROM caldays WHERE label IS NOT NULL AND score IS NOT NULL) GROUP BY ALL) GROUP BY 1) b USING (method)""", local=METRIC_LOCAL))
def _(spark, folder):
    roles = ("calibration", "development")
    m = evaluate.event_metrics(method_days(spark, folder, *roles), method_events(spark, folder, *roles), T, by=["method"])
    return m.select("method", *[F.col(c).cast("long").alias(c) for c in COUNT_NAMES], *[rnd(c).alias(c) for c in (*RATE_NAMES, "median_lead_days", "roc_auc", "average_precision")])


SWEEP_LOCAL = """
ths AS MATERIALIZED (SELECT method, score AS th, bool_or(label IS NOT NULL) AS valid FROM caldays WHERE score IS NOT NULL GROUP BY ALL UNION ALL SELECT DISTINCT method, 0.0::DOUBLE, FALSE FROM caldays),
grid AS MATERIALIZED (SELECT c.method, c.participant_id, c.day, c.score, t.th FROM caldays c JOIN ths t USING (method)),
""" + base.alarm_sql("grid", "n.th", "method, participant_id, th") + """,
person AS (SELECT w.method, w.th, w.participant_id, sum(CASE WHEN w.warning = 1 AND d.label = 1 THEN 1 ELSE 0 END) AS true_alarms, sum(CASE WHEN w.warning = 1 AND d.label = 0 THEN 1 ELSE 0 END) AS false_alarms,
  sum(CASE WHEN w.warning = 1 AND d.label IS NULL THEN 1 ELSE 0 END) AS unknown_alarms, sum(CASE WHEN d.label = 1 AND d.score > w.th THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN d.label = 0 AND d.score <= w.th THEN 1 ELSE 0 END) AS tn,
  sum(CASE WHEN d.label = 0 AND d.score > w.th THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN d.label = 1 AND d.score <= w.th THEN 1 ELSE 0 END) AS fn
 FROM walk w JOIN caldays d ON d.method = w.method AND d.participant_id = w.participant_id AND d.day = w.day WHERE w.i > 0 GROUP BY ALL),
sweep AS MATERIALIZED (SELECT *""" + RATES + """ FROM (SELECT p.method, p.th, any_value(t.valid) AS valid, sum(CASE WHEN true_alarms > 0 THEN 1 ELSE 0 END) AS detected, sum(true_alarms) AS true_alarms, sum(false_alarms) AS false_alarms, sum(unknown_alarms) AS unknown_alarms,
  sum(tp) AS tp, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp + tn + fp + fn) AS valid_risk_days, any_value(e.n) AS events
 FROM person p JOIN ths t ON t.method = p.method AND t.th = p.th LEFT JOIN (SELECT method, count(*) AS n FROM mevents WHERE role IN ('calibration', 'development') GROUP BY 1) e ON e.method = p.method GROUP BY p.method, p.th))"""


def sweep(spark, folder):
    roles = ("calibration", "development")
    return evaluate.threshold_sweep(method_days(spark, folder, *roles), method_events(spark, folder, *roles), by=["method"])


@query("l07_threshold_table", "L7 J16", with_ctes("caldays mevents", f"""
SELECT method, {sql_rnd('th')} AS threshold, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('tp', 'tn', 'fp', 'fn', 'false_alarms', 'unknown_alarms', 'true_alarms'))}, CAST(detected AS BIGINT) AS detected_events, {sql_rnd('risk_balanced_accuracy')} AS risk_balanced_accuracy FROM sweep""", local=SWEEP_LOCAL))
def _(spark, folder):
    s = sweep(spark, folder)
    return s.select("method", rnd("threshold").alias("threshold"), *[F.col(c).cast("long").alias(c) for c in ("tp", "tn", "fp", "fn", "false_alarms", "unknown_alarms", "true_alarms", "detected_events")], rnd("risk_balanced_accuracy").alias("risk_balanced_accuracy"))


@query("l05_calibrate", "L5 L6 T3", with_ctes("caldays mevents", f"""
SELECT method, CASE WHEN event_sensitivity > 0 THEN {sql_rnd('th')} END AS threshold, {sql_rnd('event_sensitivity')} AS event_sensitivity, {sql_rnd('false_alarms_per_30_days')} AS false_alarms_per_30_days,
 CASE WHEN event_sensitivity > 0 THEN 'research_calibrated' ELSE 'no_useful_threshold' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY event_sensitivity DESC, false_alarms_per_30_days, th DESC) AS rn FROM sweep WHERE false_alarms_per_30_days <= {BUDGET}) WHERE rn = 1""", local=SWEEP_LOCAL))
def _(spark, folder):
    return _calibrated(spark, folder).select("method", *[rnd(c).alias(c) for c in ("threshold", "event_sensitivity", "false_alarms_per_30_days")], "status")


def _calibrated(spark, folder):
    return evaluate.choose_threshold(sweep(spark, folder), budget=BUDGET, by=["method"])


@query("l07_balanced_choice", "L7 T3", with_ctes("caldays mevents", f"""
SELECT method, {sql_rnd('th')} AS threshold, {sql_rnd('risk_balanced_accuracy')} AS risk_balanced_accuracy, CAST(detected AS BIGINT) AS detected_events, {sql_rnd('false_alarms_per_30_days')} AS false_alarms_per_30_days
FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY risk_balanced_accuracy DESC, detected DESC, false_alarms_per_30_days, th DESC) AS rn FROM sweep WHERE false_alarms_per_30_days <= {BUDGET} AND risk_balanced_accuracy IS NOT NULL AND (valid OR th = 0)) WHERE rn = 1""", local=SWEEP_LOCAL))
def _(spark, folder):
    c = evaluate.choose_threshold(sweep(spark, folder), budget=BUDGET, by=["method"], objective="balanced")
    return c.select("method", rnd("threshold").alias("threshold"), rnd("risk_balanced_accuracy").alias("risk_balanced_accuracy"), F.col("detected_events").cast("long").alias("detected_events"), rnd("false_alarms_per_30_days").alias("false_alarms_per_30_days"))


@query("l08_method_comparison", "L8 J19 U4")
def _(spark, folder):
    """Thresholds chosen on development and calibration people, measured once on test people."""
    chosen = materialise(_calibrated(spark, folder).select("method", "threshold"), "chosen")
    days = method_days(spark, folder, "test").join(F.broadcast(chosen), "method")
    out = evaluate.event_metrics(days, method_events(spark, folder, "test"), F.col("threshold"), by=["method"])
    return out.join(chosen, "method")


def _resampling(spark, folder):
    """Per-person counts of both methods, indexed, with shared draws."""
    roles = ("calibration", "development")
    days = method_days(spark, folder, *roles)
    counts = evaluate.person_counts(days, method_events(spark, folder, *roles), T, by=["method"])
    idx, n = resample.person_index(counts, "participant_id", base.SEED)
    return materialise(counts.join(idx, "participant_id"), "counts"), resample.draw_cells(spark, n, REPS, base.SEED)


DRAWS_SQL = f"""
idx AS MATERIALIZED (SELECT participant_id, row_number() OVER (ORDER BY md5('{base.SEED}|' || participant_id), participant_id) AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT participant_id FROM person)),
draws AS MATERIALIZED (SELECT draw, CAST(('0x' || substring(md5('{base.SEED}|draw|' || draw || '|' || slot), 1, 8))::UBIGINT % n + 1 AS BIGINT) AS idx FROM (SELECT DISTINCT n FROM idx), (SELECT unnest(range({REPS})) AS draw) d, LATERAL (SELECT unnest(range(n)) AS slot) s),
samples AS MATERIALIZED (SELECT *{RATES} FROM (SELECT method, draw, count(lead) AS detected, {', '.join(f'sum(coalesce({c}, 0)) AS {c}' for c in ('events', 'valid_risk_days', 'true_alarms', 'false_alarms', 'tp', 'tn', 'fp', 'fn'))} FROM draws JOIN idx USING (idx) JOIN person USING (participant_id) GROUP BY ALL))"""


@query("l04_cluster_intervals", "L4", with_ctes("caldays mevents", f"""
SELECT method, metric, {sql_rnd('quantile_cont(value, 0.025)')} AS low, {sql_rnd('quantile_cont(value, 0.975)')} AS high, CAST(count(value) AS BIGINT) AS valid_replicates
FROM (SELECT method, draw, unnest(['event_sensitivity', 'false_alarms_per_30_days', 'alarm_ppv', 'risk_accuracy', 'risk_balanced_accuracy', 'risk_sensitivity', 'risk_specificity']) AS metric,
 unnest([event_sensitivity, false_alarms_per_30_days, alarm_ppv, risk_accuracy, risk_balanced_accuracy, risk_sensitivity, risk_specificity]) AS value FROM samples) GROUP BY ALL""", local=METRIC_LOCAL + "," + DRAWS_SQL))
def _(spark, folder):
    counts, draws = _resampling(spark, folder)
    sums = evaluate.with_rates(resample.resampled_sums(counts, draws, evaluate.PERSON_COUNTS, by=["method"], repetitions=REPS))
    metrics = ("event_sensitivity", "false_alarms_per_30_days", "alarm_ppv", "risk_accuracy", "risk_balanced_accuracy", "risk_sensitivity", "risk_specificity")
    return resample.percentile_interval(sums, metrics, by=["method"]).withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


@query("l04_median_lead_interval", "L4", with_ctes("caldays mevents", f"""
SELECT method, {sql_rnd('quantile_cont(m, 0.025)')} AS low, {sql_rnd('quantile_cont(m, 0.975)')} AS high, CAST(count(m) AS BIGINT) AS valid_replicates FROM (SELECT method, draw, median(lead) AS m FROM draws JOIN idx USING (idx) JOIN person USING (participant_id) GROUP BY ALL) GROUP BY 1""", local=METRIC_LOCAL + "," + DRAWS_SQL))
def _(spark, folder):
    counts, draws = _resampling(spark, folder)
    m = resample.resampled_medians(counts, draws, "lead_days", REPS, by="method")
    return m.groupBy("method").agg(rnd(F.percentile("m", 0.025)).alias("low"), rnd(F.percentile("m", 0.975)).alias("high"), F.count("m").alias("valid_replicates"))


@query("l09_paired_differences", "L9 L10", with_ctes("caldays mevents", f"""
SELECT metric, {sql_rnd('quantile_cont(value, 0.025)')} AS low, {sql_rnd('quantile_cont(value, 0.975)')} AS high, CAST(count(value) AS BIGINT) AS valid_replicates FROM (
 SELECT a.draw, unnest(['event_sensitivity', 'false_alarms_per_30_days', 'risk_balanced_accuracy']) AS metric, unnest([a.event_sensitivity - b.event_sensitivity, a.false_alarms_per_30_days - b.false_alarms_per_30_days, a.risk_balanced_accuracy - b.risk_balanced_accuracy]) AS value
 FROM samples a JOIN samples b ON a.draw = b.draw AND a.method = 'deviation' AND b.method = 'change') GROUP BY 1""", local=METRIC_LOCAL + "," + DRAWS_SQL))
def _(spark, folder):
    counts, draws = _resampling(spark, folder)
    metrics = ("event_sensitivity", "false_alarms_per_30_days", "risk_balanced_accuracy")
    sums = evaluate.with_rates(resample.resampled_sums(counts, draws, evaluate.PERSON_COUNTS, by=["method"], repetitions=REPS))
    side = lambda m, s: sums.filter(F.col("method") == m).select("draw", *[F.col(c).alias(f"{s}_{c}") for c in metrics])
    diff = side("deviation", "a").join(side("change", "b"), "draw").select("draw", *[(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(c) for c in metrics])
    return resample.percentile_interval(diff, metrics).withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))
