"""Composed protocols: sealed packets, compatibility checks, rotations, replay audits, ward and cohort studies."""

import uuid

from pyspark.sql import Window as W, functions as F

from chronowarn.functions.stats import with_row
from chronowarn.functions import clock, textkeys
from chronowarn.operators import alarm, evaluate, network, panel, panel_bootstrap, resample, validate, wards, windows
from chronowarn.plans import base, q_endpoints, q_evaluate, q_network, q_records, q_text
from chronowarn.plans.registry import cte, query, rnd, sql_direction, sql_pmod, sql_rnd, table, with_ctes
from chronowarn.session import checkpoint_root, materialise, shared_table
from chronowarn.sources import store, tabular


def _folder(spark, label):
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


@query("s11_first_known_table", "S11", "SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def _(spark, folder):
    table(spark, folder, "documents").createOrReplaceTempView("text_examples_v2")
    return tabular.first_existing_table(spark, ["text_examples_v9", "text_examples_v2"]).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("s14_relative_day_answers", "S14 W16 A16", """
WITH w AS (SELECT user_id, event_id, event_type, isodow(ts) - 1 AS w FROM events), c AS (SELECT *, CASE WHEN lag(w) OVER (PARTITION BY user_id ORDER BY event_id) <> w THEN 1 ELSE 0 END AS c FROM w),
d AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS di FROM c)
SELECT user_id, CAST(di AS BIGINT) AS day_index, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS agreed, count(DISTINCT event_type) > 1 AS conflict FROM d GROUP BY ALL""")
def _(spark, folder):
    from chronowarn.operators.measures import agreed_value
    e = table(spark, folder, "events").select("user_id", "event_id", "event_type", F.weekday("ts").alias("w"))
    return agreed_value(windows.relative_days(e, "user_id", "event_id", "w"), ["user_id", "day_index"], "event_type")


@query("s18_monitoring_inventory", "S18 V2 V3 V4", """
SELECT field, state, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'l_quantity' AS field, CASE WHEN l_quantity BETWEEN 5 AND 45 THEN 'valid' ELSE 'out_of_range' END AS state FROM lineitem
 UNION ALL SELECT 'l_tax', CASE WHEN l_tax BETWEEN 0.01 AND 1 THEN 'valid' ELSE 'out_of_range' END FROM lineitem UNION ALL SELECT 'l_returnflag', 'unreadable' FROM lineitem) GROUP BY ALL""")
def _(spark, folder):
    l = table(spark, folder, "lineitem")
    n = tabular.normalise_fields(l, "l_orderkey", {"l_quantity": (5, 45), "l_tax": (0.01, 1), "l_returnflag": (0, 1)})
    return n.groupBy("field", "state").agg(F.count(F.lit(1)).alias("n"))


@query("s23_sealed_packet", "S23", """
SELECT 'inputs' AS part, 'doc_id,lang,text' AS columns, CAST(count(*) AS BIGINT) AS rows FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'answers', 'doc_id,quality,toxic', CAST(count(*) AS BIGINT) FROM documents JOIN labels USING (doc_id)""")
def _(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    m = tabular.seal_packet(rows, _folder(spark, "packet"), {"inputs": ["doc_id", "lang", "text"], "answers": ["doc_id", "quality", "toxic"]})
    return m.select("part", "columns", "rows")


@query("s26_sessions_after_header", "S26", """
SELECT user_id, CAST(count(*) AS BIGINT) AS sessions, CAST(sum(CASE WHEN value >= 30 THEN 1 ELSE 0 END) AS BIGINT) AS long_sessions FROM events GROUP BY 1""")
def _(spark, folder):
    o = base.observations(spark, folder)
    body = o.select(F.pmod("observation_id", F.lit(8)).alias("part"), F.lit(1).alias("rank"), F.concat_ws(",", F.col("participant_id").cast("string"), F.unix_micros("start_at").cast("string"), F.unix_micros("end_at").cast("string")).alias("value"))
    head = spark.range(8).select(F.col("id").alias("part"), F.posexplode(F.array(F.lit("made by a diary"), F.lit("person,start,end"))).alias("rank", "value"))
    head = head.withColumn("rank", F.col("rank") - 1)
    path = _folder(spark, "diary")
    head.unionByName(body).repartition("part").sortWithinPartitions("part", "rank").select("part", "value").write.partitionBy("part").text(path)
    s = tabular.read_sessions(spark, path, "person,start,end", ["person", "start", "end"])
    long = F.col("end").cast("long") - F.col("start").cast("long") >= 30 * 60_000_000
    return s.groupBy(F.col("person").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("sessions"), F.count_if(long).alias("long_sessions"))


@query("s30_corpus_export", "S30 V16", with_ctes("famedges", f"""
SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(count(quality) AS BIGINT) AS labelled FROM (SELECT doc_id, CASE WHEN ('0x' || substring(md5('{base.SEED}|' || family), 1, 8))::UBIGINT / 4294967296.0::DOUBLE < 0.2 THEN 'validation' ELSE 'train' END AS split FROM fam) LEFT JOIN labels USING (doc_id) GROUP BY 1""", local=q_text.FAM_LOCAL))
def _(spark, folder):
    from chronowarn.operators.splits import component_role
    rows = q_text.families(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left").withColumn("split", component_role("family", base.SEED, 0.2))
    path = _folder(spark, "corpus")
    rows.write.partitionBy("split").parquet(path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"))


@query("v18_input_whitelist", "V18 S25", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def _(spark, folder):
    view = tabular.input_view(table(spark, folder, "events").select("event_id", "ts", "event_type"), ["event_id", "ts", "event_type"])
    return view.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("v21_artifact_compatibility", "V21", with_ctes("roles", "SELECT TRUE AS scaler_reproduced, CAST(0 AS BIGINT) AS shared_people, CAST((SELECT count(*) FROM roles WHERE role = 'reference') AS BIGINT) AS reference_people"))
def _(spark, folder):
    ref = base.reference(spark, folder)
    stored = materialise(panel.fit_scaler(ref, base.FEATURES, base.CLOCKS), "scaler").withColumn("k", F.lit(1))
    again = panel.fit_scaler(ref, base.FEATURES, base.CLOCKS).select(F.lit(1).alias("k"), F.col("mean").alias("m2"), F.col("scale").alias("s2"))
    near = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= 1e-12 * F.greatest(F.lit(1.0), F.abs(x))), lambda v: v)
    same = stored.join(again, "k").select((near("mean", "m2") & near("scale", "s2")).alias("scaler_reproduced"), F.col("n").alias("reference_people"))
    roles = base.roles(spark, folder)
    shared = roles.filter("role = 'reference'").select("participant_id").intersect(roles.filter("role <> 'reference'").select("participant_id"))
    return same.transform(with_row, shared.agg(F.count(F.lit(1)).alias("shared_people")))


@query("v25_verified_warnings", "V25 L21", with_ctes("dayscore daily", """
SELECT CAST(count(*) AS BIGINT) AS records, CAST(sum(CASE WHEN warning = 1 THEN 1 ELSE 0 END) AS BIGINT) AS warnings, CAST(0 AS BIGINT) AS unmatched, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS different FROM walk WHERE i > 0""", local=base.alarm_sql("dayscore", f"{base.THRESHOLD}::DOUBLE")))
def _(spark, folder):
    """Saved warnings joined to their records exactly once, and replayed a second time for comparison."""
    s = base.scaled(spark, folder)
    saved = materialise(alarm.replay(s, base.THRESHOLD), "warnings")
    again = alarm.replay(s, base.THRESHOLD).select("participant_id", "day", F.col("warning").alias("w2"), F.col("status").alias("s2"))
    j = s.select("participant_id", "day").join(saved, ["participant_id", "day"], "full").join(again, ["participant_id", "day"], "full")
    repeated = store.repeated_keys(saved, ["participant_id", "day"]).agg(F.count(F.lit(1)).alias("repeated"))
    return j.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("warning") == 1).alias("warnings"), F.count_if(F.col("status").isNull() | F.col("s2").isNull()).alias("unmatched"),
                 F.count_if(~(F.col("warning").eqNullSafe(F.col("w2")) & F.col("status").eqNullSafe(F.col("s2")))).alias("different")).transform(with_row, repeated)


@query("v31_both_classes", "V31", """
SELECT split, lang, metric, CAST(count(DISTINCT v) AS INTEGER) AS classes FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split, lang, 'quality' AS metric, quality AS v FROM documents JOIN labels USING (doc_id) UNION ALL SELECT CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END, lang, 'toxic', toxic FROM documents JOIN labels USING (doc_id)) GROUP BY ALL""")
def _(spark, folder):
    d = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").withColumn("split", F.when(F.col("doc_id") % 5 == 0, "validation").otherwise("train"))
    long = d.select("split", "lang", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("quality", "toxic")])).alias("z")).select("split", "lang", "z.*")
    return long.groupBy("split", "lang", "metric").agg((F.max(F.when(F.col("v") == 0, 1).otherwise(0)) + F.max(F.when(F.col("v") == 1, 1).otherwise(0))).alias("classes"))


@query("v35_protocol_binding", "V35 V36", with_ctes("dayscore", "SELECT TRUE AS bound, CAST(count(*) AS BIGINT) AS n FROM dayscore UNION ALL SELECT FALSE, CAST(count(*) AS BIGINT) FROM dayscore"))
def _(spark, folder):
    """Saved predictions are reused only where their protocol struct equals the registered one."""
    protocol = lambda days: F.struct(F.lit(base.SEED).alias("seed"), F.lit(days).alias("cooldown_days"), F.lit(base.THRESHOLD).alias("threshold"))
    s = base.scaled(spark, folder).select("participant_id", "day")
    saved = s.withColumn("protocol", F.explode(F.array(protocol(7), protocol(5))))
    return saved.withColumn("bound", F.col("protocol") == protocol(7)).groupBy("bound").agg(F.count(F.lit(1)).alias("n"))


@query("j23_exact_score_attachment", "J23 J15", """
SELECT fate, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'no_score' WHEN d.doc_id % 4 = 0 THEN 'already_scored' ELSE 'attached' END AS fate FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""")
def _(spark, folder):
    d = table(spark, folder, "documents")
    rows = d.select("doc_id", "lang", textkeys.content_key("text").alias("content"), F.when(F.col("doc_id") % 4 == 0, F.lit(1)).alias("present"))
    scores = d.join(table(spark, folder, "labels"), "doc_id").select("doc_id", "lang", textkeys.content_key("text").alias("content"), F.col("quality").alias("score"))
    j = rows.join(scores, ["doc_id", "lang", "content"], "left")
    fate = F.when(F.col("score").isNull(), "no_score").when(F.col("present") == 1, "already_scored").otherwise("attached")
    return j.groupBy(fate.alias("fate")).agg(F.count(F.lit(1)).alias("n"))


@query("a25_complete_case_cube", "A25 V38", """
WITH o AS (SELECT o_custkey AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, * FROM orders), f AS (SELECT p, count(*) AS n, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS bad FROM o WHERE k <= 4 GROUP BY 1)
SELECT CASE WHEN n < 4 THEN 'missing_occasion' WHEN bad > 0 THEN 'missing_feature' ELSE 'complete' END AS reason, CAST(count(*) AS BIGINT) AS people FROM f GROUP BY 1""")
def _(spark, folder):
    w = q_records.ward_rows(spark, folder)
    cells = w.groupBy("participant_id").agg(F.count(F.lit(1)).alias("occasions"), F.count_if(F.expr(" OR ".join(f"{c} IS NULL" for c in wards.CLOCK_FIELDS))).alias("incomplete"))
    reason = F.when(F.col("occasions") < 4, "missing_occasion").when(F.col("incomplete") > 0, "missing_feature").otherwise("complete")
    return cells.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("people"))


PANELS = {"counts": (0, 1, 2, 3), "clocks": (4, 5, 6)}


@query("a26_panel_comparison", "A26", with_ctes("zlong", f"""
SELECT 'counts_minus_clocks' AS comparison, {sql_rnd('quantile_cont(a - b, 0.025)')} AS low, {sql_rnd('quantile_cont(a - b, 0.975)')} AS high, CAST(count(*) AS BIGINT) AS draws FROM (SELECT draw, avg(a) AS a, avg(b) AS b FROM draws JOIN idx USING (idx) JOIN pm USING (participant_id) GROUP BY 1)""", local=f"""
pm AS MATERIALIZED (SELECT participant_id, avg(abs(z)) FILTER (j < 4) AS a, avg(abs(z)) FILTER (j >= 4) AS b FROM zlong GROUP BY 1),
idx AS MATERIALIZED (SELECT participant_id, row_number() OVER (ORDER BY md5('{base.SEED}|' || participant_id), participant_id) AS idx, count(*) OVER () AS n FROM pm),
draws AS MATERIALIZED (SELECT draw, CAST(('0x' || substring(md5('{base.SEED}|draw|' || draw || '|' || slot), 1, 8))::UBIGINT % n + 1 AS BIGINT) AS idx FROM (SELECT DISTINCT n FROM idx), (SELECT unnest(range(1000)) AS draw) d, LATERAL (SELECT unnest(range(n)) AS slot) s)"""))
def _(spark, folder):
    z = base.scaled(spark, folder)
    means = z.groupBy("participant_id").agg(*[F.sum(sum((F.abs(F.col("vec")[i]) for i in idx), F.lit(0.0))).alias(f"s_{n}") for n, idx in PANELS.items()], F.count(F.lit(1)).alias("d"))
    means = materialise(means.select("participant_id", *[(F.col(f"s_{n}") / (F.col("d") * len(idx))).alias(n) for n, idx in PANELS.items()], F.lit(1).alias("one")), "panels")
    idx, n = resample.person_index(means, "participant_id", base.SEED)
    sums = resample.resampled_sums(means.join(idx, "participant_id"), resample.draw_counts(spark, n, 1000, base.SEED), [*PANELS, "one"])
    diff = sums.select((F.col("counts") / F.col("one") - F.col("clocks") / F.col("one")).alias("v"))
    return diff.agg(F.lit("counts_minus_clocks").alias("comparison"), rnd(F.percentile("v", 0.025)).alias("low"), rnd(F.percentile("v", 0.975)).alias("high"), F.count("v").alias("draws"))


BOOT = 20
BOOT_PANELS = {"clocks": (0, 1, 2, 3, 4), "meals": (2, 3, 4)}
DRAWN = f"""dr AS MATERIALIZED (SELECT draw, participant_id, CAST(count(*) AS DOUBLE) AS w FROM (SELECT draw, CAST(('0x' || substring(md5('{base.SEED}|draw|' || draw || '|' || slot), 1, 8))::UBIGINT % n + 1 AS BIGINT) AS idx
 FROM (SELECT DISTINCT n FROM idx), (SELECT unnest(range({BOOT})) AS draw) d, LATERAL (SELECT unnest(range(n)) AS slot) s) JOIN idx USING (idx) GROUP BY ALL UNION ALL SELECT -1, participant_id, 1.0::DOUBLE FROM idx)"""
IDX = f"SELECT participant_id, row_number() OVER (ORDER BY md5('{base.SEED}|' || participant_id), participant_id) AS idx, count(*) OVER () AS n FROM"


@query("a24_panel_intervals", "A24 A26", f"""
WITH o AS (SELECT o_custkey AS participant_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS occasion, * FROM orders),
c AS (SELECT participant_id, occasion, CASE WHEN o_orderstatus <> 'P' THEN CAST((o_orderkey * 7) % 1440 AS DOUBLE) END AS ss, CAST((o_orderkey * 13) % 1440 AS DOUBLE) AS se, CAST((o_custkey + o_orderkey) % 1440 AS DOUBLE) AS a, CAST((o_orderkey * 3) % 1440 AS DOUBLE) AS b, CAST((o_orderkey * 5) % 1440 AS DOUBLE) AS c FROM o WHERE occasion <= 4),
full_ AS MATERIALIZED (SELECT * FROM c WHERE participant_id IN (SELECT participant_id FROM c GROUP BY 1 HAVING count(*) = 4 AND count(ss) = 4)),
idx AS MATERIALIZED ({IDX} (SELECT DISTINCT participant_id FROM full_)), {DRAWN},
x AS MATERIALIZED (SELECT participant_id, occasion, unnest([ss, se, a, b, c]) - 720 AS x, unnest(range(5)) AS j FROM full_),
m AS (SELECT draw, p.occasion, p.j AS i, q.j, sum(w) AS n, sum(w * p.x) AS sx, sum(w * q.x) AS sy, sum(w * p.x * q.x) AS sxy, sum(w * p.x * p.x) AS sxx, sum(w * q.x * q.x) AS syy
 FROM x p JOIN x q ON q.participant_id = p.participant_id AND q.occasion = p.occasion AND p.j < q.j JOIN dr ON dr.participant_id = p.participant_id GROUP BY ALL),
r AS MATERIALIZED (SELECT draw, occasion, i, j, (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) AS r FROM m),
mem(panel, i) AS (VALUES {", ".join(f"('{k}', {i})" for k, v in BOOT_PANELS.items() for i in v)}),
e AS MATERIALIZED (SELECT a.panel, r.* FROM r JOIN mem a ON a.i = r.i JOIN mem b ON b.i = r.j AND b.panel = a.panel),
g AS (SELECT panel, occasion, i, j, max(r) FILTER (draw < 0) AS pearson, quantile_cont(r, 0.025) FILTER (draw >= 0) AS low, quantile_cont(r, 0.975) FILTER (draw >= 0) AS high, count(r) FILTER (draw >= 0) AS valid_draws FROM e GROUP BY ALL),
k AS (SELECT panel, CAST(count(*) AS DOUBLE) AS k FROM mem GROUP BY 1),
pr AS (SELECT panel, occasion, draw, any_value(k) * any_value(k) / (any_value(k) + 2 * sum(r * r)) AS ratio, avg(abs(r)) AS mean_abs FROM e JOIN k USING (panel) GROUP BY ALL),
s AS (SELECT panel, occasion, max(ratio) FILTER (draw < 0) AS participation_ratio, max(mean_abs) FILTER (draw < 0) AS mean_abs_r, quantile_cont(ratio, 0.025) FILTER (draw >= 0) AS ratio_low, quantile_cont(ratio, 0.975) FILTER (draw >= 0) AS ratio_high FROM pr GROUP BY ALL)
SELECT g.panel, g.occasion, CAST(g.i AS INTEGER) AS i, CAST(g.j AS INTEGER) AS j, (SELECT CAST(count(*) AS BIGINT) FROM idx) AS people, {", ".join(f"{sql_rnd(c, 5)} AS {c}" for c in ("pearson", "low", "high"))}, CAST(valid_draws AS BIGINT) AS valid_draws,
 {", ".join(f"{sql_rnd(c, 5)} AS {c}" for c in ("participation_ratio", "mean_abs_r", "ratio_low", "ratio_high"))} FROM g JOIN s USING (panel, occasion)""")
def _(spark, folder):
    """Every edge of two panels of the same people at four occasions, with intervals from one set of draws."""
    cube = panel_bootstrap.participant_cube(q_records.ward_rows(spark, folder), "participant_id", "occasion", wards.CLOCK_FIELDS, (1, 2, 3, 4))
    cube = materialise(cube.where("reason IS NULL"), "cube")
    p = len(wards.CLOCK_FIELDS)
    corr = panel_bootstrap.resampled_correlations(cube, "participant_id", p, (1, 2, 3, 4), BOOT, base.SEED)
    summary = panel_bootstrap.panel_summary(corr, p, BOOT_PANELS, BOOT, cube.count()).select("panel", "occasion", F.col("people").cast("long").alias("people"), "participation_ratio", "mean_abs_r", "ratio_low", "ratio_high")
    both = panel_bootstrap.panel_edges(corr, p, BOOT_PANELS, BOOT).join(summary, ["panel", "occasion"])
    return both.select("panel", "occasion", "i", "j", "people", *[rnd(c, 5).alias(c) for c in ("pearson", "low", "high")], "valid_draws", *[rnd(c, 5).alias(c) for c in ("participation_ratio", "mean_abs_r", "ratio_low", "ratio_high")])


@query("l14_metric_intervals", "L14", with_ctes("mdays", f"""
, f AS MATERIALIZED (SELECT participant_id, label AS y, score AS s, CAST(score > {base.THRESHOLD} AS INTEGER) AS a FROM mdays WHERE role IN ('development', 'calibration') AND method = 'deviation' AND label IS NOT NULL AND score IS NOT NULL),
idx AS MATERIALIZED ({IDX} (SELECT DISTINCT participant_id FROM f)), {DRAWN},
b AS MATERIALIZED (SELECT draw, s, sum(w * y) AS p, sum(w * (1 - y)) AS q, sum(w * y * a) AS tp, sum(w * (1 - y) * a) AS fp FROM f JOIN dr USING (participant_id) GROUP BY ALL),
u AS (SELECT *, sum(p) OVER o AS cp, sum(q) OVER o AS cq FROM b WINDOW o AS (PARTITION BY draw ORDER BY s DESC)),
t AS (SELECT draw, sum(p) AS pos, sum(q) AS neg, sum(tp) AS tp, sum(fp) AS fp, sum(q * (cp - p / 2)) AS wins, sum(p * cp / (cp + cq)) AS area FROM u GROUP BY 1),
v AS (SELECT draw, (tp + neg - fp) / (pos + neg) AS accuracy, tp / nullif(pos, 0) AS sensitivity, (neg - fp) / nullif(neg, 0) AS specificity, (tp / nullif(pos, 0) + (neg - fp) / nullif(neg, 0)) / 2 AS balanced_accuracy, wins / nullif(pos * neg, 0) AS roc_auc, CASE WHEN neg > 0 THEN area / nullif(pos, 0) END AS average_precision FROM t),
l AS (UNPIVOT v ON accuracy, sensitivity, specificity, balanced_accuracy, roc_auc, average_precision INTO NAME metric VALUE v)
SELECT metric, {sql_rnd('max(v) FILTER (draw < 0)', 5)} AS estimate, CAST(count(v) FILTER (draw >= 0) AS BIGINT) AS valid_draws,
 CASE WHEN count(v) FILTER (draw >= 0) = {BOOT} THEN {sql_rnd('quantile_cont(v, 0.025) FILTER (draw >= 0)', 5)} END AS low, CASE WHEN count(v) FILTER (draw >= 0) = {BOOT} THEN {sql_rnd('quantile_cont(v, 0.975) FILTER (draw >= 0)', 5)} END AS high FROM l GROUP BY metric"""))
def _(spark, folder):
    """Alert and ranking metrics of the deviation score with person-resampled intervals."""
    d = q_evaluate.method_days(spark, folder, "development", "calibration").filter("method = 'deviation'").withColumn("alert", (F.col("score") > base.THRESHOLD).cast("int"))
    sampled = panel_bootstrap.resampled_metrics(d, "participant_id", "label", "score", "alert", BOOT, base.SEED)
    return panel_bootstrap.metric_intervals(sampled, BOOT).select("metric", rnd("estimate", 5).alias("estimate"), "valid_draws", rnd("low", 5).alias("low"), rnd("high", 5).alias("high"))


@query("o08_virtual_day_labels", "O8 P30", with_ctes("daily events_found", """
SELECT d.participant_id, d.day, CASE WHEN d.day >= e.onset_day THEN NULL WHEN e.onset_day - d.day BETWEEN 1 AND 7 THEN 1 WHEN d.day + 9 > z.last_day THEN NULL ELSE 0 END AS label FROM daily d JOIN (SELECT participant_id, max(day) AS last_day FROM daily GROUP BY 1) z USING (participant_id) LEFT JOIN events_found e USING (participant_id)"""))
def _(spark, folder):
    d = base.daily(spark, folder).select("participant_id", "day").withColumn("last_day", F.max("day").over(W.partitionBy("participant_id")))
    j = d.join(q_endpoints.events(spark, folder).select("participant_id", "onset_day"), "participant_id", "left")
    gap = F.datediff("onset_day", "day")
    label = F.when(F.col("day") >= F.col("onset_day"), None).when(gap.between(1, 7), 1).when(F.date_add("day", 9) > F.col("last_day"), None).otherwise(0)
    return j.select("participant_id", "day", label.alias("label"))


@query("o11_cohort_rows", "O11", with_ctes("daily roles", f"""
SELECT participant_id, day, role, {sql_rnd(sql_pmod(f"first_h + ({sql_pmod('last_h - first_h', 24)}) / 2", 24))} AS midpoint, CAST(epoch_us(((CAST(day + 1 AS TIMESTAMP) + INTERVAL 12 HOUR) AT TIME ZONE timezone)) AS BIGINT) AS issued_us
FROM daily JOIN roles USING (participant_id) WHERE {sql_pmod('last_h - first_h', 24)} > 0 AND n_events >= 2"""))
def _(spark, folder):
    d = base.daily(spark, folder).filter("n_events >= 2").withColumn("midpoint", clock.sleep_midpoint("first_h", "last_h")).filter("midpoint IS NOT NULL")
    j = d.join(base.roles(spark, folder), "participant_id")
    return j.select("participant_id", "day", "role", rnd("midpoint").alias("midpoint"), F.unix_micros(clock.local_boundary(F.date_add("day", 1), "timezone", clock.ISSUE_HOUR)).alias("issued_us"))


@query("o12_background_selection", "O12 A7", with_ctes("daily dayscore", f"""
, bad AS (SELECT DISTINCT participant_id FROM dayscore WHERE score > 2.5), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY day) AS rn FROM daily WHERE participant_id NOT IN (SELECT participant_id FROM bad)) WHERE rn <= 7),
b AS (SELECT participant_id, {sql_direction("avg(cos(mean_h*2*pi()/24))", "avg(sin(mean_h*2*pi()/24))")} AS clock, median(value_mean) AS level, count(*) AS k FROM a GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY md5('{base.SEED}|' || participant_id), participant_id) AS r, count(*) OVER () AS n FROM b)
SELECT participant_id, {sql_rnd('clock')} AS anchor_clock, {sql_rnd('level')} AS anchor_level, CAST(k AS BIGINT) AS anchors, CASE WHEN r <= floor(0.6 * n) THEN 'train' WHEN r <= floor(0.6 * n) + floor(0.2 * n) THEN 'calibration' ELSE 'test' END AS split FROM r"""))
def _(spark, folder):
    from chronowarn.functions.hashing import hash_rank
    s = base.scaled(spark, folder)
    person = s.groupBy("participant_id").agg(F.bool_or(F.coalesce(F.col("score") > 2.5, F.lit(False))).alias("bad")).filter("NOT bad")
    first = s.join(person, "participant_id", "left_semi").withColumn("rn", F.row_number().over(W.partitionBy("participant_id").orderBy("day"))).filter("rn <= 7")
    anchors = materialise(first.groupBy("participant_id").agg(clock.circular_summary("mean_h")[0].alias("c"), F.median("value_mean").alias("l"), F.count(F.lit(1)).alias("anchors")), "anchors")
    r = hash_rank(anchors, "participant_id", base.SEED)
    n, k = F.col("hash_rank_n"), F.col("hash_rank")
    split = F.when(k <= F.floor(n * 0.6), "train").when(k <= F.floor(n * 0.6) + F.floor(n * 0.2), "calibration").otherwise("test")
    return r.select("participant_id", rnd("c").alias("anchor_clock"), rnd("l").alias("anchor_level"), "anchors", split.alias("split"))


@query("l11_window_sensitivity", "L11 D3", with_ctes("zwhole spine", """
SELECT CAST(w AS INTEGER) AS window_days, CAST(m AS INTEGER) AS minimum, CAST(sum(CASE WHEN k >= m THEN 1 ELSE 0 END) AS BIGINT) AS evaluable_days FROM (SELECT c.w, c.m, s.participant_id, s.day, count(d.day) AS k FROM spine s CROSS JOIN (SELECT DISTINCT w, m FROM (VALUES (10, 8), (14, 8), (14, 11)) t(w, m)) c LEFT JOIN (SELECT DISTINCT participant_id, day FROM zwhole) d ON d.participant_id = s.participant_id AND d.day BETWEEN s.day - c.w + 1 AND s.day GROUP BY ALL) GROUP BY ALL"""))
def _(spark, folder):
    spine = materialise(windows.calendar_spine(base.scaled(spark, folder).select("participant_id", "day", "vec")), "spine")
    parts = None
    for w, m in sorted({(10, 8), (14, 8), (14, 11), (14, 11)}):
        s = network.window_scores(spine, q_network.P, q_network.MODULES, window=windows.trailing(["participant_id"], "day", w), minimum=m)
        part = s.agg(F.count_if(F.col("n_rows") >= m).alias("evaluable_days")).select(F.lit(w).alias("window_days"), F.lit(m).alias("minimum"), "evaluable_days")
        parts = part if parts is None else parts.unionByName(part)
    return parts


# ---- evaluation protocols ------------------------------------------------------------------------------

cte("testdays", "SELECT method, participant_id, day, issued_at, label, onset, score FROM mdays WHERE role = 'test'", "mdays")


@query("l15_locked_validation", "L15 L24", with_ctes("testdays mevents", f"""
SELECT t.method, {', '.join(f'CAST({"detected" if c == "detected_events" else c} AS BIGINT) AS {c}' for c in q_evaluate.COUNT_NAMES)}, {', '.join(f'{sql_rnd(c)} AS {c}' for c in q_evaluate.RATE_NAMES)} FROM (SELECT *{q_evaluate.RATES} FROM total) t""",
    local=q_evaluate.METRIC_LOCAL.replace("caldays", "testdays").replace("role IN ('calibration', 'development')", "role = 'test'")))
def _(spark, folder):
    days, events = q_evaluate.method_days(spark, folder, "test"), q_evaluate.method_events(spark, folder, "test")
    m = evaluate.event_metrics(days, events, q_evaluate.T, by=["method"], ranks=False)
    return m.select("method", *[F.col(c).cast("long").alias(c) for c in q_evaluate.COUNT_NAMES], *[rnd(c).alias(c) for c in q_evaluate.RATE_NAMES])


@query("l23_rotation_protocol", "L23 L12")
def _(spark, folder):
    """Three rotations of person folds: threshold on the calibration fold, test on the next, pooled by rotation."""
    from chronowarn.operators.splits import person_folds
    roles = ("development", "calibration", "test")
    days = q_evaluate.method_days(spark, folder, *roles).filter("method = 'deviation'").drop("method")
    folds = materialise(person_folds(days, "participant_id", base.SEED, 3), "rotation")
    rot = folds.select("participant_id", F.explode(F.array(*[F.struct(F.lit(r).alias("rotation"), F.pmod(F.col("fold") + r, F.lit(3)).alias("part")) for r in range(3)])).alias("z")).select("participant_id", "z.*")
    events = q_endpoints.events(spark, folder).select("participant_id", "onset").join(rot, "participant_id")
    rows = materialise(days.join(rot, "participant_id"), "rotated")
    cal = evaluate.threshold_sweep(rows.filter("part = 0"), events.filter("part = 0"), by=["rotation"])
    chosen = materialise(evaluate.choose_threshold(cal, budget=q_evaluate.BUDGET, by=["rotation"]).select("rotation", "threshold"), "rotation-thresholds")
    test = rows.filter("part = 1").join(F.broadcast(chosen), "rotation")
    return evaluate.event_metrics(test, events.filter("part = 1"), F.col("threshold"), by=["rotation"]).join(chosen, "rotation")


@query("l22_expanded_experiment", "L22 L8")
def _(spark, folder):
    """Four score families on one calendar: balanced threshold on development people, one test."""
    pers = network.personal_scores(q_network.perturbed(spark, folder), ("participant_id", "day"), base.FEATURES).select("participant_id", "day", "personal_score")
    spine = windows.calendar_spine(base.scaled(spark, folder).select("participant_id", "day", "vec"))
    roll = network.window_scores(spine, q_network.P, q_network.MODULES, window=windows.trailing(["participant_id"], "day", 14)).select("participant_id", "day", network.aggregate_score().alias("rolling_score"))
    both = q_evaluate.method_days(spark, folder, "development", "calibration", "test")
    wide = both.groupBy("participant_id", "day", "issued_at", "label", "onset").agg(*[F.max(F.when(F.col("method") == m, F.col("score"))).alias(m) for m in q_evaluate.METHODS])
    names = (*q_evaluate.METHODS, "personal_score", "rolling_score")
    wide = wide.join(pers, ["participant_id", "day"], "left").join(roll, ["participant_id", "day"], "left").join(base.roles(spark, folder), "participant_id")
    long = wide.select("participant_id", "role", "day", "issued_at", "label", "onset", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in names])).alias("z")).select("*", "z.method", "z.score").drop("z")
    long = materialise(long, "expanded")
    ev = q_endpoints.events(spark, folder).join(base.roles(spark, folder), "participant_id").select("participant_id", "role", "onset", F.explode(F.array(*[F.lit(m) for m in names])).alias("method"))
    sweep = evaluate.threshold_sweep(long.filter("role <> 'test'").drop("role"), ev.filter("role <> 'test'").drop("role"), by=["method"])
    chosen = materialise(evaluate.choose_threshold(sweep, budget=q_evaluate.BUDGET, by=["method"], objective="balanced").select("method", "threshold"), "expanded-thresholds")
    test = long.filter("role = 'test'").drop("role").join(F.broadcast(chosen), "method")
    return evaluate.event_metrics(test, ev.filter("role = 'test'").drop("role"), F.col("threshold"), by=["method"]).join(chosen, "method")


@query("l25_ward_protocol", "L25 O10 L14", f"""
WITH o AS (SELECT o_custkey AS participant_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS occasion, * FROM orders),
c AS (SELECT participant_id, occasion, o_totalprice, CASE WHEN o_orderstatus <> 'P' THEN CAST((o_orderkey * 7) % 1440 AS DOUBLE) END AS ss, CAST((o_orderkey * 13) % 1440 AS DOUBLE) AS se, CAST((o_custkey + o_orderkey) % 1440 AS DOUBLE) AS a, CAST((o_orderkey * 3) % 1440 AS DOUBLE) AS b, CAST((o_orderkey * 5) % 1440 AS DOUBLE) AS c FROM o WHERE occasion <= 4),
e AS (SELECT *, CASE WHEN ss IS NOT NULL AND ((se - ss) % 1440 + 1440) % 1440 > 0 THEN (ss + (((se - ss) % 1440 + 1440) % 1440) / 2) % 1440 END AS mid FROM c),
p AS (SELECT x.participant_id, max(least(abs(((x.mid - y.mid + 720) % 1440 + 1440) % 1440 - 720), (abs(((x.a - y.a + 720) % 1440 + 1440) % 1440 - 720) + abs(((x.b - y.b + 720) % 1440 + 1440) % 1440 - 720) + abs(((x.c - y.c + 720) % 1440 + 1440) % 1440 - 720)) / 3)) AS j
 FROM e x JOIN e y ON x.participant_id = y.participant_id AND x.occasion < y.occasion AND x.occasion > 1 WHERE x.mid IS NOT NULL AND y.mid IS NOT NULL GROUP BY 1),
f AS (SELECT o_totalprice AS x, CASE WHEN j >= 200 THEN 1 ELSE 0 END AS y FROM e JOIN p USING (participant_id) WHERE occasion = 1 AND participant_id IN (SELECT participant_id FROM e GROUP BY 1 HAVING count(*) = 4)),
r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rk FROM f)
SELECT CAST(count(*) AS BIGINT) AS people, CAST(sum(y) AS BIGINT) AS changed, {sql_rnd('(sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y))')} AS roc_auc FROM r""")
def _(spark, folder):
    labels = wards.person_label(q_records.ward_rows(spark, folder), 200.0).filter("label IS NOT NULL")
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    first = table(spark, folder, "orders").withColumn("rn", F.row_number().over(order)).filter("rn = 1").select(F.col("o_custkey").alias("participant_id"), F.col("o_totalprice").alias("first_score"))
    rows = materialise(labels.join(first, "participant_id"), "ward")
    auc = evaluate.rank_metrics(rows, "label", "first_score").select(rnd("roc_auc").alias("roc_auc"))
    return rows.agg(F.count(F.lit(1)).alias("people"), F.sum("label").alias("changed")).transform(with_row, auc)
