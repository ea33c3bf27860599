"""Text-corpus operators over documents, labels, benchmark and conversations."""

from pyspark.sql import functions as F

from chronowarn.functions import stats, textkeys
from chronowarn.functions.ordering import linear_quantiles, previous_row
from chronowarn.operators import corpus, evaluate, splits
from chronowarn.plans import base
from chronowarn.plans.registry import cte, dealt, query, rnd, sql_rnd, table, with_ctes
from chronowarn.session import shared_table


def _count(text, what):
    return F.length(text) - F.length(F.replace(F.col(text), F.lit(what), F.lit("")))


def documents(spark, folder):
    d = table(spark, folder, "documents")
    words, lines, stops = _count("text", " ") + 1, _count("text", "\n") + 1, _count("text", ".")
    return d.select("doc_id", "lang", "source", "text", words.alias("words"), lines.alias("lines"), stops.alias("stops"), "n_chars")


cte("docs", """SELECT doc_id, lang, source, text, length(text) - length(replace(text, ' ', '')) + 1 AS words, length(text) - length(replace(text, chr(10), '')) + 1 AS lines,
 length(text) - length(replace(text, '.', '')) AS stops, n_chars FROM documents""")


def scored(spark, folder):
    """Two metrics per document: measured value and an estimate from another count, both 0..100."""
    return shared_table(spark, folder, "scored_docs", lambda: _scored(spark, folder))


def _scored(spark, folder):
    d = documents(spark, folder)
    cap = lambda c: F.least(F.lit(100.0), c.cast("double"))
    m = F.array(F.struct(F.lit("length").alias("metric"), cap(F.col("n_chars") / 40).alias("truth"), cap(F.col("words") / 8).alias("predicted")),
                F.struct(F.lit("lines").alias("metric"), cap(F.col("lines") * 4).alias("truth"), cap(F.col("stops") * 3).alias("predicted")))
    return d.select("doc_id", "lang", "source", F.explode(m).alias("z")).select("doc_id", "lang", "source", "z.*")


cte("sdocs", """SELECT doc_id, lang, source, 'length' AS metric, least(100.0::DOUBLE, n_chars / 40.0::DOUBLE) AS truth, least(100.0::DOUBLE, words / 8.0::DOUBLE) AS predicted FROM docs
UNION ALL SELECT doc_id, lang, source, 'lines', least(100.0::DOUBLE, lines * 4), least(100.0::DOUBLE, stops * 3) FROM docs""", "docs")
ERR = ("mae", "rmse", "bias", "within_5", "within_10", "truth_sd", "prediction_sd", "pearson", "concordance", "sd_ratio")
ERR_SQL = """count(*) AS n, avg(abs(predicted - truth)) AS mae, sqrt(avg((predicted - truth)**2)) AS rmse, avg(predicted - truth) AS bias, avg(CASE WHEN abs(predicted - truth) <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS within_5,
 avg(CASE WHEN abs(predicted - truth) <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS within_10, stddev_pop(truth) AS truth_sd, stddev_pop(predicted) AS prediction_sd, CASE WHEN stddev_pop(truth) > 0 AND stddev_pop(predicted) > 0 THEN covar_pop(truth, predicted) / (stddev_pop(truth) * stddev_pop(predicted)) END AS pearson,
 2 * covar_pop(truth, predicted) / (stddev_pop(truth)**2 + stddev_pop(predicted)**2 + avg(predicted - truth)**2) AS concordance, CASE WHEN stddev_pop(truth) > 0 THEN stddev_pop(predicted) / stddev_pop(truth) END AS sd_ratio"""
RANKED = """(SELECT *, rank() OVER (PARTITION BY metric{by} ORDER BY truth) + (count(*) OVER (PARTITION BY metric{by}, truth) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY metric{by} ORDER BY predicted) + (count(*) OVER (PARTITION BY metric{by}, predicted) - 1) / 2.0::DOUBLE AS rb FROM sdocs)"""


@query("a32_error_set", "A32 W9", with_ctes("sdocs", f"""
SELECT metric, lang, CAST(n AS BIGINT) AS n, {', '.join(f'{sql_rnd(c, 5)} AS {c}' for c in ERR)}, {sql_rnd('sp', 5)} AS spearman FROM (SELECT metric, lang, {ERR_SQL}, corr(ra, rb) AS sp FROM {RANKED.format(by=', lang')} GROUP BY ALL)"""))
def _(spark, folder):
    e = evaluate.error_set(scored(spark, folder), "truth", "predicted", ["metric", "lang"])
    return e.select("metric", "lang", "n", *[rnd(c, 5).alias(c) for c in (*ERR, "spearman")])


@query("a33_constant_baselines", "A33", with_ctes("sdocs", f"SELECT metric, {sql_rnd('avg(truth)', 5)} AS mean_baseline, {sql_rnd('median(truth)', 5)} AS median_baseline FROM sdocs GROUP BY 1"))
def _(spark, folder):
    # truth is a capped count over forty: few distinct values, so the exact median keeps a small table
    return scored(spark, folder).groupBy("metric").agg(rnd(F.avg("truth"), 5).alias("mean_baseline"), rnd(F.median("truth"), 5).alias("median_baseline"))


@query("a34_longitudinal_changes", "A34", with_ctes("sdocs", f"""
, ch AS (SELECT source, metric, doc_id, truth - lag(truth) OVER w AS truth, predicted - lag(predicted) OVER w AS predicted, doc_id - lag(doc_id) OVER w AS gap FROM sdocs WINDOW w AS (PARTITION BY source, metric ORDER BY doc_id)),
c AS (SELECT * FROM ch WHERE gap IS NOT NULL)
SELECT p.metric, CAST(p.n AS BIGINT) AS n, {sql_rnd('p.mae', 5)} AS mae, {sql_rnd('p.rmse', 5)} AS rmse, {sql_rnd('p.bias', 5)} AS bias, {sql_rnd('p.pearson', 5)} AS pearson, {sql_rnd('p.agree', 5)} AS direction_agreement, CAST(p.g0 AS BIGINT) AS gap_minimum, CAST(p.g1 AS BIGINT) AS gap_maximum, {sql_rnd('m.macro', 5)} AS person_macro_mae, CAST(m.people AS BIGINT) AS people
FROM (SELECT metric, {ERR_SQL}, avg(CASE WHEN truth <> 0 THEN CASE WHEN sign(truth) = sign(predicted) THEN 1.0::DOUBLE ELSE 0 END END) AS agree, min(gap) AS g0, max(gap) AS g1 FROM c GROUP BY 1) p
JOIN (SELECT metric, avg(mae) AS macro, count(*) AS people FROM (SELECT source, metric, avg(abs(predicted - truth)) AS mae FROM c GROUP BY ALL) GROUP BY 1) m USING (metric)"""))
def _(spark, folder):
    s = previous_row(scored(spark, folder), ["source", "metric"], "doc_id", ["doc_id", "truth", "predicted"]).filter("prev IS NOT NULL")
    c = s.select("source", "metric", (F.col("truth") - F.col("prev.truth")).alias("truth"), (F.col("predicted") - F.col("prev.predicted")).alias("predicted"), (F.col("doc_id") - F.col("prev.doc_id")).alias("gap"))
    pooled = evaluate.error_set(c, "truth", "predicted", ["metric"], ranks=False)
    agree = F.when(F.col("truth") != 0, (F.signum("truth") == F.signum("predicted")).cast("double"))
    extra = c.groupBy("metric").agg(rnd(F.avg(agree), 5).alias("direction_agreement"), F.min("gap").alias("gap_minimum"), F.max("gap").alias("gap_maximum"))
    macro = c.groupBy("source", "metric").agg(F.avg(F.abs(F.col("predicted") - F.col("truth"))).alias("m")).groupBy("metric").agg(rnd(F.avg("m"), 5).alias("person_macro_mae"), F.count(F.lit(1)).alias("people"))
    return pooled.select("metric", "n", *[rnd(k, 5).alias(k) for k in ("mae", "rmse", "bias", "pearson")]).join(extra, "metric").join(macro, "metric")


@query("a35_within_person_network", "A35", with_ctes("sdocs", f"""
SELECT source, CAST(count(*) AS BIGINT) AS paired_instants, {sql_rnd('corr(a.truth, b.truth)', 5)} AS reference_correlation, {sql_rnd('corr(a.predicted, b.predicted)', 5)} AS estimate_correlation, {sql_rnd('corr(a.predicted, b.predicted) - corr(a.truth, b.truth)', 5)} AS correlation_error
FROM sdocs a JOIN sdocs b USING (doc_id, source) WHERE a.metric < b.metric GROUP BY 1 HAVING count(*) >= 3"""))
def _(spark, folder):
    d = scored(spark, folder)
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    wide = d.groupBy("source", "doc_id").agg(pick("length", "truth").alias("ta"), pick("lines", "truth").alias("tb"), pick("length", "predicted").alias("pa"), pick("lines", "predicted").alias("pb"))
    r, e = stats.safe_corr("ta", "tb"), stats.safe_corr("pa", "pb")
    return wide.groupBy("source").agg(F.count(F.lit(1)).alias("paired_instants"), rnd(r, 5).alias("reference_correlation"), rnd(e, 5).alias("estimate_correlation"), rnd(e - r, 5).alias("correlation_error")).filter("paired_instants >= 3")


def judged(spark, folder):
    """Labelled documents with an acceptance probability from their word count and an ordinal level."""
    return shared_table(spark, folder, "judged", lambda: _judged(spark, folder))


def _judged(spark, folder):
    l = table(spark, folder, "labels")
    return documents(spark, folder).join(l, "doc_id").select("doc_id", "lang", "source", "quality", "toxic", (F.col("words") / (F.col("words") + 200.0)).alias("p"), (F.col("quality") * 2 + F.col("toxic")).alias("level"))


cte("judged", "SELECT doc_id, lang, source, quality, toxic, words / (words + 200.0::DOUBLE) AS p, quality * 2 + toxic AS level FROM docs JOIN labels USING (doc_id)", "docs")
AUC_SQL = """(SELECT {by}, CASE WHEN sum({y}) > 0 AND sum(1 - {y}) > 0 THEN (sum(CASE WHEN {y} = 1 THEN rk ELSE 0 END) - sum({y}) * (sum({y}) + 1) / 2.0::DOUBLE) / (sum({y}) * sum(1 - {y})) END AS auc FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0::DOUBLE AS rk FROM judged) GROUP BY {by})"""
AP_SQL = """(SELECT {by}, CASE WHEN sum(pp) > 0 AND sum(nn) > 0 THEN sum(pp * k) / sum(pp) END AS ap FROM (SELECT {by}, p, sum({y}) AS pp, sum(1 - {y}) AS nn, any_value(cp) * 1.0::DOUBLE / any_value(cn) AS k FROM (SELECT *, sum({y}) OVER (PARTITION BY {by} ORDER BY p DESC) AS cp, count(*) OVER (PARTITION BY {by} ORDER BY p DESC) AS cn FROM judged) GROUP BY {by}, p) GROUP BY {by})"""


@query("a37_binary_metrics", "A37 A39", with_ctes("judged", f"""
SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(quality) AS BIGINT) AS positive, CAST(sum(1 - quality) AS BIGINT) AS negative, {sql_rnd('avg((quality - p)**2)')} AS brier, {sql_rnd('avg(-CASE WHEN quality = 1 THEN ln(p) ELSE ln(1 - p) END)')} AS log_loss, {sql_rnd('any_value(auc)')} AS roc_auc
FROM judged JOIN {AUC_SQL.format(by='lang', y='quality')} USING (lang) GROUP BY 1"""))
def _(spark, folder):
    b = evaluate.binary_metrics(judged(spark, folder), "quality", "p", ["lang"])
    return b.select("lang", "n", "positive", "negative", rnd("brier").alias("brier"), rnd("log_loss").alias("log_loss"), rnd("roc_auc").alias("roc_auc"))


@query("a38_selective_metrics", "A38 A52", with_ctes("judged", f"""
SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(a) AS BIGINT) AS accepted, CAST(sum(a * quality) AS BIGINT) AS accepted_supported, CAST(sum(a * (1 - quality)) AS BIGINT) AS false_acceptances, CAST(sum((1 - a) * quality) AS BIGINT) AS missed_supported,
 {sql_rnd('sum(a) / CAST(count(*) AS DOUBLE)')} AS coverage, {sql_rnd('sum(a * quality) / CAST(nullif(sum(a), 0) AS DOUBLE)')} AS precision, {sql_rnd('sum(a * quality) / CAST(nullif(sum(quality), 0) AS DOUBLE)')} AS supported_recall
FROM (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS a FROM judged) GROUP BY 1"""))
def _(spark, folder):
    s = evaluate.selective_metrics(judged(spark, folder), "quality", "p", F.lit(0.5), ["lang"])
    return s.select("lang", "n", "accepted", "accepted_supported", "false_acceptances", "missed_supported", *[rnd(c).alias(c) for c in ("coverage", "precision", "supported_recall")])


@query("a40_average_precision", "A40 A44", with_ctes("judged", f"""
SELECT lang, {sql_rnd('auc')} AS roc_auc, {sql_rnd('ap')} AS average_precision, {sql_rnd('q1')} AS lower_quartile, {sql_rnd('q2')} AS median, {sql_rnd('q3')} AS upper_quartile
FROM {AUC_SQL.format(by='lang', y='toxic')} JOIN {AP_SQL.format(by='lang', y='toxic')} USING (lang) JOIN (SELECT lang, quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.5) AS q2, quantile_cont(p, 0.75) AS q3 FROM judged GROUP BY 1) USING (lang)"""))
def _(spark, folder):
    j = judged(spark, folder)
    r = evaluate.rank_metrics(j, "toxic", "p", ["lang"])
    q = linear_quantiles(j, "p", {"lower_quartile": 0.25, "median": 0.5, "upper_quartile": 0.75}, ["lang"])
    q = q.select("lang", *[rnd(c).alias(c) for c in ("lower_quartile", "median", "upper_quartile")])
    return r.select("lang", rnd("roc_auc").alias("roc_auc"), rnd("average_precision").alias("average_precision")).join(q, "lang")


@query("a43_ordinal_report", "A43", with_ctes("judged", f"""
SELECT a.lang, {sql_rnd("sum(sign(a.level - b.level) * sign(a.p - b.p)) / sqrt(sum(abs(sign(a.level - b.level))) * sum(abs(sign(a.p - b.p))))")} AS kendall_tau_b FROM judged a JOIN judged b ON a.lang = b.lang AND a.doc_id < b.doc_id GROUP BY 1"""))
def _(spark, folder):
    return evaluate.kendall_tau_b(judged(spark, folder), "level", "p", (0, 1, 2, 3), ["lang"]).select("lang", rnd("kendall_tau_b").alias("kendall_tau_b"))


@query("a43_ordinal_levels", "A43", with_ctes("judged", f"""
SELECT level, CAST(count(*) AS BIGINT) AS n, {sql_rnd('avg(p)')} AS mean_prediction, {sql_rnd('quantile_cont(p, 0.25)')} AS q1, {sql_rnd('quantile_cont(p, 0.5)')} AS q2, {sql_rnd('quantile_cont(p, 0.75)')} AS q3 FROM judged GROUP BY 1"""))
def _(spark, folder):
    j = judged(spark, folder)
    q = linear_quantiles(j, "p", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, ["level"]).select("level", *[rnd(c).alias(c) for c in ("q1", "q2", "q3")])
    return j.groupBy("level").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("p")).alias("mean_prediction")).join(q, "level")


@query("t10_empirical_threshold", "T10", with_ctes("judged", f"""
, c AS (SELECT lang, p, sum(q) OVER (PARTITION BY lang ORDER BY p DESC) AS k, sum(n) OVER (PARTITION BY lang ORDER BY p DESC) AS m FROM (SELECT lang, p, sum(quality) AS q, count(*) AS n FROM judged GROUP BY lang, p))
SELECT lang, {sql_rnd('p')} AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k DESC, m - k, p DESC) AS rn FROM c WHERE k / CAST(m AS DOUBLE) >= 0.6) WHERE rn = 1"""))
def _(spark, folder):
    return evaluate.empirical_threshold(judged(spark, folder), "quality", "p", 0.6, ["lang"]).select("lang", rnd("threshold").alias("threshold"))


@query("t10_gap_midpoint", "T10", with_ctes("judged", f"""
, c AS (SELECT lang, p, sum(q) OVER (PARTITION BY lang ORDER BY p DESC) AS k, sum(n) OVER (PARTITION BY lang ORDER BY p DESC) AS m FROM (SELECT lang, p, sum(quality) AS q, count(*) AS n FROM judged GROUP BY lang, p)),
b AS (SELECT lang, p FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k DESC, m - k, p DESC) AS rn FROM c WHERE k / CAST(m AS DOUBLE) >= 0.6) WHERE rn = 1)
SELECT lang, coalesce({sql_rnd('(b.p + (SELECT max(j.p) FROM judged j WHERE j.lang = b.lang AND j.p < b.p)) / 2')}, 0) AS threshold FROM b"""))
def _(spark, folder):
    return evaluate.empirical_threshold(judged(spark, folder), "quality", "p", 0.6, ["lang"], midpoint=True).select("lang", rnd("threshold").alias("threshold"))


# ---- identities and families ---------------------------------------------------------------------

def sql_identity(x):
    return f"lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]+', '', 'g'))"


def sql_template(x):
    return f"lower(regexp_replace(regexp_replace({x}, '[0-9]+(?:[.:：点][0-9]+)*', '#', 'g'), '[^\\p{{L}}\\p{{N}}_#]+', '', 'g'))"


@query("p20_text_identities", "P20 P21 P22", f"""
SELECT doc_id, md5({sql_identity('text')}) AS identity, md5({sql_template('text')}) AS template, sha256(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g')) AS content FROM documents""")
def _(spark, folder):
    d = dealt(table(spark, folder, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.md5(textkeys.text_identity("text")).alias("identity"), F.md5(textkeys.template_identity("text")).alias("template"), textkeys.content_key("text").alias("content"))


def family_keys(spark, folder):
    return shared_table(spark, folder, "family_keys", lambda: _family_keys(spark, folder))


def _family_keys(spark, folder):
    d = dealt(table(spark, folder, "documents").select("doc_id", "lang", "source", "text"))
    return textkeys.template_parts(d, "text").select("doc_id", "lang", "source", *[F.md5(c).alias(c) for c in ("whole", "head", "tail")])


def families(spark, folder):
    return shared_table(spark, folder, "families", lambda: corpus.connected_families(family_keys(spark, folder), "doc_id", ["whole", "head", "tail"]))


cte("famkeys", f"""SELECT doc_id, source, lang, md5({sql_template('text')}) AS whole, md5({sql_template("string_split(text, chr(10))[1]")}) AS head, md5({sql_template("string_split(text, chr(10))[-1]")}) AS tail FROM documents""")
cte("famedges", "SELECT doc_id, 'w' || whole AS k FROM famkeys UNION SELECT doc_id, 'h' || head FROM famkeys UNION SELECT doc_id, 't' || tail FROM famkeys", "famkeys")
FAM_LOCAL = "nb AS MATERIALIZED (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM famedges a JOIN famedges b USING (k)), reach AS (SELECT x, y FROM nb UNION SELECT r.x, n.y FROM reach r JOIN nb n ON n.x = r.y), fam AS (SELECT x AS doc_id, min(y) AS family FROM reach GROUP BY 1)"


@query("j17_connected_families", "J17", with_ctes("famedges", "SELECT doc_id, family FROM fam", local=FAM_LOCAL))
def _(spark, folder):
    return families(spark, folder)


@query("t08_component_split", "T8 J17", with_ctes("famedges", f"SELECT doc_id, family, CASE WHEN ('0x' || substring(md5('{base.SEED}|' || family), 1, 8))::UBIGINT / 4294967296.0::DOUBLE < 0.2 THEN 'validation' ELSE 'train' END AS split FROM fam", local=FAM_LOCAL))
def _(spark, folder):
    f = families(spark, folder)
    return f.select("doc_id", "family", splits.component_role("family", base.SEED, 0.2).alias("split"))


@query("t05_one_per_template", "T5", with_ctes("famkeys", f"""
SELECT doc_id, CASE WHEN min(source) OVER w <> max(source) OVER w THEN 'conflicting_scores' WHEN row_number() OVER (PARTITION BY lang, whole ORDER BY md5('{base.SEED}|' || doc_id), doc_id) = 1 THEN 'kept' ELSE 'duplicate' END AS fate, CAST(count(*) OVER w AS BIGINT) AS copies FROM famkeys WINDOW w AS (PARTITION BY lang, whole)"""))
def _(spark, folder):
    return corpus.one_per_key(family_keys(spark, folder), ["lang", "whole"], "doc_id", base.SEED, "source").select("doc_id", "fate", "copies")


@query("v11_leakage_check", "V11", with_ctes("famkeys", """
, s AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM famkeys)
SELECT key, value, min(split) AS first_split, max(split) AS last_split FROM (SELECT split, 'whole' AS key, whole AS value FROM s UNION ALL SELECT split, 'head', head FROM s) GROUP BY ALL HAVING min(split) <> max(split)"""))
def _(spark, folder):
    d = family_keys(spark, folder).withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train"))
    return corpus.leaking_groups(d, "split", ["whole", "head"])


@query("j20_exposed_rows", "J20 U5 V14 V32", with_ctes("famkeys", f"""
, b AS (SELECT md5({sql_template('text')}) AS whole, md5({sql_template("string_split(text, chr(10))[1]")}) AS head FROM benchmark UNION SELECT whole, head FROM famkeys WHERE source = 'src0')
SELECT doc_id, string_agg(key, ',' ORDER BY key) AS shared FROM (SELECT doc_id, 'whole' AS key FROM famkeys WHERE source <> 'src0' AND whole IN (SELECT whole FROM b) UNION SELECT doc_id, 'head' FROM famkeys WHERE source <> 'src0' AND head IN (SELECT head FROM b)) GROUP BY 1"""))
def _(spark, folder):
    rows = family_keys(spark, folder)
    b = table(spark, folder, "benchmark")
    seen = b.select(F.md5(textkeys.template_identity("text")).alias("whole"), F.md5(textkeys.template_identity(F.get(F.split("text", "\n"), F.lit(0)))).alias("head"))
    seen = seen.unionByName(rows.filter("source = 'src0'").select("whole", "head"))
    return corpus.exposed_keys(rows.filter("source <> 'src0'"), seen, ["whole", "head"], "doc_id")


@query("j08_cohort_exclusion", "J8", with_ctes("famkeys", """
SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'cohort_person' WHEN whole IN (SELECT whole FROM famkeys WHERE source IN ('src0', 'src1')) THEN 'cohort_template' END AS reason FROM famkeys"""))
def _(spark, folder):
    rows = family_keys(spark, folder)
    cohort = rows.filter(F.col("source").isin("src0", "src1"))
    people = cohort.select("source").distinct().withColumn("p", F.lit(1))
    templates = cohort.select("whole").distinct().withColumn("t", F.lit(1))
    j = rows.join(F.broadcast(people), "source", "left").join(templates, "whole", "left")
    return j.select("doc_id", F.when(F.col("p") == 1, "cohort_person").when(F.col("t") == 1, "cohort_template").alias("reason"))


@query("t07_stratified_roles", "T7", f"""
SELECT source, lang, CASE WHEN r <= k THEN 'test' WHEN r <= 2 * k THEN 'validation' ELSE 'train' END AS role FROM (SELECT *, CASE WHEN n >= 5 THEN greatest(1, CAST(round_even(n * 0.1, 0) AS INTEGER)) ELSE 0 END AS k FROM (
 SELECT source, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('{base.SEED}|' || source), source) AS r, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT DISTINCT source, lang FROM documents)))""")
def _(spark, folder):
    return splits.stratified_roles(table(spark, folder, "documents"), "source", "lang", base.SEED)


@query("t09_person_folds", "T9 M9", f"""
SELECT o_custkey, stratum, CAST((row_number() OVER (PARTITION BY stratum ORDER BY md5('{base.SEED}|' || o_custkey), o_custkey) - 1) % 5 AS INTEGER) AS fold FROM (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS stratum FROM orders GROUP BY 1)""")
def _(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", (F.col("o_orderstatus") == "P").cast("int").alias("y"))
    return splits.grouped_stratified_folds(o, "o_custkey", "y", base.SEED, 5)


@query("t04_blind_review_sample", "T4 P29", with_ctes("sdocs", f"""
, b AS (SELECT metric, doc_id, CAST(least(floor(truth / 20), 4) AS INTEGER) AS band, md5('{base.SEED}|' || metric || '|' || doc_id) AS h FROM sdocs),
t AS (SELECT *, row_number() OVER (PARTITION BY metric, band ORDER BY h, doc_id) AS turn FROM b)
SELECT metric, doc_id, band, CAST(turn AS INTEGER) AS turn, CAST(pos AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY turn, band) AS pos FROM t) WHERE pos <= 24"""))
def _(spark, folder):
    s = scored(spark, folder).withColumn("band", textkeys.score_band("truth"))
    return corpus.round_robin_sample(s, "metric", "band", "doc_id", 24, base.SEED).select("metric", "doc_id", "band", "turn", "position")


@query("a29_coverage_report", "A29 P29", with_ctes("sdocs", f"""
SELECT lang, metric, CAST(count(*) AS BIGINT) AS rows, CAST(count(v) AS BIGINT) AS labelled, {sql_rnd('min(v)')} AS minimum, {sql_rnd('max(v)')} AS maximum, CAST(count(*) FILTER (v = 0) AS BIGINT) AS zero, CAST(count(*) FILTER (v = 100) AS BIGINT) AS hundred,
 {', '.join(f'CAST(count(*) FILTER (least(floor(v / 20), 4) = {b}) AS BIGINT) AS band{b}' for b in range(5))}, CAST(count(DISTINCT CASE WHEN v IS NOT NULL THEN source END) AS BIGINT) AS people
FROM (SELECT s.*, CASE WHEN l.doc_id IS NOT NULL THEN truth END AS v FROM sdocs s LEFT JOIN labels l USING (doc_id)) GROUP BY ALL"""))
def _(spark, folder):
    l = table(spark, folder, "labels").select("doc_id", F.lit(1).alias("has"))
    s = scored(spark, folder).join(l, "doc_id", "left").withColumn("v", F.when(F.col("has") == 1, F.col("truth")))
    c = corpus.coverage(s, "lang", "metric", "v", "source")
    return c.withColumn("minimum", F.round("minimum", 6)).withColumn("maximum", F.round("maximum", 6))


@query("a30_support_patterns", "A30 P25 V17", """
SELECT lang, pattern, CAST(count(*) AS BIGINT) AS n FROM (SELECT lang, coalesce(CAST(quality AS VARCHAR), '?') || coalesce(CAST(toxic AS VARCHAR), '?') AS pattern FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY ALL""")
def _(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "lang").join(table(spark, folder, "labels"), "doc_id", "left")
    state = lambda c: F.when(F.col(c) == 1, "supported_unscored").when(F.col(c) == 0, "insufficient_evidence").otherwise("unreviewed")
    mark = lambda c: F.coalesce(textkeys.evidence_target(state(c), F.lit(None).cast("double")).cast("string"), F.lit("?"))
    return d.select("lang", F.concat(mark("quality"), mark("toxic")).alias("pattern")).groupBy("lang", "pattern").agg(F.count(F.lit(1)).alias("n"))


@query("a31_readiness_blockers", "A31", with_ctes("docs", """
SELECT source, lang AS missing FROM (SELECT source, lang, count(l.doc_id) AS k FROM docs d LEFT JOIN labels l USING (doc_id) GROUP BY ALL) WHERE k = 0"""))
def _(spark, folder):
    l = table(spark, folder, "labels").select("doc_id", F.lit(1.0).alias("v"))
    d = documents(spark, folder).join(l, "doc_id", "left")
    c = corpus.coverage(d, "source", "lang", "v", "doc_id")
    return c.filter("labelled = 0").select("source", F.col("lang").alias("missing"))


@query("a48_drift_from_anchor", "A48 A49", """
SELECT role, CAST(count(*) AS BIGINT) AS pairs, round(avg(abs(n - a)), 5) + 0.0 AS mean_drift, CAST(max(abs(n - a)) AS DOUBLE) AS largest_drift FROM (SELECT role, turn, CAST(length(text) AS DOUBLE) AS n, first_value(CAST(length(text) AS DOUBLE)) OVER w AS a, min(turn) OVER (PARTITION BY conv_id) AS t0 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE turn > t0 GROUP BY 1""")
def _(spark, folder):
    c = table(spark, folder, "conversations").withColumn("n", F.length("text").cast("double"))
    return corpus.fixed_anchor_drift(c, "conv_id", "turn", "n", "role").withColumn("mean_drift", F.round("mean_drift", 5))


@query("a49_directional_pairs", "A49", """
SELECT a.role AS lower_role, b.role AS higher_role, CAST(count(*) AS BIGINT) AS pairs, CAST(sum(CASE WHEN length(b.text) > length(a.text) THEN 1 ELSE 0 END) AS BIGINT) AS ordered FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 GROUP BY ALL""")
def _(spark, folder):
    c = table(spark, folder, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    low = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("lower_role"), F.col("n").alias("low"))
    j = low.join(c.withColumnRenamed("role", "higher_role"), ["conv_id", "turn"])
    return j.groupBy("lower_role", "higher_role").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("n") > F.col("low")).alias("ordered"))


@query("a51_person_pairs", "A51", with_ctes("sdocs", """
SELECT metric, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY metric, source ORDER BY sha256(metric || '|' || doc_id), doc_id) AS rn FROM sdocs) WHERE rn = 1"""))
def _(spark, folder):
    key = F.struct(F.sha2(F.concat_ws("|", "metric", "doc_id"), 256), F.col("doc_id"))
    return scored(spark, folder).groupBy("metric", "source").agg(F.min_by("doc_id", key).alias("doc_id"))


@query("a53_guard_by_family", "A53 A52", with_ctes("judged", f"""
SELECT lang, source, CAST(count(*) AS BIGINT) AS n, {sql_rnd('avg((quality - p)**2)')} AS brier, CAST(sum(CASE WHEN p >= 0.5 AND quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS false_acceptances FROM judged GROUP BY GROUPING SETS ((lang), (lang, source))"""))
def _(spark, folder):
    j = judged(spark, folder)
    g = j.groupingSets([["lang"], ["lang", "source"]], "lang", "source")
    return g.agg(F.count(F.lit(1)).alias("n"), rnd(F.avg((F.col("quality") - F.col("p")) ** 2)).alias("brier"), F.count_if((F.col("p") >= 0.5) & (F.col("quality") == 0)).alias("false_acceptances")).select("lang", "source", "n", "brier", "false_acceptances")


@query("a36_text_report", "A36", with_ctes("sdocs", f"""
SELECT metric, {sql_rnd('avg(mae)', 5)} AS macro_mae, {sql_rnd('avg(rmse)', 5)} AS macro_rmse, CAST(sum(n) AS BIGINT) AS n FROM (SELECT metric, lang, {ERR_SQL} FROM sdocs GROUP BY ALL) GROUP BY ROLLUP (metric)"""))
def _(spark, folder):
    e = evaluate.error_set(scored(spark, folder), "truth", "predicted", ["metric", "lang"], ranks=False)
    return e.rollup("metric").agg(rnd(F.avg("mae"), 5).alias("macro_mae"), rnd(F.avg("rmse"), 5).alias("macro_rmse"), F.sum("n").alias("n"))


@query("j18_rater_comparison", "J18 A50", """
SELECT doc_id, a IS NULL OR b IS NULL AS missing_side, abs(a - b) AS difference, coalesce(abs(a - b) > 0, TRUE) AS adjudicate FROM (SELECT doc_id, quality * 100 AS a FROM labels) FULL JOIN (SELECT doc_id, CASE WHEN n_chars > 1000 THEN 100 ELSE 0 END AS b FROM documents) USING (doc_id)""")
def _(spark, folder):
    a = table(spark, folder, "labels").select("doc_id", (F.col("quality") * 100).alias("a"))
    b = table(spark, folder, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, 100).otherwise(0).alias("b"))
    j = a.join(b, "doc_id", "full")
    d = F.abs(F.col("a") - F.col("b"))
    return j.select("doc_id", (F.col("a").isNull() | F.col("b").isNull()).alias("missing_side"), d.alias("difference"), F.coalesce(d > 0, F.lit(True)).alias("adjudicate"))


@query("p26_qualified_scores", "P26", with_ctes("judged", """
SELECT doc_id, CASE WHEN p >= 0.5 THEN round(p * 100, 5) END AS score, CASE WHEN p < 0.5 THEN 'evidence_below_threshold' END AS reason FROM judged"""))
def _(spark, folder):
    j = judged(spark, folder)
    ok = F.col("p") >= 0.5
    return j.select("doc_id", F.when(ok, rnd(F.col("p") * 100, 5)).alias("score"), F.when(~ok, "evidence_below_threshold").alias("reason"))


@query("p27_monotone_correction", "P27", with_ctes("sdocs", f"""
SELECT doc_id, metric, {sql_rnd("predicted * 0.4::DOUBLE + 0.6::DOUBLE * CASE WHEN predicted <= 10 THEN 5 WHEN predicted >= 90 THEN 95 WHEN predicted < 40 THEN 5 + 40 * (predicted - 10) / 30 ELSE 45 + 50 * (predicted - 40) / 50 END")} AS corrected FROM sdocs"""))
def _(spark, folder):
    xs, ys = F.array(*[F.lit(v) for v in (10.0, 40.0, 90.0)]), F.array(*[F.lit(v) for v in (5.0, 45.0, 95.0)])
    return scored(spark, folder).select("doc_id", "metric", rnd(textkeys.apply_curve("predicted", xs, ys, 0.6)).alias("corrected"))


@query("p23_mention_filter", "P23 P24", """
SELECT doc_id, metric, CASE WHEN ok THEN v END AS score, CASE WHEN NOT ok THEN 'disputed' ELSE 'supported' END AS state FROM (
 SELECT doc_id, 'contact' AS metric, CAST(n_chars AS DOUBLE) AS v, regexp_matches(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+') AS ok FROM documents UNION ALL SELECT doc_id, 'licence', CAST(n_chars AS DOUBLE), regexp_matches(lower(text), 'licen[cs]e') FROM documents)""")
def _(spark, folder):
    d = table(spark, folder, "documents")
    m = F.array(F.struct(F.lit("contact").alias("metric"), F.col("text").rlike(r"[A-Za-z0-9.]+@[A-Za-z0-9.]+").alias("ok")), F.struct(F.lit("licence").alias("metric"), F.lower("text").rlike("licen[cs]e").alias("ok")))
    z = d.select("doc_id", F.col("n_chars").cast("double").alias("v"), F.explode(m).alias("z"))
    return z.select("doc_id", "z.metric", F.when(F.col("z.ok"), F.col("v")).alias("score"), F.when(F.col("z.ok"), "supported").otherwise("disputed").alias("state"))


@query("p35_linear_probability", "P35", f"""
SELECT vec_id, {sql_rnd("1 / (1 + exp(-list_sum(list_transform(generate_series(1, 64), lambda i: CAST(embedding[i] AS DOUBLE) * (i % 7 - 3)))))")} AS p FROM embeddings""")
def _(spark, folder):
    e = table(spark, folder, "embeddings")
    coef = F.array(*[F.lit(float(i % 7 - 3)) for i in range(1, 65)])
    return e.select("vec_id", rnd(stats.sigmoid(stats.dot(F.transform("embedding", lambda x: x.cast("double")), coef))).alias("p"))
