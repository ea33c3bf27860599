"""Request, label, screening and span rules on rows derived from the provided tables; some rows break each rule."""

from pyspark.sql import Window as W, functions as F

from chronowarn.functions import clock, textkeys
from chronowarn.operators import endpoints, requests
from chronowarn.plans import base
from chronowarn.plans.registry import query, rnd, sql_rnd, table, with_ctes
from chronowarn.sources import adapters

REQUEST = ("text_mood", "sleep_midpoint_h", "sleep_duration_h", "exercise_minutes", "resting_hr_bpm", "steps")


def request_rows(spark, folder):
    """Events as forecast requests issued at the next UTC noon; every 7th to 31st event breaks a rule."""
    o = base.observations(spark, folder)
    i, v = F.col("observation_id"), F.col("value")
    noon = F.date_trunc("day", "available_at") + F.expr("INTERVAL 36 HOURS")
    issued = F.when(i % 31 == 0, noon + F.expr("INTERVAL 1 HOUR")).otherwise(noon)
    values = {"text_mood": v, "sleep_midpoint_h": F.when(i % 5 > 0, v / 4), "sleep_duration_h": v / 10, "exercise_minutes": v * 20, "resting_hr_bpm": F.when(i % 29 == 0, F.lit(0.0)).otherwise(v + 40), "steps": F.when(i % 23 == 0, -v).otherwise(v)}
    features = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("k"), x.cast("double").alias("v")) for n, x in values.items()]))
    features = F.when(i % 19 == 0, F.map_filter(features, lambda k, _: k != "steps")).otherwise(features)
    return o.select(F.when(i % 37 > 0, F.concat(F.lit("r"), (i - F.when(i % 41 == 0, 1).otherwise(0)).cast("string"))).otherwise(" ").alias("record_id"), F.concat(F.lit("p"), F.col("participant_id").cast("string"), F.lit("-"), i.cast("string")).alias("participant_id"),
                    F.when(i % 17 == 0, F.col("available_at") + F.expr("INTERVAL 1 MINUTE")).otherwise(F.col("start_at")).alias("observed_at"), "available_at", issued.alias("issued_at"), features.alias("features"))


@query("v12_request_rules", "V12 L18", with_ctes("obs", """
, r AS (SELECT *, observation_id AS i, CASE WHEN observation_id % 37 > 0 THEN 'r' || (observation_id - CASE WHEN observation_id % 41 = 0 THEN 1 ELSE 0 END) ELSE ' ' END AS rid,
 date_trunc('day', available_at) + INTERVAL 36 HOUR + CASE WHEN observation_id % 31 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS issued,
 CASE WHEN observation_id % 17 = 0 THEN available_at + INTERVAL 1 MINUTE ELSE start_at END AS observed FROM obs),
d AS (SELECT *, count(*) OVER (PARTITION BY rid) AS k FROM r),
p AS (SELECT CASE WHEN trim(rid) = '' THEN 'missing_identity' WHEN NOT (observed <= available_at AND available_at <= issued AND issued <= TIMESTAMP '2024-02-15 12:00:00') THEN 'not_available'
 WHEN i % 31 = 0 THEN 'not_issue_hour' WHEN k > 1 THEN 'duplicate' WHEN i % 19 = 0 THEN 'wrong_features'
 WHEN value < 0 THEN 'invalid_number' WHEN value > 100 THEN 'contradicts_units' WHEN i % 5 > 0 AND value / 4 >= 24 THEN 'contradicts_units' WHEN value / 10 > 24 THEN 'contradicts_units' WHEN value * 20 > 1440 THEN 'contradicts_units'
 WHEN i % 29 = 0 THEN 'contradicts_units' WHEN i % 23 = 0 AND value > 0 THEN 'invalid_number' END AS problem FROM d)
SELECT problem, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1"""))
def _(spark, folder):
    checked = requests.request_problems(request_rows(spark, folder), REQUEST, F.lit("2024-02-15 12:00:00").cast("timestamp"))
    return checked.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


STATES = ("supported", "supported_unscored", "explicit_absence", "insufficient_evidence", "unreviewed", "disputed", "guessed")


@query("v17_label_states", "V17", f"""
WITH s AS (SELECT [{", ".join(f"'{s}'" for s in STATES)}][doc_id % 7 + 1] AS state, CASE WHEN doc_id % 3 > 0 THEN CAST(n_chars % 111 AS DOUBLE) * CAST(doc_id % 5 > 0 AS INTEGER) END AS score, doc_id % 2 = 0 AS absent FROM documents)
SELECT state, CASE WHEN state = 'guessed' THEN 'unknown_state' WHEN state IN ('supported', 'explicit_absence') AND (score IS NULL OR score < 0 OR score > 100) THEN 'score_required' WHEN state NOT IN ('supported', 'explicit_absence') AND score IS NOT NULL THEN 'score_not_allowed'
 WHEN state = 'explicit_absence' AND (score <> 0 OR NOT absent) THEN 'absence_needs_zero' END AS problem, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY ALL""")
def _(spark, folder):
    d = table(spark, folder, "documents")
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.col("doc_id") % 7 + 1).cast("int"))
    score = F.when(F.col("doc_id") % 3 > 0, (F.col("n_chars") % 111).cast("double") * (F.col("doc_id") % 5 > 0).cast("int"))
    s = d.select(state.alias("state"), score.alias("score"), (F.col("doc_id") % 2 == 0).alias("absent"))
    return s.select("state", textkeys.label_problem("state", "score", "absent").alias("problem")).groupBy("state", "problem").agg(F.count(F.lit(1)).alias("n"))


CUES = {"mood": r"(?:^|[ \n])(?:no|not|non|No|Not|Non)(?:$|[ .,\n])", "sleep": r"(?:^|[ \n])(?:never|without|nicht|pas|by)(?:$|[ .,\n])"}


@query("p24_weak_absence", "P24", rf"""
WITH m AS (SELECT doc_id, text, metric, CASE WHEN doc_id % 3 = 0 THEN 'weak' ELSE 'curated' END AS method, CASE WHEN doc_id % 4 > 0 THEN CAST(n_chars % 100 AS DOUBLE) END AS score FROM documents, (VALUES ('mood'), ('sleep'), ('joy')) v(metric)),
h AS (SELECT *, method = 'weak' AND score IS NOT NULL AND ((metric = 'mood' AND regexp_matches(text, '{CUES["mood"]}')) OR (metric = 'sleep' AND regexp_matches(text, '{CUES["sleep"]}'))) AS hit FROM m WHERE text IS NOT NULL)
SELECT doc_id, metric, CASE WHEN NOT hit THEN score END AS score, CASE WHEN hit THEN 'disputed' ELSE 'supported' END AS state, CASE WHEN hit THEN score END AS previous FROM h""")
def _(spark, folder):
    """Screened references; rows with ``previous`` are the change log."""
    d = table(spark, folder, "documents").where("text IS NOT NULL")
    rows = d.select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "weak").otherwise("curated").alias("method"), F.when(F.col("doc_id") % 4 > 0, (F.col("n_chars") % 100).cast("double")).alias("score"),
                    F.lit("supported").alias("state"), F.explode(F.array(F.lit("mood"), F.lit("sleep"), F.lit("joy"))).alias("metric"))
    out = requests.screen_weak_absence(rows, "text", "method", "weak", "score", "state", CUES)
    return out.select("doc_id", "metric", "score", "state", "previous")


@query("p28_token_targets", "P28", """
WITH w AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS i FROM documents WHERE text IS NOT NULL),
t AS MATERIALIZED (SELECT doc_id, i, CAST(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(word) - 1 AS BIGINT) AS b, length(word) AS n FROM w),
s AS (SELECT doc_id, k * 90 + doc_id % 40 AS b, k * 90 + doc_id % 40 + 20 + k * 13 % 120 AS e FROM (SELECT doc_id, unnest(range(CAST(n_chars // 90 AS BIGINT))) AS k FROM documents WHERE text IS NOT NULL)),
h AS (SELECT t.doc_id, t.i, max(CASE WHEN s.e >= t.b + t.n AND t.n > 0 THEN 1 ELSE 0 END) AS hit FROM t LEFT JOIN s ON s.doc_id = t.doc_id AND s.b <= t.b AND s.b > t.b - 160 GROUP BY ALL)
SELECT doc_id, CAST(count(*) AS BIGINT) AS tokens, CAST(sum(hit) AS BIGINT) AS targets, CAST(sum(hit * (i + 1)) AS BIGINT) AS checksum FROM h GROUP BY 1""")
def _(spark, folder):
    """Words of every text that lie wholly inside one of its spans."""
    d = table(spark, folder, "documents").where("text IS NOT NULL")
    words = F.split("text", " ", -1)
    begun = F.transform(words, lambda w: F.char_length(w) + 1)
    place = d.select("doc_id", F.posexplode(F.arrays_zip(words.alias("word"), begun.alias("n"))).alias("i", "z")).select("doc_id", "i", "z.*")
    before = F.sum("n").over(W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    tokens = place.select("doc_id", "i", before.alias("start"), (before + F.col("n") - 1).alias("end"))
    k = F.explode(F.sequence(F.lit(0), F.floor(F.col("n_chars") / 90).cast("int") - 1))
    spans = d.where("n_chars >= 90").select("doc_id", k.alias("k")).select("doc_id", (F.col("k") * 90 + F.col("doc_id") % 40).alias("start"), (F.col("k") * 90 + F.col("doc_id") % 40 + 20 + F.col("k") * 13 % 120).alias("end"))
    out = requests.span_targets(tokens, spans, "doc_id")
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.sum("target").alias("targets"), F.sum(F.col("target") * (F.col("i") + 1)).cast("long").alias("checksum"))


@query("v34_domain_values", "V34", """
SELECT domain, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN v < 0 OR (domain = 'A1' AND v > 1) THEN 1 ELSE 0 END) AS BIGINT) AS invalid FROM (SELECT unnest(['S1', 'E1', 'A1']) AS domain, CASE WHEN event_id % 11 > 0 THEN value / 50 - 0.2 END AS v FROM events) GROUP BY 1""")
def _(spark, folder):
    e = table(spark, folder, "events").select(F.when(F.col("event_id") % 11 > 0, F.col("value") / 50 - F.lit(0.2)).alias("v"))
    parts = F.array(*[F.struct(F.lit(d).alias("domain"), endpoints.valid_domain(F.col("v"), d).alias("ok")) for d in endpoints.DOMAINS])
    return e.select(F.explode(parts).alias("z")).groupBy("z.domain").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("z.ok")).alias("invalid"))


@query("p11_sleep_clocks", "P11", """
WITH m AS (SELECT o_orderkey, (o_orderkey * 7 % 1440) / 60.0::DOUBLE AS mid, (o_custkey * 11 % 700 + 20) / 60.0::DOUBLE AS dur FROM orders),
u AS (SELECT o_orderkey, unnest([0, 1]) AS which, unnest([CAST(round((((mid - dur / 2) % 24 + 24) % 24) * 3.6e9) AS BIGINT) % 86400000000, CAST(round((((mid + dur / 2) % 24 + 24) % 24) * 3.6e9) AS BIGINT) % 86400000000]) AS us FROM m),
f AS (SELECT o_orderkey, which, printf('%02d:%02d:%02d.%06d', us // 3600000000, us // 60000000 % 60, us // 1000000 % 60, us % 1000000) AS t FROM u)
SELECT o_orderkey, max(CASE WHEN which = 0 THEN t END) AS sleep_start, max(CASE WHEN which = 1 THEN t END) AS sleep_end FROM f GROUP BY 1""")
def _(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", (F.col("o_orderkey") * 7 % 1440 / 60.0).alias("mid"), ((F.col("o_custkey") * 11 % 700 + 20) / 60.0).alias("dur"))
    return o.select("o_orderkey", clock.clocks_from_midpoint("mid", "dur").alias("c")).select("o_orderkey", F.col("c.start").alias("sleep_start"), F.col("c.end").alias("sleep_end"))


@query("p13_preferred_source", "P13", f"""
SELECT l_orderkey, l_linenumber, {sql_rnd('coalesce(CASE WHEN l_quantity <= 30 THEN l_quantity END, CASE WHEN d <= 30 THEN d END)', 6)} AS value, CASE WHEN l_quantity <= 30 THEN 'l_quantity' WHEN d <= 30 THEN 'fallback' END AS source_column
FROM (SELECT *, CAST(l_extendedprice AS DOUBLE) / 1000 AS d FROM lineitem)""")
def _(spark, folder):
    l = table(spark, folder, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double")).withColumn("fallback", F.col("l_extendedprice").cast("double") / 1000)
    return l.select("l_orderkey", "l_linenumber", adapters.preferred("l_quantity", "fallback", 30.0).alias("z")).select("l_orderkey", "l_linenumber", rnd("z.value", 6).alias("value"), "z.source_column")
