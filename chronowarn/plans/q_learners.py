"""Learner selection, calibration curves, guards and folds on the labelled forecasts and embeddings."""

from pyspark.sql import functions as F

from chronowarn.functions import textkeys
from chronowarn.functions.ordering import linear_quantiles
from chronowarn.functions.hashing import hash_int
from chronowarn.operators import crossfit, evaluate, isotonic, learners, network, windows
from chronowarn.plans import base, q_evaluate, q_text
from chronowarn.plans.registry import query, rnd, table, with_ctes, sql_rnd
from chronowarn.session import materialise, shared_table

NAMES = ("deviation", "change", "mean_n_events", "sd_n_events")


def examples(spark, folder):
    """Labelled development forecasts with current and historical predictors."""
    def build():
        d = q_evaluate.method_days(spark, folder, "development", "calibration")
        wide = d.filter("label IS NOT NULL").groupBy("participant_id", "day", "label").agg(*[F.max(F.when(F.col("method") == m, F.col("score"))).alias(m) for m in q_evaluate.METHODS])
        h = windows.causal_history(base.daily(spark, folder).withColumn("issued_at", F.date_add("day", 1).cast("timestamp")), ["n_events"], 7)
        return wide.join(h.select("participant_id", "day", "mean_n_events", "sd_n_events"), ["participant_id", "day"], "left")
    return shared_table(spark, folder, "examples", build)


SPECS = ({"family": "ridge_logistic", "penalty": 0.1}, {"family": "ridge_logistic", "penalty": 1.0}, {"family": "boosted_tree", "depth": 2, "iterations": 5})


@query("m04_learner_selection", "M1 M3 M4 M9")
def _(spark, folder):
    best, trials = learners.select_learner(examples(spark, folder), SPECS, NAMES, person="participant_id", label="label", seed=base.SEED)
    rows = [(str(s), float(round(v, 6)), s == best) for s, v in trials]
    return spark.createDataFrame(rows, "spec string, mean_log_loss double, selected boolean")


@query("m03_out_of_fold_scores", "M3 L12 L20")
def _(spark, folder):
    oof = learners.out_of_fold(examples(spark, folder), SPECS[0], NAMES, person="participant_id", label="label", seed=base.SEED, folds=3)
    return oof.select("participant_id", "day", "label", "fold", rnd("p", 5).alias("p"))


@query("m05_smoothing_selection", "M5 W4")
def _(spark, folder):
    e = examples(spark, folder).select("participant_id", "day", "label")
    s = base.scaled(spark, folder).select("participant_id", "day", "score")
    arms = {h: e.join(windows.causal_smooth(s, h), ["participant_id", "day"], "left") for h in (0.0, 2.0, 5.0)}
    best, trials = learners.select_smoothing(arms, person="participant_id", label="label", score="smoothed", seed=base.SEED)
    return spark.createDataFrame([(float(h), float(round(a, 6)), h == best) for h, a in trials], "half_life double, mean_auc double, selected boolean")


@query("m06_bounded_logistic", "M6")
def _(spark, folder):
    rows = examples(spark, folder).dropna(subset=["deviation", "mean_n_events"])
    model = learners.fit_bounded(rows, ["deviation", "mean_n_events"], 0.01, person="participant_id", label="label")
    coef = model.stages[-1].coefficients.toArray()
    return spark.createDataFrame([(n, float(round(c, 6))) for n, c in zip(("deviation", "mean_n_events"), coef)], "feature string, coefficient double")


PENALTIES, STRENGTHS = (0.001, 0.01, 0.1), (0.0, 0.25, 0.5, 0.75)


@query("m01_family_selection", "M1 M3")
def _(spark, folder):
    """Logistic, spline-logistic and boosted trees by mean average precision over the same person folds."""
    rows = examples(spark, folder)
    dealt = learners.fold_rows(rows, NAMES, person="participant_id", label="label", seed=base.SEED, folds=3)
    scored = crossfit.cross_fitted(dealt.data, NAMES, [*crossfit.LOGISTIC, *crossfit.SPLINES], person="participant_id", label="label")
    for trees in learners.fold_scores(dealt, SPECS[2], NAMES, label="label", seed=base.SEED, folds=3):
        scored = scored.unionByName(trees.select("participant_id", F.col("label").cast("double").alias("y"), "fold", F.lit("boosted_trees depth=2").alias("setting"), "p"))
    found = crossfit.best_settings(crossfit.precision_by_fold(materialise(scored, "out-of-fold")), F.substring_index("setting", " ", 1))
    return found.select("family", "setting", rnd("mean_precision", 6).alias("mean_precision"), "best_of_family", "selected")


@query("m06_penalty_selection", "M6")
def _(spark, folder):
    rows = examples(spark, folder).dropna(subset=["deviation", "mean_n_events"])
    chosen, table_, model = crossfit.select_penalty(rows, ["deviation", "mean_n_events"], PENALTIES, person="participant_id", label="label", seed=base.SEED)
    slope = {n: float(round(b, 6)) for n, b in zip(("deviation", "mean_n_events"), model.beta[1:])}
    return table_.select("penalty", "fold", rnd("loss", 6).alias("loss"), rnd("mean_loss", 6).alias("mean_loss"), (F.col("penalty") == chosen).alias("selected"),
                         *[F.when(F.col("penalty") == chosen, F.lit(v)).alias(f"slope_{n}") for n, v in slope.items()])


@query("m07_strength_selection", "M7 P27", with_ctes("sdocs", f"""
, r AS (SELECT *, CAST('0x' || left(md5('{base.SEED}|' || source), 8) AS BIGINT) % 2 AS fold, 1.0::DOUBLE / count(*) OVER (PARTITION BY metric, source) AS w FROM sdocs),
c AS (SELECT metric, held, predicted AS x, sum(w) AS w, sum(w * truth) AS t, row_number() OVER (PARTITION BY metric, held ORDER BY predicted) AS i FROM r JOIN (VALUES (0), (1)) h(held) ON fold <> held GROUP BY metric, held, predicted),
s AS MATERIALIZED (SELECT *, sum(w) OVER o AS cw, sum(t) OVER o AS ct FROM c WINDOW o AS (PARTITION BY metric, held ORDER BY i)),
m AS (SELECT a.metric, a.held, a.i AS a, b.i, min((b.ct - a.ct + a.t) / (b.cw - a.cw + a.w)) OVER (PARTITION BY a.metric, a.held, a.i ORDER BY b.i DESC) AS least FROM s a JOIN s b ON a.metric = b.metric AND a.held = b.held AND a.i <= b.i),
g AS MATERIALIZED (SELECT s.metric, s.held, s.x, greatest(0, least(100, max(m.least))) AS y FROM m JOIN s ON s.metric = m.metric AND s.held = m.held AND s.i = m.i GROUP BY s.metric, s.held, s.x),
e AS (SELECT r.*, lo.x AS x0, lo.y AS y0, hi.x AS x1, hi.y AS y1 FROM r ASOF LEFT JOIN g lo ON r.metric = lo.metric AND r.fold = lo.held AND r.predicted >= lo.x ASOF LEFT JOIN g hi ON r.metric = hi.metric AND r.fold = hi.held AND r.predicted <= hi.x),
f AS (SELECT *, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (predicted - x0) / (x1 - x0) END AS f FROM e),
a AS (SELECT metric, strength, sum(w * abs((1 - strength) * predicted + strength * f - truth)) / sum(w) AS mae FROM f, (VALUES {", ".join(f"({v}::DOUBLE)" for v in STRENGTHS)}) v(strength) GROUP BY ALL)
SELECT metric, strength, {sql_rnd('mae', 5)} AS mae, strength = first_value(strength) OVER (PARTITION BY metric ORDER BY round(mae, 12), strength) AS selected FROM a"""))
def _(spark, folder):
    """Strength of the monotone correction per metric, by errors on sources that the curve has not seen."""
    rows = q_text.scored(spark, folder).withColumn("fold", (hash_int(base.SEED, "source") % 2).cast("int"))
    found, _ = isotonic.select_strength(rows, "predicted", "truth", "source", ["metric"], STRENGTHS)
    return found.select("metric", "strength", rnd("mae", 5).alias("mae"), "selected")


@query("m07_isotonic_curve", "M7 P27")
def _(spark, folder):
    s = q_text.scored(spark, folder).filter("metric = 'length'")
    knots = learners.fit_curve(s, "predicted", "truth", "source")
    xs, ys = F.array(*[F.lit(x) for x, _ in knots]), F.array(*[F.lit(y) for _, y in knots])
    out = s.withColumn("corrected", textkeys.apply_curve("predicted", xs, ys, 1.0))
    return out.groupBy("lang").agg(rnd(F.avg(F.abs(F.col("predicted") - F.col("truth"))), 5).alias("mae_before"), rnd(F.avg(F.abs(F.col("corrected") - F.col("truth"))), 5).alias("mae_after"))


@query("m08_evidence_guards", "M8 T10 A53")
def _(spark, folder):
    e = table(spark, folder, "embeddings").withColumn("y0", (F.col("label") == 0).cast("double")).withColumn("y1", (F.col("label") == 1).cast("double"))
    e = e.withColumn("family", F.col("vec_id") % 50).withColumn("split", F.when(F.col("family") % 4 == 0, "validation").otherwise("train"))
    g = learners.fit_guards(e, ["y0", "y1"], "embedding", "family", 0.1, 0.7)
    return spark.createDataFrame([(m, None if t is None else float(round(t, 5))) for m, (_, t) in g.items()], "metric string, threshold double")


@query("l19_evidence_certification", "L19 A51")
def _(spark, folder):
    """Threshold chosen on one half of the sources, certified once on one text per person of the other half."""
    j = q_text.judged(spark, folder)
    half = F.pmod(F.xxhash64("source"), F.lit(2))
    chosen = evaluate.empirical_threshold(j.filter(half == 0), "quality", "p", 0.6, ["lang"])
    test = j.filter(half == 1)
    key = F.struct(F.sha2(F.concat_ws("|", "lang", "doc_id"), 256), F.col("doc_id"))
    one = test.groupBy("lang", "source").agg(F.min_by(F.struct("quality", "p"), key).alias("r")).select("lang", "r.*")
    counts = one.join(F.broadcast(chosen), "lang").groupBy("lang").agg(F.count_if(F.col("p") >= F.col("threshold")).alias("accepted"), F.count_if((F.col("p") >= F.col("threshold")) & (F.col("quality") == 1)).alias("correct"))
    return learners.certify(counts, "lang", 0.6)


@query("l13_fold_scores", "L13 L14 T9")
def _(spark, folder):
    """Each fold's people are scored against moments of the other folds; alerts above the calibration quantile."""
    from chronowarn.operators.splits import person_folds
    s = base.scaled(spark, folder).select("participant_id", "day", "vec")
    f = person_folds(s, "participant_id", base.SEED, 3)
    rows = materialise(s.join(f, "participant_id"), "folds")
    p = len(base.FEATURES)
    parts = None
    for k in range(3):
        ref = network.freeze_reference(rows.filter(F.col("fold") == (k + 1) % 3), p)
        both = network.personal_scores(network.perturb(rows.filter(F.col("fold") != (k + 1) % 3), ref, p), ("participant_id", "day", "fold"), base.FEATURES)
        both = materialise(both, "fold-scores")
        cut = linear_quantiles(both.filter(F.col("fold") == (k + 2) % 3), "personal_score", {"cut": 0.9}).first()["cut"]
        part = both.filter(F.col("fold") == k).withColumn("alert", F.col("personal_score") > F.lit(cut))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.count_if("alert").alias("alerts"), F.count_distinct("participant_id").alias("people"))


@query("l17_frozen_predictor", "L16 L17 L18 L24")
def _(spark, folder):
    """Frozen model over a history table: robust score, smoothing, fitted probability, alarm policy; labels join last."""
    from chronowarn.operators import alarm
    rows = examples(spark, folder).dropna(subset=["deviation", "mean_n_events"])
    model = learners.fit_bounded(rows, ["deviation", "mean_n_events"], 0.01, person="participant_id", label="label")
    test = q_evaluate.method_days(spark, folder, "test").filter("method = 'deviation'").select("participant_id", "day", "issued_at", "label", "onset", F.col("score").alias("deviation"))
    h = windows.causal_history(base.daily(spark, folder).withColumn("issued_at", F.date_add("day", 1).cast("timestamp")), ["n_events"], 7).select("participant_id", "day", "mean_n_events")
    x = test.join(h, ["participant_id", "day"], "left")
    known = x.dropna(subset=["deviation", "mean_n_events"])
    logged = known.select("participant_id", "day", *[F.log1p(F.greatest(F.col(c), F.lit(0.0))).alias(c) for c in ("deviation", "mean_n_events")])
    p = learners.probability(logged, model).select("participant_id", "day", "p")
    smooth = windows.causal_smooth(x.select("participant_id", "day").join(p, ["participant_id", "day"], "left").withColumnRenamed("p", "score"), 2.0, out="risk")
    alarms = alarm.replay(smooth.select("participant_id", "day", F.col("risk").alias("score")), 0.3)
    done = alarms.join(test.select("participant_id", "day", "label"), ["participant_id", "day"])
    return done.select("participant_id", "day", rnd("score", 5).alias("risk"), "warning", "status", "label")
