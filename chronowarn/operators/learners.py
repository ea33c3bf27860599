"""Matched learners: person-equal weights, grouped folds, selection by out-of-fold loss.

The promise is the selection procedure and the data handling; coefficients follow
``pyspark.ml``.
"""

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from chronowarn.operators import evaluate
from chronowarn.operators.splits import grouped_stratified_folds
from chronowarn.session import materialise, spread

FITS = 4              # fits that run at the same time

def person_weights(rows: DataFrame, person: str) -> DataFrame:
    """Total weight one, shared equally by people and then by each person's rows.

    Counts are aggregated before they are joined back, so a busy person is one joined row.
    """
    counts = rows.groupBy(person).agg(F.count(F.lit(1)).alias("__n"))
    people = counts.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.join(counts.select(person, (F.lit(1.0) / F.col("__n") / people).alias("weight")), person)


def with_indicators(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A 0/1 column per feature marking missing cells."""
    names = [f"{f}__missing" for f in features]
    return df.select("*", *[F.col(f).isNull().cast("double").alias(n) for f, n in zip(features, names)]), names


def learner(spec: dict, features: Sequence[str], indicators: Sequence[str], label: str = "label", weight: str = "weight", seed: int = 0) -> Pipeline:
    """Median imputation, scaling and one classifier; everything is fitted inside the training rows."""
    filled = [f"{f}__filled" for f in features]
    stages = [Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=[*filled, *indicators], outputCol="__raw")]
    if spec["family"] == "ridge_logistic":
        stages += [StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True),
                   LogisticRegression(featuresCol="__x", labelCol=label, weightCol=weight, regParam=spec["penalty"], elasticNetParam=0.0, maxIter=100, probabilityCol="__prob", standardization=False)]
    else:
        stages.append(GBTClassifier(featuresCol="__raw", labelCol=label, weightCol=weight, maxDepth=spec["depth"], maxIter=spec["iterations"], stepSize=0.1, minInstancesPerNode=10, seed=seed))
    return Pipeline(stages=stages)


def probability(df: DataFrame, model) -> DataFrame:
    out = model.transform(df)
    col = "__prob" if "__prob" in out.columns else "probability"
    return out.withColumn("p", vector_to_array(F.col(col))[1]).select(*df.columns, "p")


@dataclass(frozen=True)
class FoldRows:
    """Rows with missing marks, the person's fold and number of rows (``__n``), written once for all fits."""

    data: DataFrame
    indicators: list[str]
    people: dict[int, int]     # people per fold

    def training(self, fold: int) -> DataFrame:
        """Rows of the other folds; their people share a total weight of one, a person's rows share the person's."""
        people = sum(n for k, n in self.people.items() if k != fold)
        return self.data.filter(F.col("fold") != fold).withColumn("weight", F.lit(1.0) / F.col("__n") / people)

    def held(self, fold: int) -> DataFrame:
        return self.data.filter(F.col("fold") == fold)


def fold_rows(rows: DataFrame, features: Sequence[str], *, person: str, label: str, seed: int, folds: int) -> FoldRows:
    people = grouped_stratified_folds(rows, person, label, seed, folds).select(person, "fold")
    people = materialise(people.join(rows.groupBy(person).agg(F.count(F.lit(1)).alias("__n")), person), "fold-people")
    data, indicators = with_indicators(rows.join(people, person), features)
    counts = {r["fold"]: r["count"] for r in people.groupBy("fold").count().toLocalIterator()}   # a row per fold
    return FoldRows(materialise(spread(data), "folds"), indicators, counts)


def side_by_side(spark, calls: Sequence) -> list:
    """Results of independent fits, ``FITS`` of them at a time: one fit alone is many short jobs."""
    with ThreadPool(max(1, min(FITS, len(calls)))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda call: call()), calls, chunksize=1)


def fold_scores(rows: FoldRows, spec: dict, features: Sequence[str], *, label: str, seed: int, folds: int) -> list[DataFrame]:
    """Per fold, its rows with ``p`` of the model that was fitted on the other folds."""
    fits = [lambda k=k: learner(spec, features, rows.indicators, label, seed=seed).fit(rows.training(k)) for k in range(folds)]
    return [probability(rows.held(k), model) for k, model in enumerate(side_by_side(rows.data.sparkSession, fits))]


def out_of_fold(rows: DataFrame, spec: dict, features: Sequence[str], *, person: str, label: str, seed: int, folds: int) -> DataFrame:
    """Predictions of models that never saw the person, fold by fold."""
    dealt = fold_rows(rows, features, person=person, label=label, seed=seed, folds=folds)
    parts = fold_scores(dealt, spec, features, label=label, seed=seed, folds=folds)
    return materialise(reduce(DataFrame.unionByName, [part.select(*rows.columns, "fold", "p") for part in parts]), "out-of-fold")


def select_learner(rows: DataFrame, specs: Sequence[dict], features: Sequence[str], *, person: str, label: str, seed: int, folds: int = 3) -> tuple[dict, list[tuple[dict, float]]]:
    """Specification with the smallest mean person-weighted fold log loss; ties go to the earlier one.

    All specifications use the same written folds; a fold's loss is one sum over its scored rows.
    """
    dealt = fold_rows(rows, features, person=person, label=label, seed=seed, folds=folds)
    y, p = F.col(label), F.least(F.greatest("p", F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = F.sum(-(y * F.log(p) + (1 - y) * F.log(1 - p)) / F.col("__n")) / F.sum(1 / F.col("__n"))

    def fold_loss(spec, k):
        model = learner(spec, features, dealt.indicators, label, seed=seed).fit(dealt.training(k))
        return probability(dealt.held(k), model).agg(loss).first()[0]

    calls = [lambda spec=spec, k=k: fold_loss(spec, k) for spec in specs for k in sorted(dealt.people)]
    losses = side_by_side(rows.sparkSession, calls)
    n = len(dealt.people)
    trials = [(spec, math.fsum(losses[i * n : (i + 1) * n]) / n) for i, spec in enumerate(specs)]
    best = min(range(len(trials)), key=lambda i: (round(trials[i][1], 12), i))
    return trials[best][0], trials


def select_smoothing(candidates: dict[float, DataFrame], *, person: str, label: str, score: str, seed: int, folds: int = 3) -> tuple[float, list[tuple[float, float]]]:
    """Half-life with the best mean fold AUC (people equal); ties keep the shorter memory."""
    trials = []
    for half_life, rows in candidates.items():
        known = rows.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        fold = known.join(grouped_stratified_folds(known, person, label, seed, folds).select(person, "fold"), person)
        n = fold.groupBy("fold", person).agg((F.lit(1.0) / F.count(F.lit(1))).alias("w"))
        auc = evaluate.rank_metrics(fold.join(n, ["fold", person]), label, score, by=["fold"], weight="w").agg(F.avg("roc_auc")).first()[0]
        trials.append((half_life, auc if auc is not None else 0.0))
    best = max(trials, key=lambda t: (round(t[1], 12), -t[0]))
    return best[0], trials


def fit_bounded(rows: DataFrame, features: Sequence[str], penalty: float, *, person: str, label: str):
    """Logistic model on log1p features with nonnegative coefficients and people weighted equally."""
    from pyspark.ml.linalg import Matrices
    logged = rows.select(person, label, *[F.log1p(F.greatest(F.col(f), F.lit(0.0))).alias(f) for f in features])
    low = Matrices.dense(1, len(features), [0.0] * len(features))
    stages = [VectorAssembler(inputCols=list(features), outputCol="__x"),
              LogisticRegression(featuresCol="__x", labelCol=label, weightCol="weight", regParam=penalty, lowerBoundsOnCoefficients=low, maxIter=100)]
    return Pipeline(stages=stages).fit(person_weights(logged, person))


def fit_curve(rows: DataFrame, predicted: str, truth: str, person: str) -> list[tuple[float, float]]:
    """Person-weighted isotonic correction as knots, clamped to 0..100.

    The input is first averaged per predicted value, so the pooled order is over distinct values.
    """
    weighted = person_weights(rows.select(person, predicted, truth), person)
    cells = weighted.groupBy(predicted).agg((F.sum(F.col(truth) * F.col("weight")) / F.sum("weight")).alias("label"), F.sum("weight").alias("weight"))
    model = IsotonicRegression(featuresCol=predicted, labelCol="label", weightCol="weight").fit(cells)
    clamp = lambda v: min(100.0, max(0.0, float(v)))
    return [(float(x), clamp(y)) for x, y in zip(model.boundaries.toArray(), model.predictions.toArray())]


def fit_guards(rows: DataFrame, metrics: Sequence[str], vector: str, family: str, penalty: float, target_precision: float):
    """One family-weighted logistic head per metric on frozen vectors, with an acceptance threshold from validation rows."""
    from pyspark.ml.functions import array_to_vector
    out = {}
    for m in metrics:
        known = rows.filter(F.col(m).isNotNull()).select("*", array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("__v"))
        train = person_weights(known.filter("split = 'train'"), family)
        pipe = Pipeline(stages=[StandardScaler(inputCol="__v", outputCol="__x", withMean=True), LogisticRegression(featuresCol="__x", labelCol=m, weightCol="weight", regParam=penalty, maxIter=50)])
        model = pipe.fit(train)
        scored = model.transform(known).withColumn("p", vector_to_array("probability")[1])
        chosen = evaluate.empirical_threshold(scored.filter("split = 'validation'"), m, "p", target_precision).first()
        out[m] = (model, chosen["threshold"] if chosen else None)
    return out


def _log_beta_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for X ~ Binomial(n, p)."""
    if p <= 0:
        return 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    top = max(logs)
    return math.exp(top) * sum(math.exp(v - top) for v in logs)


def exact_lower_bound(correct: int, accepted: int, alpha: float) -> float:
    """One-sided exact binomial lower bound by bisection (a handful of metrics, on the driver)."""
    if not correct:
        return 0.0
    low, high = 0.0, 1.0 - 1e-15
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _log_beta_tail(correct, accepted, mid) < alpha else (low, mid)
    return low


def certify(counts: DataFrame, metric: str, target_precision: float, alpha: float = 0.05) -> DataFrame:
    """Exact bound per metric, Bonferroni over metrics, from (metric, accepted, correct) counts: one row per metric."""
    rows = counts.select(metric, "accepted", "correct").toLocalIterator()
    rows = [(r[0], int(r[1]), int(r[2])) for r in rows]
    share = alpha / max(1, len(rows))
    table = [(m, a, c, c / a if a else None, exact_lower_bound(c, a, share)) for m, a, c in rows]
    out = counts.sparkSession.createDataFrame(table, f"{metric} string, accepted int, correct int, precision double, precision_lower double")
    return out.withColumn("status", F.when(F.col("precision_lower") >= target_precision, "calibrated").otherwise("insufficient_evidence_calibration"))
