"""Fits over folds: one written table, spread over the cores, and losses equal to the plain sums."""

import math

import numpy as np
from pyspark.sql import functions as F

from chronowarn.operators import learners

SPECS = ({"family": "ridge_logistic", "penalty": 0.1}, {"family": "boosted_tree", "depth": 2, "iterations": 2})


def examples(spark, n=400):
    rng = np.random.default_rng(3)
    person, a = rng.integers(0, 50, n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-a))).astype(int)
    rows = [(int(p), None if i % 11 == 0 else float(v), float(rng.normal()), int(t)) for i, (p, v, t) in enumerate(zip(person, a, y))]
    return spark.createDataFrame(rows, "person int, a double, b double, label int").coalesce(1)


def test_selection_equals_plain_sums_over_out_of_fold_rows(spark):
    rows = examples(spark)
    best, trials = learners.select_learner(rows, SPECS, ["a", "b"], person="person", label="label", seed=5)
    for spec, got in trials:
        oof = learners.out_of_fold(rows, spec, ["a", "b"], person="person", label="label", seed=5, folds=3)
        assert oof.columns == ["person", "a", "b", "label", "fold", "p"]
        found = oof.collect()
        assert len(found) == 400 and len({(r["person"], r["fold"]) for r in found}) == 50
        losses = []
        for k in range(3):
            mine = [r for r in found if r["fold"] == k]
            n = {p: sum(r["person"] == p for r in mine) for p in {r["person"] for r in mine}}
            losses.append(sum(-math.log(r["p"] if r["label"] else 1 - r["p"]) / n[r["person"]] for r in mine) / len(n))
        assert abs(got - sum(losses) / 3) < 1e-9
    assert best == min(trials, key=lambda t: t[1])[0]


def test_training_weights_and_spread(spark):
    dealt = learners.fold_rows(examples(spark), ["a", "b"], person="person", label="label", seed=5, folds=3)
    assert dealt.data.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism   # not one task a pass
    train = dealt.training(1)
    assert train.where("fold = 1").isEmpty() and abs(train.agg(F.sum("weight")).first()[0] - 1) < 1e-12
    shares = [r["w"] for r in train.groupBy("person").agg(F.sum("weight").alias("w")).collect()]
    assert np.allclose(shares, 1 / len(shares))


def test_a_selection_writes_its_rows_once(spark, monkeypatch):
    written, write = [], learners.materialise
    monkeypatch.setattr(learners, "materialise", lambda df, label: written.append(label) or write(df, label))
    learners.select_learner(examples(spark), SPECS, ["a", "b"], person="person", label="label", seed=5)
    assert sorted(written) == ["fold-people", "folds"]       # before: three tables and more for each specification
