import math

import numpy as np
from pyspark.sql import functions as F

from chronowarn.llm import mixing
from chronowarn.llm.quality_classifier import quality, site_posteriors

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    taught = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)) == 0
    kept = {r["doc_id"]: r["kept"] for r in quality(docs, labels.where(taught)).collect()}
    test = labels.where(~taught).collect()
    assert len(kept) == docs.count()
    good = np.mean([kept[r["doc_id"]] for r in test if r["quality"] == 1 and r["toxic"] == 0])
    bad = np.mean([kept[r["doc_id"]] for r in test if r["quality"] == 0])
    assert good > 0.97 and bad < 0.03


def test_site_posteriors_equal_hand_count(spark):
    rows = [("a", "x", 1.0)] * 30 + [("a", "y", 0.0)] * 2 + [("b", "x", 0.0)] * 25 + [(None, None, 1.0)]
    got = {(r["host"], r["path"]): r for r in site_posteriors(spark.createDataFrame(rows, "host string, path string, y double")).collect()}
    corpus = sum(r[2] for r in rows) / len(rows)

    def strength(sites):
        n = sum(s[0] for s in sites)
        chance = sum(s[0] * s[2] * (1 - s[2]) for s in sites) / n
        spare = max(sum(s[0] * (s[1] - s[2]) ** 2 for s in sites) / n - sum(s[2] * (1 - s[2]) for s in sites) / n, 1e-6)
        return min(max(chance / spare - 1, 2.0), 1e4)

    hosts = {"a": (32, 30.0), "b": (25, 0.0), None: (1, 1.0)}
    w = strength([(n, g / n, corpus) for n, g in hosts.values()])
    host = {h: (g + w * corpus) / (n + w) for h, (n, g) in hosts.items()}
    paths = {("a", "x"): (30, 30.0), ("a", "y"): (2, 0.0), ("b", "x"): (25, 0.0), (None, None): (1, 1.0)}
    w = strength([(n, g / n, host[h]) for (h, _), (n, g) in paths.items()])
    for (h, p), (n, g) in paths.items():
        assert math.isclose(got[h, p]["host_posterior"], host[h]) and math.isclose(got[h, p]["path_posterior"], (g + w * host[h]) / (n + w))
    assert host["b"] < host[None] < 1  # the single row is pulled to the corpus


def members(spark, rng, n=400):
    p = rng.dirichlet([0.8, 0.1, 0.1], n)
    t = rng.integers(5, 900, n)
    rows = [(i, int(a), *map(float, b)) for i, (a, b) in enumerate(zip(t, p))]
    return spark.createDataFrame(rows, "doc_id long, tokens long, " + ", ".join(f"p_{d} double" for d in mixing.DOMAINS)), t, p


def optimum(t, p, target, total, most):
    """Least squares over rates in the box by accelerated projected gradient with restarts, to the end."""
    scale = np.sqrt(t / total)
    a = p * scale[:, None]                       # columns: domains; unknowns: rates times scale
    size = 1 / np.linalg.eigvalsh(a.T @ a)[-1]
    x = ahead = scale.copy()
    m, last = 1.0, np.inf
    for _ in range(20_000):
        new = np.clip(ahead - size * (a @ (a.T @ ahead - target / total)), 0, most * scale)
        f = np.square(a.T @ new - target / total).sum()
        if f > last:
            ahead, m, last = x, 1.0, np.inf
            continue
        if np.abs(new - x).max() < 1e-15:
            break
        m, was = (1 + np.sqrt(1 + 4 * m * m)) / 2, m
        ahead, x, last = new + (was - 1) / m * (new - x), new, f
    return np.square(a.T @ x - target / total).sum(), a.T @ x


def test_rates_reach_the_optimum(spark):
    rng = np.random.default_rng(8)
    frame, t, p = members(spark, rng)
    rare_p = np.eye(3)[rng.choice(3, 400, p=[0.94, 0.03, 0.03])] * 0.97 + 0.01          # two domains of 3 %
    rare = spark.createDataFrame([(i, int(a), *map(float, b)) for i, (a, b) in enumerate(zip(t, rare_p))], frame.schema)
    for df, q, weights in ((frame, p, (0.93, 0.05, 0.02)), (rare, rare_p, (0.97, 0.02, 0.01)), (rare, rare_p, (0.9, 0.08, 0.02))):
        for most in (1.0, 3.0):
            u = mixing.fit_rates(df, weights, most)
            got = np.array([r["rate"] for r in mixing.with_rates(df, u, most).orderBy("doc_id").collect()])
            total = (t @ q)[0] / weights[0]
            target = np.array(weights) * total
            least, sums = optimum(t, q, target, total, most)
            reached = (got * t) @ q / total
            assert got.min() >= 0 and got.max() <= most
            assert np.square(reached - target / total).sum() <= least + 2 * mixing.EASE and np.allclose(reached, sums, atol=2e-5)


def test_mix_awkward(spark, awkward, docs_of):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (7, 1, 1), (None, 1, 0), (8, None, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mix(awkward, labels).collect()
    assert len(out) == awkward.count() and all(0 <= r["rate"] <= 1 and r["copies"] in (0, 1) for r in out)
    assert {r["doc_id"]: r["tokens"] for r in out}[7] == 60_000
    kept = mixing.apply_mix(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() == sum(r["copies"] for r in out)
    none = labels.where("false")
    assert mixing.mix(docs_of([]), labels).collect() == []
    assert all(abs(r["p_clean"] - 1 / 3) < 1e-9 for r in mixing.mix(awkward, none).collect())
    scored = quality(awkward, labels).collect()
    assert len(scored) == awkward.count() and all(0 <= r["posterior"] <= 1 for r in scored)
    assert all(abs(r["posterior"] - 0.5) < 0.01 and r["p_document"] == 0.5 for r in quality(awkward, none).collect())
    assert quality(docs_of([]), labels).collect() == []
