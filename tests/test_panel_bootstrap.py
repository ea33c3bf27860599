"""Block products over draws equal replayed rows."""

import numpy as np

from chronowarn.operators import panel_bootstrap as pb, resample

SEED, DRAWS = 5, 30


def replayed(spark, ids, draws=DRAWS):
    """Ids of every draw, taken row by row."""
    people = spark.createDataFrame([(int(i),) for i in ids], "person long")
    index, n = resample.person_index(people, "person", SEED)
    person = {r["idx"]: r["person"] for r in index.collect()}
    out = {k: [] for k in range(draws)}
    for r in resample.draw_counts(spark, n, draws, SEED).collect():
        out[r["draw"]] += [person[r["idx"]]] * r["times"]
    assert all(len(v) == n for v in out.values())
    return out


def test_panels_equal_replayed_people(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(25, 2, 4)) + rng.normal(size=(25, 1, 1))
    x[:, 1, 3] = 0.0
    x[0, 1, 3] = 1.0                                  # draws without person 0 have no spread in this feature
    rows = [(i, k, *map(float, x[i, k])) for i in range(25) for k in range(2)] + [(90, 0, 1.0, 2.0, 3.0, 4.0), (91, 0, 1.0, 2.0, 3.0, None), (91, 1, 1.0, 2.0, 3.0, 4.0), (92, 0, 1.0, 1.0, 1.0, 1.0), (92, 0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "person long, occasion int, a double, b double, c double, d double")
    cube = pb.participant_cube(df, "person", "occasion", ["a", "b", "c", "d"], (0, 1))
    assert {r["person"]: r["reason"] for r in cube.where("reason is not null").collect()} == {90: "missing_occasion", 91: "missing_feature", 92: "repeated_occasion"}
    panels = {"all": (0, 1, 2, 3), "some": (0, 2)}
    corr = pb.resampled_correlations(cube.where("reason is null"), "person", 4, (0, 1), DRAWS, SEED)
    edges = {(r["panel"], r["occasion"], r["i"], r["j"]): r for r in pb.panel_edges(corr, 4, panels, DRAWS).collect()}
    summary = {(r["panel"], r["occasion"]): r for r in pb.panel_summary(corr, 4, panels, DRAWS, 25).collect()}
    drawn = replayed(spark, range(25))
    for k in (0, 1):
        point = np.corrcoef(x[:, k].T)
        sampled = [np.corrcoef(x[d, k].T) for d in drawn.values() if x[d, k].std(0).min() > 0]
        assert (len(sampled) == DRAWS) == (k == 0)
        ratios = [16 / (r * r).sum() for r in sampled]
        for i in range(4):
            for j in range(i + 1, 4):
                e = edges["all", k, i, j]
                assert np.isclose(e["pearson"], point[i, j]) and e["valid_draws"] == len(sampled)
                want = np.quantile([r[i, j] for r in sampled], [0.025, 0.975]) if k == 0 else (None, None)
                assert (e["low"], e["high"]) == (None, None) if k else np.allclose((e["low"], e["high"]), want)
        s = summary["all", k]
        assert np.isclose(s["participation_ratio"], 16 / (point**2).sum()) and np.isclose(s["largest_share"], np.linalg.eigvalsh(point)[-1] / 4)
        assert s["ratio_low"] is None if k else np.allclose((s["ratio_low"], s["ratio_high"]), np.quantile(ratios, [0.025, 0.975]))
    assert edges["some", 0, 0, 2]["low"] == edges["all", 0, 0, 2]["low"]       # the same draws serve every panel


def plain_metrics(y, s, a):
    n, P = len(y), y.sum()
    order = np.argsort(-s, kind="stable")
    area, done = 0.0, 0
    for v in np.unique(s)[::-1]:
        hit = (s == v) & (y == 1)
        above = s >= v
        area += hit.sum() * y[above].mean()
    wins = sum((s[y == 0] < v).sum() + (s[y == 0] == v).sum() / 2 for v in s[y == 1])
    sens, spec = (a[y == 1].mean() if P else None), ((1 - a[y == 0]).mean() if P < n else None)
    both = 0 < P < n
    return {"accuracy": (a == y).mean(), "sensitivity": sens, "specificity": spec, "balanced_accuracy": (sens + spec) / 2 if both else None,
            "roc_auc": wins / (P * (n - P)) if both else None, "average_precision": area / P if both else None}


def test_metrics_equal_replayed_rows(spark):
    rng = np.random.default_rng(2)
    person = rng.integers(0, 18, 120)
    y = (rng.random(120) < 0.3).astype(int)
    s = np.round(rng.normal(size=120) + y, 1)
    a = (s > 0.8).astype(int)
    rows = [(int(p), int(u), float(v), int(w)) for p, u, v, w in zip(person, y, s, a)] + [(3, None, 1.0, 1), (4, 1, None, 1), (77, None, 1.0, 0)]
    df = spark.createDataFrame(rows, "person long, y int, s double, a int")
    got = {r["draw"]: r for r in pb.resampled_metrics(df, "person", "y", "s", "a", DRAWS, SEED).collect()}
    drawn = {**replayed(spark, sorted(set(person.tolist()))), pb.POINT: sorted(set(person.tolist()))}
    assert set(got) == set(drawn)
    for k, ids in drawn.items():
        at = np.concatenate([np.flatnonzero(person == i) for i in ids])
        want = plain_metrics(y[at], s[at], a[at])
        assert got[k]["n"] == len(at)
        for m, v in want.items():
            assert (got[k][m] is None) == (v is None) and (v is None or np.isclose(got[k][m], v)), (k, m)
    out = {r["metric"]: r for r in pb.metric_intervals(pb.resampled_metrics(df, "person", "y", "s", "a", DRAWS, SEED), DRAWS).collect()}
    assert set(out) == set(pb.METRICS) and all(r["valid_draws"] == DRAWS and r["low"] <= r["high"] for r in out.values())
