import numpy as np
import pytest
from pyspark.sql import functions as F

from chronowarn.functions.hashing import hash_int, hash_ints
from chronowarn.operators import discovery, network, resample

SEED = 20261001


def unpacked(cells):
    """Times by (draw, idx) of cells."""
    out = {}
    for r in cells.collect():
        for i in np.flatnonzero(np.frombuffer(r["times"], np.uint8)).tolist():
            key = r["draw"], r["block"] * resample.BLOCK + i + 1
            out[key] = out.get(key, 0) + r["times"][i]
    return out


def test_hashes_of_many_numbers_equal_the_column_form(spark):
    numbers = np.r_[np.arange(0, 120), 999, 1000, 10**9, 10**17].astype(np.int64)
    df = spark.createDataFrame([(int(v),) for v in numbers], "v long").select("v", hash_int(SEED, F.lit("draw"), F.lit(7), "v").alias("h"))
    want = {r["v"]: r["h"] for r in df.collect()}
    assert hash_ints(f"{SEED}|draw|7|", numbers).tolist() == [want[int(v)] for v in numbers]


def test_cells_hold_the_listed_draws(spark, monkeypatch):
    for n, block, slots in ((1, 4096, 1 << 18), (23, 5, 7)):
        monkeypatch.setattr(resample, "BLOCK", block)
        monkeypatch.setattr(resample, "SLOTS", slots)
        want = {(r["draw"], r["idx"]): r["times"] for r in resample.draw_counts(spark, n, 9, SEED).collect()}
        assert unpacked(resample.draw_cells(spark, n, 9, SEED)) == want
        assert unpacked(resample.packed(resample.draw_counts(spark, n, 9, SEED))) == want


@pytest.mark.parametrize("block", [4096, 6])
def test_discovery_by_blocks_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(resample, "BLOCK", block)
    monkeypatch.setattr(resample, "CHUNK", 7)
    rng = np.random.default_rng(8)
    n, p, boots, perms = 17, 3, 20, 15
    a, b = rng.normal(size=(n, p)), rng.normal(size=(n, p))
    b[:, :2] += rng.normal(size=(n, 1)) * 2
    rows = [(i + 1, a[i].tolist(), b[i].tolist()) for i in range(n)]
    rows[3] = (4, [None, 1.0, 2.0], rows[3][2])         # no whole vector on one side
    pairs = spark.createDataFrame(rows, "idx long, stable array<double>, pre array<double>")
    mods = discovery.module_table(spark, list("abc"), (2,))
    got = {r["module"]: r for r in discovery.discover(pairs, resample.draw_cells(spark, n, boots, SEED), mods, p, bootstraps=boots, permutations=perms,
                                                      seed=SEED, stability=0.0, alpha=1.0).collect()}

    def parts(x, m):
        x = x[np.isfinite(x).all(1)]
        r, sd = np.abs(np.corrcoef(x, rowvar=False)), x.std(0, ddof=1)
        out = [k for k in range(p) if k not in m]
        return sd[m].mean(), r[m[0], m[1]], r[np.ix_(m, out)].mean()

    def statistic(x, y, m):
        u, v = parts(x, m), parts(y, m)
        good = v[0] > u[0] and v[1] > u[1] and v[2] < u[2]
        return np.log(v[0] / u[0]) + np.log(v[1] / u[1]) - np.log(v[2] / u[2]) if good else 0.0

    a[3] = np.nan
    modules = {"a,b": [0, 1], "a,c": [0, 2], "b,c": [1, 2]}
    times = unpacked(resample.draw_cells(spark, n, boots, SEED))
    tops = []
    for d in range(perms):
        flip = (hash_ints(f"{SEED}|permutation|{d}|", np.arange(1, n + 1)) & 1).astype(bool)[:, None]
        tops.append(max(statistic(np.where(flip, b, a), np.where(flip, a, b), m) for m in modules.values()))
    for name, m in modules.items():
        hits = 0
        for d in range(boots):
            take = [i for i in range(n) for _ in range(times.get((d, i + 1), 0))]
            hits += statistic(a[take], b[take], m) > 0
        want = statistic(a, b, m)
        assert np.isclose(got[name]["statistic"], want) and np.isclose(got[name]["stability"], hits / boots)
        assert np.isclose(got[name]["adjusted_p"], (1 + sum(t >= want for t in tops)) / (perms + 1))


@pytest.mark.parametrize("block", [4096, 4])
def test_block_sums_and_medians_equal_listed_draws(spark, monkeypatch, block):
    monkeypatch.setattr(resample, "BLOCK", block)
    monkeypatch.setattr(resample, "CHUNK", 5)
    rng = np.random.default_rng(2)
    n, reps = 11, 12
    rows = [(i + 1, m, int(rng.integers(9)), None if i % 4 == 0 else float(rng.integers(3))) for i in range(n) for m in ("a", "b") if (i, m) != (2, "b")]
    people = spark.createDataFrame(rows, "idx long, method string, hits long, lead double")
    listed, cells = resample.draw_counts(spark, n, reps, SEED), resample.draw_cells(spark, n, reps, SEED)
    plain = resample.resampled_sums(people, listed, ["hits"], by=["method"])
    block_wise = resample.resampled_sums(people, cells, ["hits"], by=["method"], repetitions=reps)
    assert plain.schema["hits"].dataType == block_wise.schema["hits"].dataType
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, block_wise.select(*plain.columns).collect()))
    want = people.join(listed, "idx").filter("lead IS NOT NULL").groupBy("method", "draw").agg(F.percentile("lead", 0.5, F.col("times")).alias("m"))
    got = resample.resampled_medians(people, cells, "lead", reps, by="method")
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect()))


def test_deviation_alone_looks_at_no_branch(spark, monkeypatch):
    rng = np.random.default_rng(3)
    draws = [network.Reference(20, tuple(rng.normal(size=3)), tuple(np.cov(rng.normal(size=(20, 3)), rowvar=False).ravel() * 19)) for _ in range(6)]
    rows = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(5)] + [(9, [None, 1.0, 1.0])], "k long, vec array<double>")
    names = ["k", "deviation_median", "deviation_iqr"]
    whole = network.resampled_scores(rows, draws, ["k"], list("abc"))
    alone = network.resampled_scores(rows, draws, ["k"], list("abc"), ("deviation",))
    assert alone.columns == names
    assert sorted(map(str, whole.select(*names).collect())) == sorted(map(str, alone.collect()))


def test_branches_of_few_and_many_features_agree(monkeypatch):
    rng = np.random.default_rng(6)
    dev, delta = np.abs(rng.normal(size=(60, 11))), rng.normal(size=(60, 55)) * 0.1
    delta[3] = 0.0                                       # no outside: the record is void
    delta[4, 2] = np.nan
    many = network.branch_scores(dev, delta)
    assert np.isnan(many[0][3]) and np.isnan(many[0][4]) and np.isfinite(np.delete(many[0], [3, 4])).all()
    few = network.branch_scores(dev[:, :5], delta[:, :10])
    looked_up = network._member_tables(5)[1](np.array([0b10011]))
    assert looked_up.sum() == 3 and (few[2].sum(1)[np.isfinite(few[0])] < 5).all()
