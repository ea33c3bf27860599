from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronowarn.functions import textkeys
from chronowarn.operators import corpus, evaluate, resample, validate
from chronowarn.operators.learners import exact_lower_bound
from chronowarn.sources import adapters, store, tabular


def days_frame(spark, rows):
    return spark.createDataFrame(rows, "participant_id long, day date, issued_at timestamp, score double, label int, onset timestamp")


def cohort(spark, seed=0, people=12, length=15):
    rng = np.random.default_rng(seed)
    rows, events = [], []
    for p in range(people):
        onset = datetime(2025, 1, 10, 4) if p % 3 == 0 else None
        if onset:
            events.append((p, onset))
        for i in range(length):
            t = datetime(2025, 1, 1, 12) + timedelta(days=i)
            label = None if onset and t >= onset else (1 if onset and timedelta(days=1) <= onset - t <= timedelta(days=7) else 0)
            score = None if rng.random() < 0.1 else float(round(rng.random() * 3, 1))
            rows.append((p, t.date(), t, score, label, onset if label == 1 else None))
    return days_frame(spark, rows), spark.createDataFrame(events, "participant_id long, onset timestamp")


def test_sweep_equals_replay_at_every_threshold(spark):
    days, events = cohort(spark)
    sweep = {round(r["threshold"], 6): r for r in evaluate.threshold_sweep(days, events).collect()}
    for t in (0.0, 0.7, 1.5, 2.4):
        if t not in sweep:
            continue
        m = evaluate.event_metrics(days, events, t, ranks=False).first()
        for c in ("tp", "tn", "fp", "fn", "false_alarms", "true_alarms", "unknown_alarms", "detected_events", "events"):
            assert m[c] == sweep[t][c], (t, c)


def test_steps_replay_side_by_side(spark, monkeypatch):
    """Steps of every person against a plain loop, in blocks of three pairs, and without a copy of the history per score."""
    monkeypatch.setattr(evaluate, "PAIRS", 3)
    days, _ = cohort(spark, seed=3, people=6, length=12)
    odd = days_frame(spark, [(50, date(2025, 1, 1), datetime(2025, 1, 1, 12), float("nan"), 0, None), (50, date(2025, 1, 2), datetime(2025, 1, 2, 12), float("nan"), 1, None),
                             (50, date(2025, 1, 3), datetime(2025, 1, 3, 12), -1.0, None, None), (51, date(2025, 1, 1), datetime(2025, 1, 1, 12), None, 1, None)])
    days = days.unionByName(odd).withColumn("part", F.col("participant_id") % 2)
    steps = evaluate.threshold_steps(days, by=["part"])
    assert "Generate" not in steps._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in steps.collect():
        key = r["part"], "nan" if np.isnan(r["threshold"]) else r["threshold"]
        got[key] = got.get(key, np.zeros(len(evaluate.SWEEP), int)) + [r[c] for c in evaluate.SWEEP]
    want = {}
    above = lambda a, b: a > b or (np.isnan(a) and not np.isnan(b))
    people = {}
    for r in days.orderBy("day").collect():
        people.setdefault((r["part"], r["participant_id"]), []).append(r)
    for (part, _), rows in people.items():
        before = np.zeros(len(evaluate.SWEEP), int)
        own = {"nan" if np.isnan(r["score"]) else r["score"] for r in rows if r["score"] is not None} | {0.0}
        for t in sorted(own, key=lambda v: np.inf if v == "nan" else v):
            c, run, last, alarm = dict.fromkeys(evaluate.SWEEP, 0), 0, None, None
            for r in rows:
                s, y, d = r["score"], r["label"], r["day"]
                risk = s is not None and above(s, np.nan if t == "nan" else t)
                run = (run if last == d - timedelta(days=1) else 0) + 1 if risk else 0
                fires = run >= 2 and (alarm is None or (d - alarm).days >= 7)
                if s is not None and y is not None:
                    c[("tp" if risk else "fn") if y else ("fp" if risk else "tn")] += 1
                if fires:
                    run, alarm = 0, d
                    c["unknown_alarms" if y is None else "true_alarms" if y else "false_alarms"] += 1
                    c["detected"] |= int(y == 1)
                last = d
            now = np.array([c[k] for k in evaluate.SWEEP])
            want[part, t] = want.get((part, t), 0) + now - before
            before = now
    assert {k: v.tolist() for k, v in got.items()} == {k: v.tolist() for k, v in want.items()}


def test_events_without_forecasts_count(spark):
    days, registered = cohort(spark, people=2)
    assert evaluate.registry_conflicts(days, registered).count() == 0
    days = days.filter("participant_id = 1")  # a person without any event
    events = spark.createDataFrame([(99, datetime(2025, 1, 9, 4))], "participant_id long, onset timestamp")
    m = evaluate.event_metrics(days, events, 1.0, ranks=False).first()
    assert m["events"] == 1 and m["event_sensitivity"] == 0.0


def test_rank_metrics_and_tau(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 200), np.round(rng.random(200), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert np.isclose(evaluate.rank_metrics(df, "y", "s").first()["roc_auc"], auc)
    i, j = np.triu_indices(200, 1)
    tau = (np.sign(y[i] - y[j]) * np.sign(s[i] - s[j])).sum() / np.sqrt((y[i] != y[j]).sum() * (s[i] != s[j]).sum())
    assert np.isclose(evaluate.kendall_tau_b(df, "y", "s", (0, 1)).first()[0], tau)


def test_draws_keep_replicate_size(spark):
    d = resample.draw_counts(spark, 17, 5, 3).groupBy("draw").agg(F.sum("times").alias("n")).collect()
    assert sorted((r["draw"], r["n"]) for r in d) == [(k, 17) for k in range(5)]


def test_exact_bound():
    assert exact_lower_bound(0, 10, 0.05) == 0.0
    assert np.isclose(exact_lower_bound(10, 10, 0.05), 0.05 ** 0.1)


def test_families_against_union_find(spark):
    rng = np.random.default_rng(7)
    rows = [(i, f"a{rng.integers(40)}", f"b{rng.integers(40)}") for i in range(60)] + [(100 + i, "same", "same") for i in range(20)]
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    seen = {}
    for i, a, b in rows:
        for k in (("a", a), ("b", b)):
            if k in seen:
                x, y = find(i), find(seen[k])
                parent[max(x, y)] = min(x, y)
            else:
                seen[k] = i
    got = {r["id"]: r["family"] for r in corpus.connected_families(spark.createDataFrame(rows, "id long, a string, b string"), "id", ["a", "b"]).collect()}
    assert got == {i: find(i) for i in parent}


def test_chinese_text_rules(spark):
    df = spark.createDataFrame([("睡眠", "昨晚睡了七小时，醒了2次。"), ("睡眠", "昨晚睡了八小时，醒了3次！"), ("睡眠", "slept well"), ("天气", "晴"), ("睡眠", " ")], "c string, t string")
    cats = {"睡眠": "sleep", "sleep": "sleep"}
    got = df.select(textkeys.input_problem("c", "t", cats).alias("p"), textkeys.template_identity("t").alias("k")).collect()
    assert [r["p"] for r in got] == [None, None, "not_chinese", "unknown_category", "empty_text"]
    assert got[0]["k"] == got[1]["k"]


def test_label_states(spark):
    df = spark.createDataFrame([("supported", 5.0, True), ("supported", None, True), ("explicit_absence", 3.0, True), ("unreviewed", 1.0, True), ("insufficient_evidence", None, True)], "s string, v double, a boolean")
    got = df.select(textkeys.label_problem("s", "v", "a").alias("p"), textkeys.evidence_target("s", "v").alias("t")).collect()
    assert [r["p"] for r in got] == [None, "score_required", "absence_needs_zero", "score_not_allowed", None]
    assert [r["t"] for r in got] == [1, 1, 1, None, 0]


def test_spans_and_tokens(spark):
    df = spark.createDataFrame([("hello world", 6, 11, "world"), ("hello", 2, 9, "llo"), ("hello", 0, 2, "ho")], "t string, a int, b int, q string")
    assert [r[0] for r in df.select(textkeys.span_problem("t", "a", "b", "q")).collect()] == [None, "offsets_out_of_text", "quote_differs"]
    o = spark.createDataFrame([([(0, 5), (6, 11)], [(5, 11)])], "o array<struct<start:int,end:int>>, s array<struct<start:int,end:int>>")
    assert o.select(textkeys.token_targets(F.col("o"), F.col("s"))).first()[0] == [0, 1]


def test_clock_and_date_parsing(spark):
    df = spark.createDataFrame([("07:30",), ("25:00",), ("0.5",), ("n/a",)], "t string")
    assert [r[0] for r in df.select(adapters.clock_minutes("t").cast("double")).collect()] == [450.0, None, 720.0, None]
    d = spark.createDataFrame([("2025-02-03",), ("9-5",), ("13-5",), ("40-41",), ("",)], "t string").select(adapters.partial_date("t").alias("d")).select("d.*").collect()
    assert [r["status"] for r in d] == ["calendar_date", "ambiguous", "month_day", "invalid", "missing"]
    assert d[1]["candidates"] == ["09-05", "05-09"] and d[2]["candidates"] == ["05-13"]


def test_strict_tables(spark, tmp_path):
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL("a int, b string")
    good, bad = tmp_path / "g.csv", tmp_path / "b.csv"
    good.write_text("a,b\n1,x\n")
    bad.write_text("a,a\n1,x\n")
    assert tabular.read_table(spark, str(good), schema).collect()[0]["b"] == "x"
    with pytest.raises(tabular.BadHeader):
        tabular.read_table(spark, str(bad), schema)
    ragged = tmp_path / "r.csv"
    ragged.write_text("a,b\n1,x,9\n")
    with pytest.raises(Exception):
        tabular.read_table(spark, str(ragged), schema).collect()
    with pytest.raises(Exception):
        tabular.export_view(spark.range(1), str(good.parent))


def test_store_refuses_repeats_and_manifest_sees_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    store.append(df, path, ["id"])
    with pytest.raises(store.DuplicateRows):
        store.append(df, path, ["id"])
    store.append_new(df.unionByName(spark.createDataFrame([(3, "c")], "id int, v string")), path, ["id"])
    assert spark.read.parquet(path).count() == 3
    files = spark.createDataFrame([("p", bytearray(b"x")), ("q", bytearray(b"y"))], "path string, content binary")
    manifest = files.filter("path = 'p'").select("path", F.lit("0").alias("sha256"))
    assert {r["path"]: r["problem"] for r in store.verify_manifest(files, manifest).collect()} == {"p": "changed", "q": "unlisted_file"}


def test_lineage_and_fill(spark):
    df = spark.createDataFrame([(1, "observed", "s", "h", True), (1, "synthetic", "s", "h", True), (2, "observed", "s", "h", True), (2, "derived", "", "h", True)], "k int, kind string, source_id string, source_hash string, independent boolean")
    got = {r["k"]: (r["kind"], r["independent"]) for r in validate.merge_lineage(df, ["k"]).collect()}
    assert got == {1: ("unknown", True), 2: ("derived", False)}
