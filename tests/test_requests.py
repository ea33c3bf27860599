"""Rules of requests, screening and span targets against plain Python."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronowarn.operators import requests

SCHEMA = "record_id string, participant_id string, observed_at timestamp, available_at timestamp, issued_at timestamp, features map<string,double>"
NAMES = ("text_mood", "sleep_midpoint_h", "resting_hr_bpm")
GOOD = dict.fromkeys(NAMES, 1.0)
AS_OF = "2026-01-10 12:00:00"


def row(record, person="p", observed=1, available=2, issued=(3, 12), features=None):
    at = lambda day, hour=6: datetime(2026, 1, day, hour)
    return (record, person, at(observed), at(available), at(*issued), GOOD if features is None else features)


def test_every_rule_is_found(spark):
    rows = [row("ok"), row(" ", "q"), row("n1", None), row("late", "a", 4, 3), row("future", "b", issued=(20, 12)), row("hour", "c", issued=(3, 13)), row("twice", "d"), row("twice", "e"),
            row("s1", "f"), row("s2", "f"), row("few", "g", features={"text_mood": 1.0}), row("more", "h", features={**GOOD, "label": 1.0}), row("null", "i", features={**GOOD, "text_mood": None}),
            row("neg", "j", features={**GOOD, "text_mood": -1.0}), row("nan", "k", features={**GOOD, "resting_hr_bpm": float("nan")}), row("big", "l", features={**GOOD, "text_mood": 100.5}),
            row("mid", "m", features={**GOOD, "sleep_midpoint_h": 24.0}), row("zero", "n", features={**GOOD, "resting_hr_bpm": 0.0})]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["record_id"], r["participant_id"]): r["problem"] for r in requests.request_problems(df, NAMES, F.lit(AS_OF).cast("timestamp")).collect()}
    want = {"ok": None, " ": "missing_identity", "n1": "missing_identity", "late": "not_available", "future": "not_available", "hour": "not_issue_hour", "twice": "duplicate", "s1": "duplicate", "s2": "duplicate",
            "few": "wrong_features", "more": "wrong_features", "null": None, "neg": "invalid_number", "nan": "invalid_number", "big": "contradicts_units", "mid": "contradicts_units", "zero": "contradicts_units"}
    assert len(got) == len(rows) and all(v == want[k] for (k, _), v in got.items())
    assert {r["problem"] for r in requests.request_problems(df.withColumn("label", F.lit(1)), NAMES, F.lit(AS_OF).cast("timestamp")).collect()} == {"unsupported_fields"}
    with pytest.raises(ValueError):
        requests.request_gate(requests.request_problems(df, NAMES, F.lit(AS_OF).cast("timestamp")))
    assert requests.request_gate(requests.request_problems(df.where("record_id = 'ok'"), NAMES, F.lit(AS_OF).cast("timestamp"))).count() == 1


def test_span_targets_equal_all_pairs(spark):
    rng = random.Random(3)
    tokens, spans = [], []
    for text in range(5):
        at = 0
        for _ in range(60):
            n = rng.randint(0, 6)
            tokens.append((text, at, at + n))
            at += n + rng.randint(0, 2)
        for _ in range(12 if text else 0):
            a = rng.randint(0, at)
            spans.append((text, a, a + rng.randint(0, 40)))
    kinds = "text long, start long, end long"
    out = requests.span_targets(spark.createDataFrame(tokens, kinds), spark.createDataFrame(spans, kinds), "text").collect()
    want = sorted((t, a, b, int(b > a and any(s == t and x <= a and b <= y for s, x, y in spans))) for t, a, b in tokens)
    assert sorted(map(tuple, out)) == want and {r[3] for r in want} == {0, 1}


def test_only_weak_rows_with_a_cue_change(spark):
    rows = [("not well", "weak", 5.0, "supported", "mood"), ("not well", "curated", 5.0, "supported", "mood"), ("fine", "weak", 5.0, "supported", "mood"), ("not well", "weak", None, "unreviewed", "mood"), ("not well", "weak", 5.0, "supported", "joy"), (None, "weak", 5.0, "supported", "mood")]
    df = spark.createDataFrame(rows, "text string, method string, score double, state string, metric string")
    out = requests.screen_weak_absence(df, "text", "method", "weak", "score", "state", {"mood": "not"})
    got = [(r["score"], r["state"], r["previous"]) for r in out.collect()]
    assert got == [(None, "disputed", 5.0), (5.0, "supported", None), (5.0, "supported", None), (None, "unreviewed", None), (5.0, "supported", None), (5.0, "supported", None)]
