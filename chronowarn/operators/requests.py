"""Rules that rows must meet before they are scored, trained on or joined: a reason per row, never a silent drop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: fixed values: units of the frozen features, as (suffix or name, greatest value, whether the greatest is allowed)
UNIT_BOUNDS = {"sleep_midpoint_h": (24.0, False), "sleep_duration_h": (24.0, True), "exercise_minutes": (1440.0, True), "screen_time_min": (1440.0, True)}
TEXT_PREFIX, TEXT_LARGEST = "text_", 100.0
POSITIVE = ("resting_hr_bpm",)


def feature_problem(name: str, value: Column) -> Column:
    """Reason why a value contradicts its feature's units; missing values pass."""
    bad = F.isnan(value) | (F.abs(value) == float("inf")) | (value < 0)
    if name.startswith(TEXT_PREFIX):
        over = value > TEXT_LARGEST
    elif name in UNIT_BOUNDS:
        most, allowed = UNIT_BOUNDS[name]
        over = value > most if allowed else value >= most
    else:
        over = value == 0 if name in POSITIVE else F.lit(False)
    return F.when(bad, "invalid_number").when(over, "contradicts_units")


def request_problems(rows: DataFrame, features: Sequence[str], as_of: Column, issue_hour: int = 12) -> DataFrame:
    """``rows`` with ``problem``: the first rule that a row of a forecast request breaks, or null.

    ``rows`` has record_id, participant_id, observed_at, available_at, issued_at and a map ``features``.  Rules in order:
    unsupported_fields (further columns: a request carries no outcomes; then every row breaks it), missing_identity,
    not_available (observed <= available <= issued <= as_of), not_issue_hour (UTC), duplicate (record, or person and
    time of issue), wrong_features (not exactly the frozen names; unknown values must be there as null), then the units
    of every feature.  Duplicates are counted per key with partial sums; every row of a repeated key breaks the rule.
    """
    allowed = {"record_id", "participant_id", "observed_at", "available_at", "issued_at", "features"}
    if set(rows.columns) != allowed:
        return rows.withColumn("problem", F.lit("unsupported_fields"))
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    times = F.coalesce((F.col("observed_at") <= F.col("available_at")) & (F.col("available_at") <= F.col("issued_at")) & (F.col("issued_at") <= as_of), F.lit(False))
    by_record = rows.groupBy("record_id").agg((F.count(F.lit(1)) > 1).alias("_r")).where("_r")
    by_time = rows.groupBy("participant_id", "issued_at").agg((F.count(F.lit(1)) > 1).alias("_t")).where("_t")
    marked = rows.join(by_record, "record_id", "left").join(by_time, ["participant_id", "issued_at"], "left")
    exact = F.array_sort(F.map_keys("features")) == F.array(*[F.lit(n) for n in sorted(features)])
    unit = F.coalesce(*[feature_problem(n, F.try_element_at("features", F.lit(n))) for n in features])
    seconds = F.pmod(F.unix_micros("issued_at"), F.lit(86_400_000_000))
    problem = (F.when((text("record_id") == "") | (text("participant_id") == ""), "missing_identity").when(~times, "not_available")
               .when(seconds != issue_hour * 3_600_000_000, "not_issue_hour").when(F.coalesce("_r", "_t", F.lit(False)), "duplicate")
               .when(~F.coalesce(exact, F.lit(False)), "wrong_features").otherwise(unit))
    return marked.select(*rows.columns, problem.alias("problem"))


def request_gate(checked: DataFrame) -> DataFrame:
    """The rows of ``request_problems`` as a request, all or none: a request with one broken row is refused whole."""
    if not checked.where("problem IS NOT NULL").isEmpty():
        raise ValueError("the request breaks a rule")
    return checked.drop("problem")


def screen_weak_absence(rows: DataFrame, text: str, method: str, weak_method: str, score: str, state: str, cues: dict[str, str], metric: str = "metric") -> DataFrame:
    """Weak references whose text shows a cue of absence lose their score and become disputed.

    Only rows whose reference came by ``weak_method`` are touched, and only metrics with a cue of their own.  Adds
    ``previous`` (the score taken away, else null) and ``reason``: the rows where it is set are the change log.
    """
    cue = F.lit(False)
    for name, pattern in cues.items():
        cue = cue | ((F.col(metric) == name) & F.col(text).rlike(pattern))
    hit = F.coalesce((F.col(method) == weak_method) & F.col(score).isNotNull() & cue, F.lit(False))
    out = rows.withColumn("previous", F.when(hit, F.col(score))).withColumn("reason", F.when(hit, "absence_or_normal_state_requires_independent_reference_review"))
    return out.withColumn(state, F.when(hit, "disputed").otherwise(F.col(state))).withColumn(score, F.when(~hit, F.col(score)))


def span_targets(tokens: DataFrame, spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """``tokens`` (key, start, end, ...) with target 1 where the token lies wholly inside one span of its text, else 0.

    One ordered pass per text: the furthest end among the spans that have begun tells whether one of them holds the
    token, so neither tokens x spans nor a list of spans per token is built.  Empty tokens are never inside.
    """
    t = tokens.select(key, F.struct(*tokens.columns).alias("_token"), F.col(start).alias("_s"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"))
    s = spans.select(key, F.lit(None).cast(t.schema["_token"].dataType).alias("_token"), F.col(start).alias("_s"), F.lit(0).alias("_kind"), F.col(end).cast("long").alias("_end"))
    order = W.partitionBy(key).orderBy("_s", "_kind").rowsBetween(W.unboundedPreceding, 0)
    out = t.unionByName(s).withColumn("_far", F.max("_end").over(order)).where("_kind = 1")
    inside = (F.col("_token")[end] <= F.col("_far")) & (F.col("_token")[end] > F.col("_token")[start])
    return out.select("_token.*", F.when(inside, 1).otherwise(0).alias("target"))
