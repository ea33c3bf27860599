"""Independent endpoint rules: criteria, anchors, daily assessments, events and future labels."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronowarn.functions import clock
from chronowarn.functions.ordering import weighted_quantile
from chronowarn.operators.windows import qualifying_runs
from chronowarn.session import materialise

DOMAINS = ("S1", "E1", "A1")
MARGIN = 1e-10      # equal values must not pass for a difference by the order of a sum


def valid_domain(value, domain: str) -> Column:
    """Nonnegative, and at most one for the activity domain; missing values pass."""
    v = F.col(value) if isinstance(value, str) else value
    ok = v >= 0
    return F.coalesce(ok & (v <= 1) if domain == "A1" else ok, F.lit(True))


def personal_anchor(outcomes: DataFrame, *, baseline_days: int = 14, window: int = 7, minimum: int = 6) -> DataFrame:
    """Median of complete baseline window measures per person (days 7..14 of the baseline).

    ``outcomes`` is a spine starting at the first baseline day; groups hold at most
    ``baseline_days`` rows.  Where it has a column ``baseline_start``, only baseline rows move.
    """
    if "baseline_start" not in outcomes.columns:
        outcomes = outcomes.withColumn("baseline_start", F.min("day").over(W.partitionBy("participant_id")))
    offset = F.datediff("day", "baseline_start")
    rows = outcomes.filter((offset >= window - 1) & (offset < baseline_days))
    complete = F.lit(True)
    for d in DOMAINS:
        complete = complete & F.col(d).isNotNull()
    med = rows.filter(complete).groupBy("participant_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.median(d).alias(f"anchor_{d}") for d in DOMAINS])
    return med.filter(F.col("n") >= minimum).drop("n")


def fit_criteria(stable: DataFrame, quantile: float, minimum_people: int) -> DataFrame:
    """Absolute and positive-increase bounds per domain; every person carries total weight one.

    ``stable`` holds participant_id, the domain values and their anchors.  No rows come back
    when fewer than ``minimum_people`` people contribute.
    """
    long = stable.select("participant_id", F.explode(F.array(*[
        F.struct(F.lit(d).alias("domain"), F.col(d).cast("double").alias("level"), F.col(f"anchor_{d}").alias("anchor"))
        for d in DOMAINS])).alias("z")).select("participant_id", "z.*").filter("level IS NOT NULL AND anchor IS NOT NULL")
    own = F.count(F.lit(1)).over(W.partitionBy("participant_id", "domain"))
    change = F.greatest(F.lit(0.0), F.col("level") - F.col("anchor"))
    weighted = materialise(long.select("participant_id", "domain", (F.lit(1.0) / own).alias("weight"), F.explode(F.array(
        F.struct(F.lit("absolute").alias("bound"), F.col("level").alias("value")),
        F.struct(F.lit("increase").alias("bound"), change.alias("value")))).alias("z")).select("participant_id", "domain", "weight", "z.*"), "criteria")
    bounds = weighted_quantile(weighted, "value", "weight", quantile, by=["domain", "bound"])
    wide = bounds.groupBy("domain").agg(*[F.max(F.when(F.col("bound") == b, F.col("quantile"))).alias(b) for b in ("absolute", "increase")])
    people = weighted.select("domain", "participant_id").distinct().groupBy("domain").agg(F.count(F.lit(1)).alias("people"))
    return wide.join(people, "domain").filter(F.col("people") >= minimum_people)


def freeze_criteria(criteria: DataFrame) -> dict[str, tuple[float, float]]:
    """The three fitted pairs of bounds as literals for later plans."""
    return {r["domain"]: (r["absolute"], r["increase"]) for r in criteria.select("domain", "absolute", "increase").take(len(DOMAINS))}


def assess(outcomes: DataFrame, criteria: dict[str, tuple[float, float]]) -> DataFrame:
    """Abnormal domains of each day: above the level bound and above the personal increase bound, each by ``MARGIN``."""
    evaluable = F.lit(set(criteria) == set(DOMAINS))
    for d in DOMAINS:
        evaluable = evaluable & F.col(d).isNotNull() & F.col(f"anchor_{d}").isNotNull()
    hits = []
    for d in DOMAINS:
        absolute, increase = criteria.get(d, (None, None))
        hit = (F.col(d) > F.lit(absolute) + MARGIN) & (F.col(d) - F.col(f"anchor_{d}") > F.lit(increase) + MARGIN)
        hits.append(F.when(evaluable & hit, F.lit(d)))
    return outcomes.withColumn("evaluable", evaluable).withColumn("abnormal", F.array_compact(F.array(*hits)))


def detect_events(assessments: DataFrame, *, persistence: int = 3, minimum_domains: int = 2, first_only: bool = True) -> DataFrame:
    """Sustained multi-domain runs; onset is the end of the first day of the run.

    A later run counts only after an evaluable day with fewer abnormal domains; a missing
    day ends a run but does not re-arm detection.
    """
    many = F.col("evaluable") & (F.size("abnormal") >= minimum_domains)
    order = W.partitionBy("participant_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    armed = assessments.withColumn("epoch", F.sum((F.col("evaluable") & (F.size("abnormal") < minimum_domains)).cast("int")).over(order))
    runs = qualifying_runs(armed, many, persistence)
    head = runs.filter(F.col("confirmed") & (F.col("run_position") <= persistence))
    found = head.groupBy("participant_id", "timezone", "epoch", "run_start").agg(F.max("available_at").alias("confirmed_at"))
    first = ["participant_id"] if first_only else ["participant_id", "epoch"]
    picked = found.groupBy(*first).agg(F.min_by(F.struct("timezone", "run_start", "confirmed_at"), "run_start").alias("e"))
    return picked.select("participant_id", "e.timezone", F.col("e.run_start").alias("onset_day"),
                         clock.local_boundary(F.date_add("e.run_start", 1), "e.timezone").alias("onset"), "e.confirmed_at")


def _observed_runs(observed: DataFrame) -> DataFrame:
    """Each observed day with the first day of its unbroken run (``run_from``)."""
    order = W.partitionBy("participant_id").orderBy("day")
    days = observed.select("participant_id", "day").distinct()
    opens = F.coalesce(F.lag("day").over(order) < F.date_sub("day", 1), F.lit(True))
    flagged = days.withColumn("__o", F.when(opens, F.col("day")))
    return flagged.select("participant_id", "day", F.max("__o").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("run_from"))


def future_labels(forecasts: DataFrame, events: DataFrame, observed: DataFrame, *, horizon_days: int = 7,
                  min_lead_hours: int = 24, confirmation_days: int = 2) -> DataFrame:
    """Label each forecast 0, 1 or NULL with a reason.

    ``forecasts``: participant_id, timezone, issued_at, followup_end, known_until.
    ``events``: at most one first event per person.  ``observed``: evaluable person-days.
    The required days are covered when the run of observed days that holds the last of them starts no later than the
    first: one equi-join on (person, day).
    """
    first = events.select("participant_id", "onset", "confirmed_at")
    f = forecasts.join(first, "participant_id", "left")
    end = F.col("issued_at") + F.expr(f"INTERVAL {horizon_days} DAYS")
    future = (F.col("onset") > F.col("issued_at")) & (F.col("onset") <= end)
    f = f.withColumn("has_event", F.coalesce(future, F.lit(False)))
    f = f.withColumn("needed_end", F.when(F.col("has_event"), F.col("confirmed_at")).otherwise(end + F.expr(f"INTERVAL {confirmation_days} DAYS")))
    f = f.withColumn("first_day", clock.research_day("issued_at", "timezone"))
    f = f.withColumn("last_day", F.date_sub(clock.research_day("needed_end", "timezone"), 1))
    f = f.join(_observed_runs(observed).withColumnRenamed("day", "last_day"), ["participant_id", "last_day"], "left")
    covered = (F.col("last_day") < F.col("first_day")) | F.coalesce(F.col("run_from") <= F.col("first_day"), F.lit(False))
    too_soon = F.col("has_event") & (F.col("onset") < F.col("issued_at") + F.expr(f"INTERVAL {min_lead_hours} HOURS"))
    reason = (F.when(F.col("onset") <= F.col("issued_at"), "not_at_risk_after_first_event")
              .when(too_soon, "event_inside_minimum_lead")
              .when((F.col("followup_end") < F.col("needed_end")) | (F.col("known_until") < F.col("needed_end")), "right_censored_or_unconfirmed")
              .when(~covered, "outcome_coverage_gap")
              .when(F.col("has_event"), "confirmed_future_event").otherwise("complete_event_free_followup"))
    f = f.withColumn("reason", reason)
    label = F.when(F.col("reason") == "confirmed_future_event", 1).when(F.col("reason") == "complete_event_free_followup", 0)
    return f.withColumn("label", label).withColumn("label_onset", F.when(F.col("label") == 1, F.col("onset"))).drop(
        "has_event", "run_from", "first_day", "last_day", "onset", "confirmed_at")


def monitoring_calendar(periods: DataFrame, forecasts: DataFrame, keys: Sequence[str] = ("participant_id",)) -> DataFrame:
    """Every registered issue day; days without a forecast stay with NULL score and label."""
    days = periods.select(*keys, F.explode(F.sequence("first_day", "last_day")).alias("day"))
    return days.join(forecasts, [*keys, "day"], "left")


def calendar_conflicts(periods: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Overlapping registrations, duplicate forecasts and forecasts off the registered days, as counts."""
    days = periods.select("participant_id", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    expected = days.groupBy("participant_id", "day").agg(F.count(F.lit(1)).alias("registered"))
    given = forecasts.groupBy("participant_id", "day").agg(F.count(F.lit(1)).alias("submitted"))
    both = expected.join(given, ["participant_id", "day"], "full")
    return both.agg(F.count_if(F.col("registered") > 1).alias("overlapping"), F.count_if(F.col("submitted") > 1).alias("duplicated"),
                    F.count_if(F.col("registered").isNull()).alias("unregistered"), F.count_if(F.col("submitted").isNull()).alias("absent"))


def annotate_candidates(daily: DataFrame, *, window: int, window_min: int, baseline_days: int, baseline_min: int,
                        baseline_windows: int, quantile: float, persistence: int, minimum_domains: int = 2) -> DataFrame:
    """Retrospective candidate states against each person's own first baseline.

    ``daily`` is a spine with columns a, b, c (circular, linear, circular) and ``recorded``.
    Thresholds are 'higher' quantiles of the person's baseline windows; bounds compare
    with a 1e-10 margin.
    """
    person = W.partitionBy("participant_id")
    frame = person.orderBy("day").rowsBetween(-(window - 1), 0)
    whole = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("c").isNotNull()
    d = daily.withColumn("whole", whole).withColumn("start", F.min("day").over(person))
    n = F.count(F.when(F.col("whole"), 1)).over(frame)
    _, sa = clock.circular_summary(F.when(F.col("whole"), F.col("a")), window=frame)
    _, sc = clock.circular_summary(F.when(F.col("whole"), F.col("c")), window=frame)
    mid = F.array_sort(F.collect_list(F.when(F.col("whole"), F.col("b"))).over(frame))
    d = d.withColumn("__n", n).withColumn("__sa", sa).withColumn("__sc", sc).withColumn("__m", mid)
    half = (F.size("__m") / 2).cast("int")
    median = F.when(F.size("__m") == 0, None).when(F.size("__m") % 2 == 1, F.get("__m", half)).otherwise(
        (F.get("__m", half - 1) + F.get("__m", half)) / 2)
    usable = (F.col("__n") >= window_min) & F.col("__sa").isNotNull() & F.col("__sc").isNotNull()
    d = d.withColumn("m_a", F.when(usable, F.col("__sa"))).withColumn("m_b", F.when(usable, median)).withColumn("m_c", F.when(usable, F.col("__sc")))
    d = d.withColumn("offset", F.datediff("day", "start"))
    inside = F.col("offset").between(window - 1, baseline_days)
    k = F.col("__k")
    d = d.withColumn("__k", F.count(F.when(inside, F.col("m_a"))).over(person))
    for m in "abc":
        ordered = F.array_sort(F.collect_list(F.when(inside, F.col(f"m_{m}"))).over(person))
        position = F.ceil((k - 1) * F.lit(quantile)).cast("int") + 1
        d = d.withColumn(f"t_{m}", F.when(k > 0, F.try_element_at(ordered, position)))
    base_days = F.count(F.when(F.col("whole") & (F.col("offset") < baseline_days), 1)).over(person)
    ok = (base_days >= baseline_min) & (k >= baseline_windows) & (F.max("offset").over(person) >= baseline_days)
    d = d.withColumn("__ok", ok)
    above = [F.when(F.col(f"m_{m}") > F.col(f"t_{m}") + 1e-10, F.lit(m)) for m in "abc"]
    d = d.withColumn("abnormal", F.array_compact(F.array(*above)))
    status = (F.when(F.col("offset") < baseline_days, "baseline_only").when(~F.col("__ok"), "insufficient_baseline")
              .when(F.col("offset") < baseline_days + window - 1, "followup_window_incomplete")
              .when(F.col("m_a").isNull() | ~F.col("whole"), "insufficient_window")
              .when(F.size("abnormal") >= minimum_domains, "above_threshold").otherwise("no_candidate_worsening"))
    d = d.withColumn("status", status).filter("recorded")
    runs = qualifying_runs(d, F.col("status") == "above_threshold", persistence)
    final = (F.when(F.col("qualifies") & F.col("confirmed"), "candidate_confirmed").when(F.col("qualifies"), "persistence_not_confirmed").otherwise(F.col("status")))
    state = F.when(final == "candidate_confirmed", 1).when(final == "no_candidate_worsening", 0)
    onset = F.when(F.col("confirmed") & F.col("qualifies"), F.col("run_start"))
    return runs.select("participant_id", "day", final.alias("status"), state.alias("candidate_state"), onset.alias("onset_day"),
                       F.when(onset.isNotNull(), F.date_add(onset, persistence - 1)).alias("confirmed_day"),
                       F.concat_ws(",", F.when(F.col("status").isin("above_threshold", "no_candidate_worsening"), F.col("abnormal"))).alias("abnormal"))
