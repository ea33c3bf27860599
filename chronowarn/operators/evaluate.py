"""Event metrics, threshold sweeps, ranking metrics and selective acceptance."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from chronowarn.functions.ordering import average_ranks, running_totals
from chronowarn.functions.stats import ratio, with_row
from chronowarn.operators import alarm

PERSON_COUNTS = ("events", "detected_events", "forecast_days", "scored_days", "labelled_days", "valid_risk_days", "true_alarms",
                 "false_alarms", "unknown_alarms", "tp", "tn", "fp", "fn")
SWEEP = ("tp", "tn", "fp", "fn", "false_alarms", "unknown_alarms", "true_alarms", "detected")


def rank_metrics(rows: DataFrame, label: str, score: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """ROC AUC from tied average ranks and average precision from cumulative counts.

    Rows are first counted per distinct score, so only distinct scores are ordered.
    """
    known = rows.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    w = F.col(weight) if weight else F.lit(1.0)
    counts = known.groupBy(*by, score).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(label) == 0, w).otherwise(0.0)).alias("neg"))
    r = running_totals(counts, score, ["pos", "neg"], by=by, descending=True)
    wins = F.col("neg") * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2)
    precision = ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    grouped = r.groupBy(*by).agg(F.sum(wins).alias("wins"), F.max("total_pos").alias("P"), F.max("total_neg").alias("N"),
                                 F.sum(precision * F.col("pos")).alias("area"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return grouped.select(*by, F.when(both, F.try_divide(F.col("wins"), F.col("P") * F.col("N"))).alias("roc_auc"),
                          F.when(both, F.try_divide("area", "P")).alias("average_precision"))


def binary_metrics(rows: DataFrame, label: str, p: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Count, Brier score, clipped log loss and AUC per group."""
    eps = 2.220446049250313e-16
    y, q = F.col(label), F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    w = F.col(weight) if weight else F.lit(1.0)
    loss = -F.when(y == 1, F.log(q)).otherwise(F.log(F.lit(1.0) - q))
    base = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("positive"), F.count_if(y == 0).alias("negative"),
                                 ratio(F.sum(w * (y - F.col(p)) * (y - F.col(p))), F.sum(w)).alias("brier"), ratio(F.sum(w * loss), F.sum(w)).alias("log_loss"))
    ranks = rank_metrics(rows, label, p, by, weight).drop("average_precision")
    return base.join(ranks, list(by), "left") if by else base.transform(with_row, ranks)


def selective_metrics(rows: DataFrame, label: str, p: str, threshold: Column, by: Sequence[str] = ()) -> DataFrame:
    """Acceptance counts at a fixed threshold; a NULL threshold accepts nothing."""
    accepted = F.coalesce(F.col(p) >= threshold, F.lit(False))
    supported = F.col(label) == 1
    a = rows.withColumn("__a", accepted)
    out = a.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("__a").alias("accepted"), F.count_if(F.col("__a") & supported).alias("accepted_supported"),
        F.count_if(F.col("__a") & ~supported).alias("false_acceptances"), F.count_if(~F.col("__a") & supported).alias("missed_supported"),
        F.count_if(supported).alias("__s"))
    return (out.withColumn("coverage", ratio("accepted", "n")).withColumn("precision", ratio("accepted_supported", "accepted"))
            .withColumn("supported_recall", ratio("accepted_supported", "__s")).drop("__s"))


def empirical_threshold(rows: DataFrame, label: str, p: str, target_precision: float, by: Sequence[str] = (), midpoint: bool = False) -> DataFrame:
    """Cutoff meeting the precision target with most supported rows, then fewest false acceptances, then the highest value."""
    counts = rows.groupBy(*by, p).agg(F.sum(F.col(label).cast("long")).alias("k"), F.count(F.lit(1)).alias("m"))
    r = running_totals(counts, p, ["k", "m"], by=by, descending=True)
    feasible = r.filter(F.try_divide("cum_k", "cum_m") >= target_precision)
    best = feasible.groupBy(*by).agg(F.max_by(F.col(p), F.struct(F.col("cum_k"), F.col("cum_k") - F.col("cum_m"), F.col(p))).alias("threshold"))
    if not midpoint:
        return best
    joined = counts.join(best, list(by)) if by else counts.transform(with_row, best)
    gap = joined.groupBy(*by, "threshold").agg(F.max(F.when(F.col(p) < F.col("threshold"), F.col(p))).alias("lower"))
    middle = F.col("lower") + (F.col("threshold") - F.col("lower")) / 2
    return gap.select(*by, F.when(F.col("lower").isNull(), 0.0).when(middle > F.col("lower"), middle).otherwise(F.col("threshold")).alias("threshold"))


# ---- alarms against events -------------------------------------------------------------

def registry_conflicts(days: DataFrame, events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positive labels whose onset is not the registered first event of that person."""
    keys = [*by, "participant_id", "onset"]
    return days.filter("label = 1").select(*keys).distinct().join(events.select(*keys), keys, "left_anti")


def event_metrics(days: DataFrame, events: DataFrame, threshold, *, by: Sequence[str] = (), consecutive: int = 2,
                  cooldown_days: int = 7, ranks: bool = True) -> DataFrame:
    """Event-level and day-level performance of one frozen threshold per group.

    ``days``: by, participant_id, day, issued_at, score, label, onset (spine rows included).
    ``events``: by, participant_id, onset of every registered first event, also of people
    without any forecast.
    """
    person = person_counts(days, events, threshold, by=by, consecutive=consecutive, cooldown_days=cooldown_days)
    out = person.groupBy(*by).agg(*[F.sum(c).alias(c) for c in PERSON_COUNTS], F.median("lead_days").alias("median_lead_days"))
    out = with_rates(out)
    if not ranks:
        return out
    scores = rank_metrics(days, "label", "score", by)
    return out.join(scores, list(by), "left") if by else out.transform(with_row, scores)


def with_rates(counts: DataFrame) -> DataFrame:
    """Rates from the count columns; NULL when a denominator is zero."""
    sens, spec = ratio("tp", F.col("tp") + F.col("fn")), ratio("tn", F.col("tn") + F.col("fp"))
    return (counts.withColumn("event_sensitivity", ratio("detected_events", "events"))
            .withColumn("false_alarms_per_30_days", ratio(F.col("false_alarms") * 30, "valid_risk_days"))
            .withColumn("alarm_ppv", ratio("true_alarms", F.col("true_alarms") + F.col("false_alarms")))
            .withColumn("risk_sensitivity", sens).withColumn("risk_specificity", spec)
            .withColumn("risk_accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))
            .withColumn("risk_balanced_accuracy", (sens + spec) / 2))


def person_counts(days: DataFrame, events: DataFrame, threshold, *, by: Sequence[str] = (), consecutive: int = 2, cooldown_days: int = 7) -> DataFrame:
    """Sufficient counts of each person: one row per (by, person), also for people with events only."""
    keys = [*by, "participant_id"]
    marked = alarm.replay(days, threshold, consecutive=consecutive, cooldown_days=cooldown_days, keys=keys)
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold).cast("double")
    rows = days.join(marked.select(*keys, "day", "warning"), [*keys, "day"])
    alarmed = F.col("warning") == 1
    known = F.col("score").isNotNull() & F.col("label").isNotNull()
    risk = F.col("score") > limit
    y1, y0 = known & (F.col("label") == 1), known & (F.col("label") == 0)
    lead = (F.unix_micros("onset") - F.unix_micros("issued_at")) / F.lit(8.64e10)
    person = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("forecast_days"), F.count("score").alias("scored_days"), F.count("label").alias("labelled_days"),
        F.count_if(alarmed & F.col("label").isNull()).alias("unknown_alarms"), F.count_if(y1 & risk).alias("tp"), F.count_if(y0 & ~risk).alias("tn"), F.count_if(y0 & risk).alias("fp"), F.count_if(y1 & ~risk).alias("fn"),
        F.count_if(known).alias("valid_risk_days"), F.count_if(alarmed & (F.col("label") == 0)).alias("false_alarms"),
        F.count_if(alarmed & (F.col("label") == 1)).alias("true_alarms"), F.max(F.when(alarmed & (F.col("label") == 1), lead)).alias("lead_days"))
    person = person.join(events.groupBy(*keys).agg(F.lit(1).alias("events")), keys, "full")
    counts = [c for c in person.columns if c not in (*keys, "lead_days")]
    return person.fillna(0, counts).withColumn("detected_events", F.col("lead_days").isNotNull().cast("int"))


PAIRS = 1 << 18      # (person, threshold) pairs replayed side by side


def threshold_steps(days: DataFrame, *, by: Sequence[str] = (), consecutive: int = 2, cooldown_days: int = 7) -> DataFrame:
    """Change of every sweep count at each of a person's own distinct scores.

    A person's alarms depend on the threshold only through that person's own scores, so
    each person is replayed once per own score (days squared at most, bounded by the
    calendar) and no threshold is ever paired with another person's rows.  The replays of
    many people are stepped side by side as arrays.
    """
    keys = [*by, "participant_id"]
    score = F.col("score").cast("double") + F.lit(0.0)
    item = F.struct(F.col("day"), score.alias("score"), F.col("label").cast("int").alias("label"))
    people = days.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("r"))
    people = people.select(*by, F.transform("r", lambda x: F.unix_date(x["day"]).cast("double")).alias("day"),
                           F.transform("r", lambda x: x["score"]).alias("score"), F.transform("r", lambda x: x["label"].cast("double")).alias("label"))
    names = [*by, "threshold", "valid", *SWEEP]

    def replays(start, size, day, score, label, person, t):
        """Sweep counts (pairs x counts) of the pairs (person, t), one step for the same day position of every pair.

        Missing days, scores and labels are NaN; scores and thresholds are positions among the batch's distinct values, of
        which NaN is the greatest.
        """
        order = np.argsort(-size[person], kind="stable")
        person, t = person[order], t[order]
        length, first = size[person], start[person]
        out = np.zeros((len(t), len(SWEEP)), np.int64)
        run, last, alarm_day = np.zeros(len(t), np.int64), np.full(len(t), np.nan), np.full(len(t), np.nan)
        for j in range(int(length[0]) if len(t) else 0):
            k = int(np.searchsorted(-length, -j, "left"))       # pairs with more than j days come first
            d, s, y, c = day[first[:k] + j], score[first[:k] + j], label[first[:k] + j], out[:k]
            known, risk = ~np.isnan(s), s > t[:k]
            held = np.where(risk, np.where(last[:k] == d - 1, run[:k], 0) + 1, 0)
            fires = (held >= consecutive) & ~(d - alarm_day[:k] < cooldown_days) & known
            last[:k], run[:k], alarm_day[:k] = d, np.where(fires, 0, held), np.where(fires, d, alarm_day[:k])
            one, zero = known & (y == 1), known & (y == 0)
            for i, hit in enumerate((one & risk, zero & ~risk, zero & risk, one & ~risk, fires & (y == 0), fires & np.isnan(y), fires & (y == 1))):
                c[:, i] += hit
            c[:, 7] |= fires & (y == 1)
        back = np.empty_like(out)
        back[order] = out
        return back

    def run(batches):
        for batch in batches:
            lists = [batch.column(len(by) + i) for i in range(3)]
            size = pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.cumsum(size) - size
            flat = lists[1].flatten()
            missing = flat.is_null().to_numpy(zero_copy_only=False)
            values, code = np.unique(np.r_[0.0, flat.to_numpy(zero_copy_only=False).astype(float)[~missing]], return_inverse=True)
            score = np.full(len(flat), np.nan)
            score[~missing] = code[1:]
            day, label = (c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in (lists[0], lists[2]))
            owner = np.repeat(np.arange(len(size)), size)
            use = ~missing
            who = np.r_[np.arange(len(size)), owner[use]]      # zero and every own score
            own = np.r_[np.full(len(size), float(code[0])), score[use]]
            valid = np.r_[np.zeros(len(size), bool), ~np.isnan(label[use])]
            order = np.lexsort((own, who))
            who, own, valid = who[order], own[order], valid[order]
            new = np.r_[True, (who[1:] != who[:-1]) | (own[1:] != own[:-1])] if len(who) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            who, own, valid = who[at], own[at], np.logical_or.reduceat(valid, at) if len(at) else valid
            counts = np.zeros((len(who), len(SWEEP)), np.int64)
            for i in range(0, len(who), PAIRS):
                part = slice(i, i + PAIRS)
                counts[part] = replays(start, size, day, score, label, who[part], own[part])
            same = np.r_[False, who[1:] == who[:-1]][:, None]
            change = counts - np.where(same, np.r_[counts[:1], counts[:-1]], 0)
            kept = batch.select(list(range(len(by)))).take(pa.array(who)) if by else None
            yield pa.RecordBatch.from_arrays([*(kept.columns if by else []), pa.array(values[own.astype(int)]), pa.array(valid), *[pa.array(change[:, i].astype(np.int32)) for i in range(len(SWEEP))]], names)

    kinds = dict(days.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "threshold double", "valid boolean", *[f"{c} int" for c in SWEEP]])
    return people.mapInArrow(run, schema)


def threshold_sweep(days: DataFrame, events: DataFrame, *, by: Sequence[str] = (), **policy) -> DataFrame:
    """Sweep counts and rates at zero and at every distinct score of the whole cohort."""
    steps = threshold_steps(days, by=by, **policy)
    jumps = steps.groupBy(*by, "threshold").agg(F.max("valid").alias("valid"), *[F.sum(c).alias(c) for c in SWEEP])
    totals = running_totals(jumps, "threshold", list(SWEEP), by=by)
    table = totals.select(*by, "threshold", "valid", *[F.col(f"cum_{c}").alias(c) for c in SWEEP]).withColumnRenamed("detected", "detected_events")
    table = table.withColumn("valid_risk_days", F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    n = events.groupBy(*by).agg(F.count(F.lit(1)).alias("events"))
    return with_rates(table.join(n, list(by), "left") if by else table.transform(with_row, n))


def choose_threshold(sweep: DataFrame, *, budget: float, by: Sequence[str] = (), objective: str = "event") -> DataFrame:
    """Best row of a sweep under the false-alarm budget.

    ``event``: event sensitivity, then fewer false alarms, then the higher threshold; a zero
    sensitivity gives no threshold.  ``balanced``: balanced accuracy, detected events, fewer
    false alarms, the higher threshold, over scores of labelled days only.
    """
    ok = sweep.filter(F.col("false_alarms_per_30_days") <= budget)
    rate = -F.col("false_alarms_per_30_days")
    if objective == "event":
        key = F.struct("event_sensitivity", rate.alias("r"), "threshold")
        best = ok.groupBy(*by).agg(F.max(key).alias("k"))
        useful = F.col("k.event_sensitivity") > 0
        return best.select(*by, F.when(useful, F.col("k.threshold")).alias("threshold"), F.col("k.event_sensitivity").alias("event_sensitivity"),
                           (-F.col("k.r")).alias("false_alarms_per_30_days"), F.when(useful, "research_calibrated").otherwise("no_useful_threshold").alias("status"))
    key = F.struct("risk_balanced_accuracy", "detected_events", rate.alias("r"), "threshold")
    best = ok.filter(F.col("valid") | (F.col("threshold") == 0)).filter("risk_balanced_accuracy IS NOT NULL").groupBy(*by).agg(F.max(key).alias("k"))
    return best.select(*by, "k.threshold", F.col("k.risk_balanced_accuracy").alias("risk_balanced_accuracy"), F.col("k.detected_events").alias("detected_events"),
                       (-F.col("k.r")).alias("false_alarms_per_30_days"))


# ---- regression-style agreement ---------------------------------------------------------

def error_set(rows: DataFrame, truth: str, predicted: str, by: Sequence[str] = (), ranks: bool = True) -> DataFrame:
    """MAE, RMSE, bias, tolerance shares, correlations and population SD ratio per group, over complete pairs."""
    t, p = F.col(truth), F.col(predicted)
    rows = rows.filter(t.isNotNull() & p.isNotNull())
    r = p - t
    a = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(r).alias("bias"),
        F.avg((F.abs(r) <= 5).cast("double")).alias("within_5"), F.avg((F.abs(r) <= 10).cast("double")).alias("within_10"),
        F.stddev_pop(t).alias("truth_sd"), F.stddev_pop(p).alias("prediction_sd"), F.covar_pop(t, p).alias("__c"))
    varies = (F.col("truth_sd") > 0) & (F.col("prediction_sd") > 0)
    spread = F.col("truth_sd") ** 2 + F.col("prediction_sd") ** 2 + F.col("bias") ** 2
    a = (a.withColumn("pearson", F.when(varies, F.try_divide(F.col("__c"), F.col("truth_sd") * F.col("prediction_sd"))))
         .withColumn("concordance", F.when(spread > 0, F.try_divide(F.col("__c") * 2, spread)))
         .withColumn("sd_ratio", F.when(F.col("truth_sd") > 0, ratio("prediction_sd", "truth_sd"))).drop("__c"))
    if not ranks:
        return a
    s = spearman(rows, truth, predicted, by)
    return a.join(s, list(by), "left") if by else a.transform(with_row, s)


def spearman(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of complete pairs: distinct values are ranked, then joined back to distinct value pairs with counts."""
    rows = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = rows.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("__m"))
    rx = average_ranks(rows, x, by, out="rx").select(*by, x, "rx", F.col("total_n").alias("__n"))
    ry = average_ranks(rows, y, by, out="ry").select(*by, y, "ry")
    j = pairs.join(rx, [*by, x]).join(ry, [*by, y])
    mid = (F.col("__n") + 1) / F.lit(2.0)
    dx, dy, m = F.col("rx") - mid, F.col("ry") - mid, F.col("__m")
    sums = j.groupBy(*by).agg(F.sum(m * dx * dy).alias("xy"), F.sum(m * dx * dx).alias("xx"), F.sum(m * dy * dy).alias("yy"))
    return sums.select(*by, F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))).alias("spearman"))


def kendall_tau_b(rows: DataFrame, level: str, score: str, levels: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Tau-b of an ordinal with few levels against a score, from cumulative level counts.

    Each row needs only how many rows of lower levels lie below, level with or above its
    score, so ordering distinct scores replaces the table of all pairs.
    """
    names = [f"l{v}" for v in levels]
    counts = rows.groupBy(*by, score).agg(*[F.sum((F.col(level) == v).cast("double")).alias(n) for v, n in zip(levels, names)])
    r = running_totals(counts, score, names, by=by)
    signed = F.lit(0.0)
    for i, hi in enumerate(names):
        for lo in names[:i]:
            below = F.col(f"cum_{lo}") - F.col(lo)
            above = F.col(f"total_{lo}") - F.col(f"cum_{lo}")
            signed = signed + F.col(hi) * (below - above)
    tie = sum((F.col(n) for n in names), F.lit(0.0))
    total = sum((F.col(f"total_{n}") for n in names), F.lit(0.0))
    level_ties = sum((F.col(f"total_{n}") * (F.col(f"total_{n}") - 1) / 2 for n in names), F.lit(0.0))
    agg = r.groupBy(*by).agg(F.sum(signed).alias("s"), F.sum(tie * (tie - 1) / 2).alias("ty"), F.max(level_ties).alias("tx"), F.max(total).alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return agg.select(*by, F.try_divide(F.col("s"), F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty")))).alias("kendall_tau_b"))
