"""Row rules as columns: every check yields a reason, nothing is repaired silently."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Provenance kinds from most to least trustworthy.
KINDS = ("observed", "derived", "synthetic", "constructed", "unknown")


def first_reason(*rules: tuple[Column, str]) -> Column:
    """Reason of the first rule that holds, NULL when none does."""
    out = None
    for condition, reason in rules:
        hit = F.coalesce(condition, F.lit(False))
        out = F.when(hit, reason) if out is None else out.when(hit, reason)
    return out


def observation_reason(duplicate: Column) -> Column:
    """Order of checks for one observation row."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    v = F.col("value")
    return first_reason(
        (blank("observation_id") | blank("participant_id") | blank("variable"), "missing_identity"), (duplicate, "duplicate_id"),
        ((F.col("end_at") < F.col("start_at")) | (F.col("available_at") < F.col("end_at")), "time_order"),
        (~F.col("kind").isin(*KINDS), "unknown_provenance_kind"), (v.isNotNull() & (F.isnan(v) | (F.abs(v) == float("inf"))), "nonfinite_value"))


def validate_observations(rows: DataFrame) -> DataFrame:
    """Add ``reason``; ids are counted by a partial aggregate and only repeated ids are joined back."""
    repeated = rows.groupBy("observation_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("observation_id", F.lit(True).alias("__dup"))
    return rows.join(repeated, "observation_id", "left").withColumn("reason", observation_reason(F.coalesce("__dup", F.lit(False)))).drop("__dup")


def strict(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """Fail the job on the first row that carries a reason."""
    return rows.withColumn(reason, F.when(F.col(reason).isNotNull(), F.raise_error(F.concat(F.lit("invalid row: "), F.col(reason)))).otherwise(F.lit(None).cast("string")))


def eligible_measurement(provenance: str = "provenance") -> Column:
    """Independent observed or derived measurements with a named and hashed source."""
    p = F.col(provenance)
    filled = lambda f: F.coalesce(F.trim(p[f]) != "", F.lit(False))
    return p["kind"].isin("observed", "derived") & F.coalesce(p["independent"], F.lit(False)) & filled("source_id") & filled("source_hash")


def gate_feature(name: str = "name") -> Column:
    """First of the ordered reasons why a feature value cannot enter a vector as of ``as_of``.

    Columns: day_end, as_of, value, reason, unit, expected_unit, definition, expected_definition,
    available_at, measured_until, day_start, provenance, coverage and the name.
    """
    v, n = F.col("value"), F.col(name)
    clock, text = F.col("is_clock"), n.startswith("text_")
    measured = F.col("measured_until")
    return F.when(F.coalesce(F.col("day_end") > F.col("as_of"), F.lit(False)), "unfinished_research_day").when(
        v.isNull(), F.coalesce("reason", F.lit("missing"))).otherwise(first_reason(
            (F.isnan(v) | (F.abs(v) == float("inf")), "invalid_value"), (F.col("unit") != F.col("expected_unit"), "unit_mismatch"),
            (~F.col("definition").eqNullSafe(F.col("expected_definition")), "measurement_definition_mismatch"), (F.col("available_at") > F.col("as_of"), "not_available"),
            (measured.isNull() | (measured < F.col("day_start")) | (measured > F.col("day_end")) | (measured > F.col("available_at")), "unverified_measurement_cutoff"),
            (~eligible_measurement(), "ineligible_provenance"), (F.col("coverage").isNull() | (F.col("coverage") <= 0) | (F.col("coverage") > 1), "no_coverage"),
            (clock & ~((v >= 0) & (v < 24)), "clock_out_of_range"), (text & ~v.between(0, 100), "text_score_out_of_range"),
            ((n == "activity_ra") & ~v.between(0, 1), "ratio_out_of_range"), ((n == "sleep_duration_h") & (v > 24), "duration_out_of_range"),
            ((n == "resting_hr_bpm") & ~v.between(20, 250), "physiology_out_of_range"), (~clock & (v < 0), "negative_measurement")))


def bound_reason(value, low, high, exclusive_max, integral) -> Column:
    """Per-feature bounds: exclusive upper end for clocks, exact integers for counts and codes."""
    v = F.col(value)
    return first_reason((v < F.col(low), "below_minimum"), (F.when(F.col(exclusive_max), v >= F.col(high)).otherwise(v > F.col(high)), "above_maximum"),
                        (F.col(integral) & (v != F.floor(v)), "not_an_integer"))


def cross_conflicts(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of the cross-field rules a row breaks."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))


def failure_counts(rows: DataFrame, checks: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows failing each check (overlapping), and rows passing all."""
    ok = F.lit(True)
    for c in checks.values():
        ok = ok & F.coalesce(c, F.lit(False))
    aggs = [F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *aggs, F.count_if(ok).alias("all_passed"))


def audit_sequence(rows: DataFrame, person: str = "participant_id", day: str = "day") -> DataFrame:
    """Per person: rows, gaps between days, repeated days and distinct outcomes in a daily sequence."""
    order = W.partitionBy(person).orderBy(day)
    step = F.datediff(F.col(day), F.lag(day).over(order))
    return rows.withColumn("__s", step).groupBy(person).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("__s") > 1).alias("gaps"), F.count_if(F.col("__s") == 0).alias("repeats"), F.max("__s").alias("longest_step"))


def fill_only_blank(rows: DataFrame, evidence: DataFrame, key: str, column: str) -> DataFrame:
    """Fill blanks from evidence, keep present values, and say for each row what happened."""
    j = rows.join(evidence.select(key, F.col(column).alias("__e")), key, "left")
    fate = (F.when(F.col(column).isNull() & F.col("__e").isNotNull(), "restored").when(F.col(column).isNull(), "still_blank")
            .when(F.col("__e").isNull() | (F.col(column) == F.col("__e")), "unchanged").otherwise("conflict"))
    return j.withColumn("fate", fate).withColumn(column, F.coalesce(column, "__e")).drop("__e")


def compare_cells(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Cell-level differences of two versions of a table, including rows on one side only."""
    def long(df, side):
        return df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("z")).select(
            key, "z.column", F.col("z.v").alias(side), F.lit(True).alias(f"has_{side}"))
    j = long(left, "l").join(long(right, "r"), [key, "column"], "full")
    same = F.coalesce(F.abs(F.col("l") - F.col("r")) <= tolerance, F.col("l").isNull() & F.col("r").isNull())
    problem = F.when(F.col("has_r").isNull(), "missing_right").when(F.col("has_l").isNull(), "missing_left").when(~same, "different")
    return j.withColumn("problem", problem).groupBy("column").agg(F.count(F.lit(1)).alias("cells"), *[F.count_if(F.col("problem") == p).alias(p) for p in ("missing_right", "missing_left", "different")])


def inventory_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (with multiplicity) present on one side only; empty on both sides means equal inventories."""
    return left.exceptAll(right).withColumn("side", F.lit("left_only")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right_only")))


def merge_lineage(parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lineage of a derived value: least trustworthy parent kind (a mix with synthetic is unknown), parent digest, all independent.

    The parent digest is order-free (sums of digest pieces), so no parent list is gathered.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    piece = F.conv(F.substring(F.md5(F.concat_ws("|", "source_id", "source_hash", "kind")), 1, 8), 16, 10).cast("long")
    g = parents.groupBy(*keys).agg(F.max(rank).alias("r"), F.count_if(F.col("kind") == "synthetic").alias("s"), F.count(F.lit(1)).alias("parents"),
                                   F.bool_and(F.col("independent") & (F.col("source_id") != "") & (F.col("source_hash") != "")).alias("independent"), F.sum(piece).alias("parent_digest"))
    kind = F.when((F.col("s") > 0) & (F.col("s") < F.col("parents")), "unknown").when(F.col("r") <= 2, "derived").otherwise(
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("r").cast("int")))
    return g.select(*keys, kind.alias("kind"), "parents", "independent", "parent_digest")


def missing_cells(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing cells per column before and after completion."""
    def long(df, name):
        row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias(name)) for c in columns])).alias("z")).select("z.*")
    return long(before, "missing_before").join(long(after, "missing_after"), "column")
