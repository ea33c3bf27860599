"""Device and diary adapters: joins that turn source tables into one record per person-day."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronowarn.functions.stats import with_row
from chronowarn.functions import clock

# Missing markers of record tables (any case) and of the ward source.
MISSING = ("", "na", "n/a", "null", "none", "-", "--", "—", "–", "未测", "未填", "不适用", "未知")
WARD_MISSING = ("", "—", "–", "-")


def is_missing(value, markers=MISSING) -> Column:
    """NULL, or one of the source's own markers between spaces."""
    v = F.col(value) if isinstance(value, str) else value
    return v.isNull() | F.lower(F.trim(v)).isin(*markers)


def bounded_number(value, low: float, high: float) -> Column:
    """Number parsed from text, NULL outside the bounds or when not a number."""
    v = (F.col(value) if isinstance(value, str) else value).cast("string").try_cast("double")
    return F.when(v.between(low, high), v)


def clock_minutes(text) -> Column:
    """Minutes after midnight from a clock text or a day fraction; never wraps."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    hh = F.regexp_extract(t, r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$", 1).try_cast("int")
    mm = F.regexp_extract(t, r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$", 2).try_cast("int")
    ss = F.coalesce(F.regexp_extract(t, r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$", 3).try_cast("int"), F.lit(0))
    fraction = F.when(t.rlike(r"^0?\.\d+$|^0$"), t.try_cast("double"))
    return F.when((hh < 24) & (mm < 60) & (ss < 60), hh * 60 + mm + ss / 60.0).when(fraction < 1, fraction * 1440)


def partial_date(text) -> Column:
    """Full date, or month and day, or every possible reading of an ambiguous text, with a status."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    full = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(t, F.lit("yyyy-M-d")).cast("date"))
    a = F.regexp_extract(t, r"^(\d{1,2})[./-](\d{1,2})$", 1).try_cast("int")
    b = F.regexp_extract(t, r"^(\d{1,2})[./-](\d{1,2})$", 2).try_cast("int")
    days = F.array(*[F.lit(n) for n in (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)])
    fits = lambda m, d: F.coalesce((m >= 1) & (m <= 12) & (d >= 1) & (d <= F.try_element_at(days, m)), F.lit(False))
    options = F.array_distinct(F.array_compact(F.array(F.when(fits(a, b), F.format_string("%02d-%02d", a, b)), F.when(fits(b, a), F.format_string("%02d-%02d", b, a)))))
    status = (F.when(full.isNotNull(), "calendar_date").when(F.size(options) == 1, "month_day").when(F.size(options) > 1, "ambiguous")
              .when(F.coalesce(F.length(t), F.lit(0)) == 0, "missing").otherwise("invalid"))
    return F.struct(full.alias("date"), options.alias("candidates"), status.alias("status"))


def rescale_five(value, reverse: bool = False) -> Column:
    """1..5 answers to 0..10, rounding half up."""
    v = F.col(value) if isinstance(value, str) else value
    x = (F.lit(5) - v) if reverse else (v - 1)
    return F.floor(x * 2.5 + 0.5).cast("int")


def preferred(primary: str, fallback: str, maximum: float | None = None) -> Column:
    """First usable of two source columns, with the name of the column it came from."""
    def ok(c):
        v = F.col(c)
        good = v.isNotNull()
        return good & (v <= maximum) if maximum is not None else good
    value = F.when(ok(primary), F.col(primary)).when(ok(fallback), F.col(fallback))
    key = F.when(ok(primary), F.lit(primary)).when(ok(fallback), F.lit(fallback))
    return F.struct(value.alias("value"), key.alias("source_column"))


def latest_before(anchors: DataFrame, surveys: DataFrame, hours: int = 24, *, person: str = "participant_id", anchor_id: str = "anchor_id",
                  anchor_at: str = "anchor_at", at: str = "at", payload: str = "value") -> DataFrame:
    """Most recent survey within ``hours`` before each anchor.

    Time is cut into buckets of that width; a survey can only serve anchors of its own or
    the next bucket, so the equi-join meets nearby rows alone.
    """
    width = hours * 3600
    b = lambda c: F.floor(F.unix_micros(c) / 1_000_000 / width)
    left = anchors.withColumn("__b", b(anchor_at))
    right = surveys.select(person, F.col(at).alias("__at"), F.col(payload).alias("__v"), F.explode(F.array(b(at), b(at) + 1)).alias("__b"))
    near = left.join(right, [person, "__b"]).filter((F.col("__at") <= F.col(anchor_at)) & (F.col("__at") >= F.col(anchor_at) - F.expr(f"INTERVAL {hours} HOURS")))
    best = near.groupBy(anchor_id).agg(F.max(F.struct("__at", "__v")).alias("m"))
    return anchors.join(best, anchor_id, "left").select(*anchors.columns, F.col("m.__at").alias("survey_at"), F.col("m.__v").alias("survey_value"))


def naps_before(nights: DataFrame, naps: DataFrame, *, person: str = "participant_id", night_id: str = "night_id") -> DataFrame:
    """Minutes of naps in the 24 hours before waking that end before sleep onset."""
    day = 86400
    b = lambda c: F.floor(F.unix_micros(c) / 1_000_000 / day)
    left = nights.withColumn("__b", F.explode(F.array(b("wake_at") - 1, b("wake_at"))))
    right = naps.select(person, F.col("start_at").alias("__s"), F.col("end_at").alias("__e"), b("start_at").alias("__b"))
    near = left.join(right, [person, "__b"]).filter((F.col("__e") <= F.col("onset_at")) & (F.col("__s") >= F.col("wake_at") - F.expr("INTERVAL 24 HOURS")))
    minutes = near.groupBy(night_id).agg(F.sum((F.unix_micros("__e") - F.unix_micros("__s")) / F.lit(6e7)).alias("nap_minutes"), F.count(F.lit(1)).alias("naps"))
    return nights.join(minutes, night_id, "left").fillna(0, ["nap_minutes", "naps"])


def fitness_days(daily: DataFrame, hourly_sd: DataFrame, keys=("participant_id", "day")) -> DataFrame:
    """Daily tracker rows with hourly variation attached, out-of-range cells blanked, inconsistent sleep dropped,
    and rows without any measure left out."""
    d = daily.join(hourly_sd, list(keys), "left")
    d = d.withColumn("__a", bounded_number("asleep_h", 0, 24)).withColumn("__b", bounded_number("in_bed_h", 0, 24))
    d = d.withColumn("dropped_sleep", F.coalesce(F.col("__b") < F.col("__a"), F.lit(False)))
    d = d.withColumn("asleep_h", F.when(~F.col("dropped_sleep"), F.col("__a"))).withColumn("in_bed_h", F.when(~F.col("dropped_sleep"), F.col("__b")))
    return d.drop("__a", "__b").filter(F.coalesce("asleep_h", "in_bed_h", "hourly_sd").isNotNull())


def sensor_or_diary(sensor: DataFrame, diary: DataFrame, value: str, keys=("participant_id", "day")) -> DataFrame:
    """Sensor value where present, else the diary value, with which side supplied it and which sides exist."""
    s = sensor.select(*keys, F.col(value).alias("__s"), F.lit(True).alias("__has_s"))
    d = diary.select(*keys, F.col(value).alias("__d"), F.lit(True).alias("__has_d"))
    j = s.join(d, list(keys), "full")
    side = F.when(F.col("__s").isNotNull(), "sensor").when(F.col("__d").isNotNull(), "diary")
    cover = F.when(F.col("__has_s") & F.col("__has_d"), "both").when(F.col("__has_s"), "sensor_only").otherwise("diary_only")
    return j.select(*keys, F.coalesce("__s", "__d").alias(value), side.alias("side"), cover.alias("coverage"))


def pair_days(activity: DataFrame, sleep: DataFrame, keys, duration: str) -> tuple[DataFrame, DataFrame]:
    """One-to-one day pairs and a receipt: exact copies collapse, conflicting days and tied longest sleeps are excluded."""
    a, s = activity.dropDuplicates(), sleep.dropDuplicates()
    a_count = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*[c for c in a.columns if c not in keys])).alias("a"))
    top = s.groupBy(*keys).agg(F.max(duration).alias("__m"))
    longest = s.join(top, list(keys)).filter(F.col(duration) == F.col("__m")).drop("__m")
    s_count = longest.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*[c for c in s.columns if c not in keys])).alias("s"))
    pairs = a_count.filter("n = 1").select(*keys, "a.*").join(s_count.filter("n = 1").select(*keys, "s.*"), list(keys))
    receipt = (activity.agg(F.count(F.lit(1)).alias("activity_rows")).transform(with_row, a.agg(F.count(F.lit(1)).alias("activity_unique")))
               .transform(with_row, a_count.agg(F.count_if(F.col("n") > 1).alias("conflicting_days"))).transform(with_row, s_count.agg(F.count_if(F.col("n") > 1).alias("tied_days")))
               .transform(with_row, pairs.agg(F.count(F.lit(1)).alias("paired_days"))))
    return pairs, receipt
