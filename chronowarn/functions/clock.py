"""Local research days, forecast schedule and circular clock arithmetic as columns.

A research day runs from 04:00 to 04:00 local time.  Every function takes the time
zone as a column, so one job serves people in many zones.
"""

from pyspark.sql import Column, functions as F

BOUNDARY_HOUR = 4
ISSUE_HOUR = 12
DAY_HOURS = 24.0
TURN = 1e-9
OFFSET_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def local_time(ts, tz) -> Column:
    """Wall-clock time of an instant in the zone held by ``tz``."""
    return F.from_utc_timestamp(_col(ts), _col(tz))


def research_day(ts, tz, boundary_hour: int = BOUNDARY_HOUR) -> Column:
    """Local date, one day earlier while the local hour is before the boundary."""
    local = local_time(ts, tz)
    return F.date_sub(F.to_date(local), (F.hour(local) < boundary_hour).cast("int"))


def wall_clock(day, hour: int) -> Column:
    return F.timestamp_seconds(F.unix_date(_col(day)).cast("long") * 86400 + hour * 3600)


def local_boundary(day, tz, hour: int = BOUNDARY_HOUR) -> Column:
    """Instant of a wall-clock hour on a local day."""
    return F.to_utc_timestamp(wall_clock(day, hour), _col(tz))


def is_nonexistent(local, tz) -> Column:
    """True where a wall-clock time is skipped by a clock change in its zone."""
    return F.from_utc_timestamp(F.to_utc_timestamp(_col(local), _col(tz)), _col(tz)) != _col(local)


def is_ambiguous(local, tz) -> Column:
    """True where a wall-clock time happens twice (an hour repeated by a clock change)."""
    base = F.to_utc_timestamp(_col(local), _col(tz))
    hour = F.expr("INTERVAL 1 HOUR")
    again = lambda t: F.from_utc_timestamp(t, _col(tz)) == _col(local)
    return again(base) & (again(base - hour) | again(base + hour))


def parse_instant(text) -> Column:
    """ISO text with an explicit offset to an instant; NULL for naive or malformed text."""
    value = _col(text)
    return F.when(value.rlike(OFFSET_TIMESTAMP), F.try_to_timestamp(value))


def forecast_bounds(issued_at, tz) -> Column:
    """Struct of the completed day, its 04:00 cutoff and whether issue is exactly local noon."""
    local = local_time(issued_at, tz)
    today = F.to_date(local)
    on_schedule = local == wall_clock(today, ISSUE_HOUR)
    return F.struct(
        F.when(on_schedule, F.date_sub(today, 1)).alias("day"),
        F.when(on_schedule, local_boundary(today, tz)).alias("cutoff"),
        on_schedule.alias("on_schedule"),
    )


def available_as_of(start, end, available_at, cutoff, issued_at) -> Column:
    """The whole event precedes the cutoff and had arrived when the forecast was issued."""
    return (_col(start) < _col(cutoff)) & (_col(end) <= _col(cutoff)) & (_col(available_at) <= _col(issued_at))


def clock_hour(ts, tz) -> Column:
    """Decimal local clock hour, to the second."""
    local = local_time(ts, tz)
    return F.hour(local) + F.minute(local) / F.lit(60.0) + F.second(local) / F.lit(3600.0)


def _turned(value: Column, period: float) -> Column:
    """``value`` modulo the period, 0 for what lies within ``TURN`` of the full period."""
    rest = F.pmod(value, F.lit(period))
    return F.when(rest > period - TURN, F.lit(0.0)).otherwise(rest)


def clock_delta(value, center, period: float = DAY_HOURS) -> Column:
    """Signed shortest way round the clock from ``center`` to ``value``; half a turn is negative, whatever its rounding."""
    return _turned(_col(value) - _col(center) + F.lit(period / 2), period) - F.lit(period / 2)


def circular_distance(a, b, period: float = 1440.0) -> Column:
    return F.abs(clock_delta(a, b, period))


def sleep_midpoint(start_hour, end_hour) -> Column:
    """Middle of two clock hours that may cross midnight."""
    span = F.pmod(_col(end_hour) - _col(start_hour), F.lit(DAY_HOURS))
    return F.when(span > 0, F.pmod(_col(start_hour) + span / 2, F.lit(DAY_HOURS)))


def clocks_from_midpoint(midpoint_h, duration_h) -> Column:
    """Start and end clock texts with microseconds from a midpoint and a duration."""
    def text(hour: Column) -> Column:
        micros = F.round(F.pmod(hour, F.lit(DAY_HOURS)) * F.lit(3.6e9)).cast("long") % F.lit(86_400_000_000)
        return F.format_string(
            "%02d:%02d:%02d.%06d",
            (micros / 3_600_000_000).cast("long"), ((micros / 60_000_000).cast("long") % 60),
            ((micros / 1_000_000).cast("long") % 60), micros % 1_000_000,
        )
    half = _col(duration_h) / 2
    return F.struct(text(_col(midpoint_h) - half).alias("start"), text(_col(midpoint_h) + half).alias("end"))


def _angle(value, period: float) -> Column:
    return F.pmod(_col(value), F.lit(period)) / F.lit(period) * F.lit(2.0) * F.pi()


def circular_parts(value, period: float = DAY_HOURS):
    """A row's terms of ``circular_sums``, for sums that meet a row more than once."""
    return _col(value).isNotNull().cast("int"), F.cos(_angle(value, period)), F.sin(_angle(value, period))


def circular_sums(value, period: float = DAY_HOURS):
    """Partial-aggregable pieces: count, sum of cosines, sum of sines."""
    return (F.count(_col(value)), F.sum(F.cos(_angle(value, period))), F.sum(F.sin(_angle(value, period))))


def circular_from_sums(n: Column, c: Column, s: Column, period: float = DAY_HOURS, minimum: int = 1):
    """Circular mean and SD from the three sums; NULL below ``minimum`` or with no direction.

    A mean within ``TURN`` of the full period is 0, so the order of a sum does not decide between 0 and 24.
    """
    length = F.sqrt(c * c + s * s) / n
    usable = (n >= minimum) & (length > 1e-12)
    scale = F.lit(period) / (2 * F.pi())
    mean = F.when(usable, _turned(F.atan2(s, c) * scale, period))
    sd = F.when(usable, F.sqrt(F.lit(-2.0) * F.log(F.least(F.lit(1.0), length))) * scale)
    return mean, sd


def circular_summary(value, period: float = DAY_HOURS, minimum: int = 1, window=None):
    """Circular mean and SD as aggregates, or over a window when one is given."""
    parts = circular_sums(value, period)
    if window is not None:
        parts = tuple(p.over(window) for p in parts)
    return circular_from_sums(*parts, period=period, minimum=minimum)
