"""Sliding calendar windows over a stream of daily vectors, with the last days of each person as keyed state."""

from collections.abc import Iterator, Sequence
from datetime import date, datetime, time, timedelta, timezone
from functools import cache
from itertools import combinations
from typing import NamedTuple
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from chronowarn.functions import clock
from chronowarn.operators.network import EPSILON

EPOCH = date(1970, 1, 1)
MEMORY = StructType([
    StructField("zone", StringType()), StructField("first", IntegerType()), StructField("closed", IntegerType()),
    StructField("day", ArrayType(IntegerType())), StructField("at", ArrayType(LongType())), StructField("vec", ArrayType(ArrayType(DoubleType())))])
OUTPUT = "participant_id long, day date, window_days int, complete_days int, longest_missing_run int, reason string, scores map<string,double>"


@cache
def _zone(name: str) -> ZoneInfo:
    return ZoneInfo(name)


class WindowRule(NamedTuple):
    """A trailing window of ``days``: complete days it needs and the longest run of missing ones it may have."""

    days: int
    minimum: int
    max_missing_run: int


def window_reason(known: np.ndarray, rule: WindowRule) -> tuple[int, int, str | None]:
    """Complete days, longest missing run and the first reason against a window, from a flag per day."""
    complete = int(known.sum())
    stops = np.flatnonzero(np.r_[True, known, True])
    longest = int(np.diff(stops).max()) - 1
    if not known[-1]:
        return complete, longest, "missing_target_day"
    if complete < rule.minimum:
        return complete, longest, "insufficient_complete_days"
    return complete, longest, "missing_run_too_long" if longest > rule.max_missing_run else None


def module_scores(rows: np.ndarray, modules: dict[str, Sequence[int]], minimum: int) -> dict[str, float | None]:
    """Classic score of every module on complete vectors (rows x features); None where ``operators.network`` has none."""
    found = grid_scores(rows[None], np.ones((1, len(rows)), bool), modules, minimum)
    return {m: None if np.isnan(v[0]) else float(v[0]) for m, v in found.items()}


def grid_scores(rows: np.ndarray, whole: np.ndarray, modules: dict[str, Sequence[int]], minimum: int) -> dict[str, np.ndarray]:
    """Classic score of every module for many windows at once: ``rows`` is windows x days x features, ``whole`` marks the
    complete vectors among them.  NaN where ``operators.network`` has none."""
    n = whole.sum(1)
    x = np.where(whole[:, :, None], rows, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(whole[:, :, None], x - (x.sum(1) / np.maximum(n, 1)[:, None])[:, None, :], 0.0)
        cov = (x[:, :, :, None] * x[:, :, None, :]).sum(1) / np.maximum(n - 1, 1)[:, None, None]
        sd = np.sqrt(np.einsum("wii->wi", cov))
        usable = (n >= max(minimum, 2)) & ~(sd <= 1e-12).any(1)
        r = np.abs(cov / (sd[:, :, None] * sd[:, None, :]))
        out = {}
        for name, module in modules.items():
            inside = sorted(module)
            outside = [i for i in range(rows.shape[2]) if i not in inside]
            internal = sum(r[:, i, j] for i, j in combinations(inside, 2)) / (len(inside) * (len(inside) - 1) / 2)
            external = sum(r[:, i, j] for i in inside for j in outside) / (len(inside) * len(outside))
            score = sum(sd[:, i] for i in inside) / len(inside) * internal / external
            out[name] = np.where(usable & (external > EPSILON), score, np.nan)
    return out


class WindowProcessor(StatefulProcessor):
    """Closes a person's calendar days in order and keeps no more days than the longest window has.

    A day closes when the watermark passes the local hour at which it is looked back on.  Until then its row may come
    in any order; afterwards a row still serves later windows as long as one can reach it.  Rows that no window can
    reach any more, rows before a person's first closed day, and a second row of a day go out with a reason.
    """

    def __init__(self, rules: Sequence[WindowRule], modules: dict[str, Sequence[int]], minimum: int):
        self.rules, self.modules, self.minimum = list(rules), modules, minimum
        self.reach = max(r.days for r in rules)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("memory", MEMORY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["day", "at"], kind="stable")
        zone, first, closed, days, at, vecs = self._read()
        held, refused, waiting = set(days), [], (self._next(days, closed), zone)
        for day, when, vec, zone in zip(pd.to_datetime(batch["day"]).to_numpy("datetime64[D]").astype(int).tolist(), batch["at"].tolist(), batch["vec"], batch["timezone"]):
            if day in held:
                refused.append((day, "rejected_replay"))
            elif closed is not None and (day <= closed - self.reach + 1 or day < first):
                refused.append((day, "rejected_late"))
            else:
                held.add(day)
                days.append(day)
                at.append(int(when))
                vecs.append([None if v is None or np.isnan(v) else float(v) for v in vec] if vec is not None else None)
                first = day if first is None else min(first, day)
        self._wake(days, closed, zone, waiting)
        self.state.update((zone, first, closed, days, at, vecs))
        if refused:
            yield self._table(key[0], [(day, None, None, None, reason, None) for day, reason in refused])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        zone, first, closed, days, at, vecs = self._read()
        now = timerValues.getCurrentWatermarkInMs()
        target = max((d for d in days if (closed is None or d > closed) and self._closing(d, zone) // 1000 < now), default=None)
        out = []
        if target is not None and (closed is None or target > closed):
            out = self._close(range(first if closed is None else closed + 1, target + 1), zone, days, at, vecs)
            closed = target
            keep = [i for i, d in enumerate(days) if d > target - self.reach + 1]
            self.state.update((zone, first, target, [days[i] for i in keep], [at[i] for i in keep], [vecs[i] for i in keep]))
        self._wake(days, closed, zone)
        if out:
            yield self._table(key[0], out)

    def close(self) -> None:
        pass

    def _read(self):
        return [*self.state.get()][:3] + [list(x) for x in [*self.state.get()][3:]] if self.state.exists() else [None, None, None, [], [], []]

    @staticmethod
    def _next(days: list, closed: int | None) -> int | None:
        """Earliest day that is still open."""
        return min((d for d in days if closed is None or d > closed), default=None)

    def _wake(self, days: list, closed: int | None, zone: str, waiting: tuple | None = None) -> None:
        """One timer a person, for the earliest open day; it sets the next when it has closed what it could."""
        day = self._next(days, closed)
        if day is not None and (day, zone) != waiting:
            self.handle.registerTimer(self._closing(day, zone) // 1000 + 1)

    @staticmethod
    def _closing(day: int, zone: str) -> int:
        """Microseconds of the hour at which forecasts are issued on the local day after ``day``."""
        local = datetime.combine(EPOCH + timedelta(days=day + 1), time(clock.ISSUE_HOUR), _zone(zone))
        return int(local.astimezone(timezone.utc).timestamp()) * 1_000_000

    def _close(self, closing: range, zone: str, days: list, at: list, vecs: list) -> list[tuple]:
        """Rows of the days in ``closing`` under every rule; the days' windows are taken from one grid of the person."""
        low = closing.start - self.reach + 1
        width = max((len(v) for v in vecs if v is not None), default=0)
        arrived = np.full(closing.stop - low, np.iinfo(np.int64).max)
        grid = np.full((closing.stop - low, width), np.nan)
        for d, a, v in zip(days, at, vecs):
            if low <= d < closing.stop:
                arrived[d - low] = a
                if v is not None:
                    grid[d - low] = [np.nan if x is None else x for x in v]
        as_of = np.array([self._closing(day, zone) for day in closing])
        found = {}
        for rule in self.rules:
            place = np.arange(len(closing))[:, None] + self.reach - rule.days + np.arange(rule.days)
            known = arrived[place] <= as_of[:, None]
            rows = grid[place]
            whole = known & ~np.isnan(rows).any(2) if width else np.zeros_like(known)
            scores = grid_scores(rows, whole, self.modules, self.minimum) if width else {m: np.full(len(closing), np.nan) for m in self.modules}
            for i, day in enumerate(closing):
                found[day, rule] = (day, rule.days, *window_reason(known[i], rule), {m: None if np.isnan(v[i]) else float(v[i]) for m, v in scores.items()})
        return [found[day, rule] for day in closing for rule in self.rules]

    @staticmethod
    def _table(person, rows) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["day", "window_days", "complete_days", "longest_missing_run", "reason", "scores"])
        out["day"] = pd.Series([EPOCH + timedelta(days=d) for d in out["day"]], dtype=object)
        for c in ("window_days", "complete_days", "longest_missing_run"):
            out[c] = out[c].astype("Int32")
        out.insert(0, "participant_id", person)
        return out


def window_stream(vectors: DataFrame, rules: Sequence[WindowRule], modules: dict[str, Sequence[int]], *, minimum: int = 8, delay: str = "1 hour") -> DataFrame:
    """Windows of a stream of (participant_id, day, vec, available_at, timezone), one row per closed day and rule.

    A day counts as complete in a window if its row had arrived by the window's own closing hour, as in
    ``operators.windows.select_window``; scores are the classic ones over the complete vectors known by then.  The
    watermark runs on ``available_at`` with ``delay``.  Days that have no row close with the next day that has one.
    """
    timed = vectors.withWatermark("available_at", delay)
    timed = timed.select("participant_id", "day", "vec", "available_at", "timezone", F.unix_micros("available_at").alias("at"))
    return timed.groupBy("participant_id").transformWithStateInPandas(
        statefulProcessor=WindowProcessor(rules, modules, minimum), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
