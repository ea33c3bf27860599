"""Clock hours half a turn apart: days and people without a direction, and spans of exactly twelve hours."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronowarn.functions import clock

SOURCE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Person 400 has a day without a mean clock within the baseline; person 404 has two days whose mean clocks cancel.

    People from 408 on have one day of exactly twelve hours each, every second one past midnight.
    """
    out = str(tmp_path_factory.mktemp("halves"))
    days = [(400, f"2024-01-{d:02d} {7 + d % 5:02d}:{d:02d}:00") for d in range(2, 26)]
    days += [(400, "2024-01-08 06:00:00"), (400, "2024-01-08 18:00:00"), (404, "2024-01-10 06:00:00"), (404, "2024-01-11 18:00:00")]
    days = [d for d in days if d != (400, "2024-01-08 10:08:00")]
    for i in range(60):
        at = datetime(2024, 1, 10, 12, 1, i)
        for k, first in enumerate((at, at - timedelta(hours=6))):
            days += [(408 + 8 * i + 4 * k, str(first)), (408 + 8 * i + 4 * k, str(first + timedelta(hours=12)))]
    rows = ", ".join(f"({900000 + i}, TIMESTAMP '{t}', {u}, 'view', {5 + i % 7}.5, '{{\"k\": 3}}')" for i, (u, t) in enumerate(days))
    duckdb.sql(f"""COPY (SELECT * FROM '{SOURCE}/events.parquet' UNION ALL
        SELECT CAST(e AS BIGINT), t, CAST(u AS BIGINT), n, CAST(v AS DOUBLE), p FROM (VALUES {rows}) x(e, t, u, n, v, p)) TO '{out}/events.parquet' (FORMAT parquet)""")
    return out


def both(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted(repr(r) for r in cur.fetchall())
    got = [tuple(r) for r in entry.queries()[name](spark, folder).select(*cols).collect()]
    assert sorted(repr(r) for r in got) == want and want
    return [dict(zip(cols, r)) for r in got]


def test_a_day_without_a_mean_clock_counts_as_a_baseline_day(spark, folder):
    rows = sorted((r for r in both(spark, folder, "w12_personal_baseline") if r["participant_id"] in (400, 404)), key=lambda r: (r["participant_id"], r["day"]))
    assert [r["day_index"] for r in rows] == [*range(24), 0, 1]
    assert [r["day_index"] for r in rows if r["z_mean_h"] is None] == [6, 0, 1]


def test_people_whose_clocks_cancel_have_no_anchor(spark, folder):
    assert [r["anchor_clock"] for r in both(spark, folder, "o12_background_selection") if r["participant_id"] == 404] == [None]


def test_half_a_turn_is_negative_whatever_its_rounding(spark):
    at = spark.range(43200).select(*[(F.floor(s / 3600) + F.floor(s / 60) % 60 / F.lit(60.0) + s % 60 / F.lit(3600.0)).alias(c)
                                     for c, s in (("a", F.col("id")), ("b", F.col("id") + 43200))])
    deltas = at.select(F.round(clock.clock_delta("a", "b"), 6).alias("d")).union(at.select(F.round(clock.clock_delta("b", "a"), 6)))
    assert [tuple(r) for r in deltas.groupBy("d").count().collect()] == [(-12.0, 86400)]


def test_a_day_of_twelve_hours_has_one_delta(spark, folder):
    rows = [r for r in both(spark, folder, "p05_clock_delta") if r["participant_id"] >= 408]
    assert len(rows) == 120 and {r["delta"] for r in rows} == {-12.0}


def test_a_day_without_a_score_does_not_qualify(spark, folder):
    rows = {(r["participant_id"], r["day"].day): r for r in both(spark, folder, "w15_persistence_runs")}
    day = rows[400, 8]
    assert day["qualifies"] is False and day["confirmed"] is False and day["run_start"] is None
