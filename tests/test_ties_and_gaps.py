"""Equal people, days without a direction and means at midnight: query and reference SQL must state one rule."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronowarn.functions import clock
from chronowarn.operators import endpoints, network

SOURCE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three copies of every person; on one day three people have two events twelve hours apart, so no circular mean."""
    out = str(tmp_path_factory.mktemp("ties"))
    con = duckdb.connect()
    con.execute(f"""COPY (
        WITH e AS (SELECT event_id + r * 100000 AS event_id, ts, user_id + r * 152 AS user_id, event_type, value, props FROM '{SOURCE}/events.parquet', range(3) g(r)),
        odd AS (SELECT * FROM (VALUES (4), (5), (6)) t(u)),
        two AS (SELECT 900000 + u * 10 + k AS event_id, TIMESTAMP '2024-01-12 06:00:00' + to_hours(CASE u WHEN 6 THEN -1 WHEN 5 THEN 2 ELSE 1 END + 12 * k) AS ts, CAST(u AS BIGINT) AS user_id, 'view' AS event_type, 10.0 + k AS value, '{{"k": 3}}' AS props
                FROM odd, range(2) g(k))
        SELECT * FROM e WHERE NOT (user_id IN (4, 5, 6) AND ts BETWEEN TIMESTAMP '2024-01-11 18:00:00' AND TIMESTAMP '2024-01-13 06:00:00') UNION ALL SELECT CAST(event_id AS BIGINT), ts, user_id, event_type, CAST(value AS DOUBLE), props FROM two)
        TO '{out}/events.parquet' (FORMAT parquet)""")
    return out


@pytest.mark.parametrize("name", ["a06_daily_panel", "d02_classic_scores", "d03_rolling_scores", "d16_component_audit", "j21_stable_and_pre_event", "l03_event_metrics",
                                  "l11_window_sensitivity", "l15_locked_validation", "o01_daily_assessment", "o02_event_detection", "o03_future_labels",
                                  "o04_endpoint_timeline", "o07_forecast_reasons"])
def test_query_equals_its_sql_on_ties_and_gaps(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted(repr(r) for r in cur.fetchall())
    got = entry.queries()[name](spark, folder).select(*cols)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want and want


def test_mean_next_to_the_full_turn_is_zero(spark):
    at = spark.createDataFrame([(2, 1.9, -1e-17), (2, 1.9, 1e-17), (2, 1.9, -1e-3)], "n long, c double, s double")
    mean, _ = clock.circular_from_sums(F.col("n"), F.col("c"), F.col("s"))
    a, b, c = (r[0] for r in at.select(mean).collect())
    assert a == 0.0 and b < 1e-9 and math.isclose(c, 24 - 1e-3 / 1.9 * 24 / (2 * math.pi), abs_tol=1e-6)


def test_a_value_at_its_bound_is_not_abnormal(spark):
    over = 0.3 + 1e-16 * 3
    df = spark.createDataFrame([(over, 0.1, over, 0.1, over, 0.1), (0.31, 0.1) * 3], "S1 double, anchor_S1 double, E1 double, anchor_E1 double, A1 double, anchor_A1 double")
    bounds = {d: (0.3, 0.2) for d in endpoints.DOMAINS}
    assert [r["abnormal"] for r in endpoints.assess(df, bounds).collect()] == [[], ["S1", "E1", "A1"]]


def test_pair_table_keeps_a_record_that_cannot_be_scored(spark):
    df = spark.createDataFrame([(1, None, None), (2, [1.0, 2.0, 3.0], [0.1, 0.2, 0.4])], "record long, dev array<double>, delta array<double>")
    members = spark.createDataFrame([("m", 0), ("m", 1)], "module string, i int")
    got = {r["record"]: r["score"] for r in network.pair_table_scores(df, 3, members, ["record"]).collect()}
    assert got[1] is None and math.isclose(got[2], 1.5 * 0.05 / 0.3)
