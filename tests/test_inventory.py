"""Inventory counts against a hand count."""

from datetime import date, timedelta

from chronowarn.operators import inventory


def test_inventory_equals_hand_count(spark):
    day = lambda k: date(2026, 1, 1) + timedelta(days=k)
    good, other = inventory.TRACED, "constructed"
    rows = [("s", "a", i, day(i), {"x": 1.0, "y": None if i == 2 else 2.0}, {"x": good, "y": good if i else other}) for i in range(16)]
    rows += [("s", "a", 100, day(5), {"x": None}, {"x": good}), ("s", "b", 101, None, {}, {}), ("t", "b", 102, day(0), {"x": 3.0}, {"x": other})]
    records = spark.createDataFrame(rows, "source string, participant_id string, record_id long, day date, cells map<string,double>, evidence map<string,string>")
    used = spark.createDataFrame([(None, 101), ("zzz", None)], "participant_id string, record_id long")
    got = {r["source"]: r.asDict() for r in inventory.expansion_inventory(records, used, ["x", "y"], {"both": ("x", "y")}, future_days=3).collect()}
    s, t = got["s"], got["t"]
    assert (s["records"], s["rows_with_traced"], s["traced_x"], s["traced_y"], s["panel_both"]) == (18, 16, 16, 14, 14)
    assert (s["people"], s["exposed_people"], s["duplicate_days"], s["people_14_days"]) == (2, 1, 1, 0)      # day 5 is ambiguous: runs of 5 and 10
    assert s["window_upper_bound"] == (5 - 3) + (10 - 3) and t["exposed_people"] == 1 and t["rows_with_traced"] == 0
    assert inventory.expansion_inventory(records.where("false"), used, ["x"], {}).collect() == []
