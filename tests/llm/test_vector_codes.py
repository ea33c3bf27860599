import hashlib
import itertools

import numpy as np
import pytest

from chronowarn.llm import vector_codes as vc
from chronowarn.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """Plain Python: (vec_id, code, error, label_error, digest, label) of every row, in any order."""
    rows = [(i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(rows[0][1]) // 4
    part = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1]))[:256]
    books = [[part(r[1], p) for r in first] for p in range(4)]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e))

    def assign():
        return [[min((far(part(r[1], p), e), i) for i, e in enumerate(books[p])) for p in range(4)] for r in rows]

    for _ in range(4):
        won = assign()
        for p in range(4):
            for i in range(len(books[p])):
                mine = [part(r[1], p) for r, w in zip(rows, won) if w[p][1] == i]
                if mine:
                    books[p][i] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(r[0], "".join(f"{i:02x}" for _, i in w), sum(d for d, _ in w), r[2]) for r, w in zip(rows, assign())]
    totals = {}
    for _, _, e, label in out:
        totals[label] = totals.get(label, 0) + e
    return sorted(map(repr, ((i, c, e, totals[label], sha, label) for i, c, e, label in out)))


def result(df):
    return sorted(repr(tuple(r)) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256", "label").collect())


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = vc.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shortlist_loses_no_winner():
    rng = np.random.default_rng(1)
    short = 0
    for _ in range(300):
        rows = rng.integers(-40, 40, (rng.integers(1, 9), 4)) // rng.integers(1, 9) + rng.integers(-60, 60, 4)
        entries = rng.integers(-90, 90, (40, 4))
        entries[20:25] = entries[0]
        able = vc.shortlist(rows.min(0), rows.max(0), entries)
        best, far = vc.nearest(rows, entries)
        again, same = vc.nearest(rows, entries[able])
        assert np.array_equal(able[again], best) and np.array_equal(far, same)
        short += len(able) < 10
    assert short > 20


def test_kernels_agree_on_large_numbers():
    rng = np.random.default_rng(2)
    rows, entries = rng.integers(-(1 << 27), 1 << 27, (30, 4)), rng.integers(-(1 << 27), 1 << 27, (20, 4))
    entries[7] = entries[3]
    best, far = vc.nearest(rows, entries)
    exact = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)), i) for i, e in enumerate(entries)) for r in rows]
    assert [(int(d), int(i)) for d, i in zip(far, best)] == exact


def test_awkward_rows_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 8).round(2).tolist(), int(rng.integers(0, 3))) for i in range(700)]
    same = rows[3][1]
    rows += [(5000 + i, same, 1) for i in range(600)]                    # a third of all rows is one vector
    rows += [(9, rows[11][1], 2), (9, rows[9][1], 0), (None, same, None), (None, rng.normal(0, 3, 8).tolist(), None), (-4, same, 1), (-3, same, 1),
             (7001, None, 1), (7002, [None] + same[1:], 1), (7003, [float("nan")] + same[1:], 1), (7004, [float("-inf")] + same[1:], None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as rid", "'y' as part", "'z' as code", "1 as error")
    assert result(vc.vector_codes(df.repartition(5))) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(3, [0.5, -0.25, 0.0, 1.0], None), (1, [0.5, 0.25, 0.0, 1.0], None), (2, [-0.0001, 0.0001, 0.0, 9.0], 4)]
    assert result(vc.vector_codes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    empty = vc.vector_codes(spark.createDataFrame([(1, None, 2)], SCHEMA))
    assert empty.collect() == [] and empty.columns[:5] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vc.vector_codes(spark.createDataFrame([(None, [1.0] * 4, 2)], SCHEMA)).collect() == []
    assert [r[1:3] for r in vc.vector_codes(spark.createDataFrame([(1, [], 2), (2, [], 2)], SCHEMA)).collect()] == [("00000000", 0)] * 2
    for bad in ([(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)], [(1, [1.0] * 6, 0)], [(1, [1e9] * 4, 0)]):
        with pytest.raises(ValueError):
            vc.vector_codes(spark.createDataFrame(bad, SCHEMA))


def test_query_equals_sql(spark, sql, sorted_rows):
    assert sorted_rows(QUERIES["op11_vector_codes"](spark, SMALL)) == sql(ORACLES["op11_vector_codes"])
