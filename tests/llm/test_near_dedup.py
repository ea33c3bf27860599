import random

from chronowarn.llm.near_dedup import keep_one, near_duplicates
from chronowarn.llm.queries import ORACLES, QUERIES, near_sql

FOLDER = "/root/testdata/sf0.001"


def test_query_equals_sql(spark, sql, sorted_rows):
    assert sorted_rows(QUERIES["op2_minhash_near_dedup"](spark, FOLDER)) == sql(ORACLES["op2_minhash_near_dedup"])


def test_groups_of_edited_copies_equal_brute_force(docs_of, sql, sorted_rows):
    """Copies of copies at all distances around the threshold, so stars alone do not find every link."""
    rng, rows = random.Random(3), []
    for g in range(6):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(120)]
        family = [base]
        for _ in range(25):
            text = list(rng.choice(family))
            for _ in range(rng.randint(0, 7)):
                text[rng.randrange(len(text))] = f"e{rng.randint(0, 10**6)}"
            family.append(text)
        rows += [" ".join(t) for t in family]
    rng.shuffle(rows)
    docs = docs_of(list(enumerate(rows)))
    import pyarrow as pa
    view = pa.table({"doc_id": list(range(len(rows))), "text": rows})
    want = sql("WITH RECURSIVE " + near_sql("fixture", 3, 85) + " SELECT * FROM near", fixture=view)
    assert sorted_rows(near_duplicates(docs, 3, 85)) == want
    assert len({r.split(",")[0] for r in want[1]}) < len(rows)


def test_awkward_rows(awkward, docs_of):
    got = sorted((r[0] is None, r[0], r[1], r[2], r[3]) for r in near_duplicates(awkward, 3, 85).collect() if r[0] is not None)
    by = {g[1]: g[2:] for g in got}
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[3] == (0, 3, True)
    assert by[5][1:] == (4, False) and by[7][1] == 7 and by[9] == (1, 9, True)
    assert {g[3] for g in got if g[1] == 6} == {4}  # linked to the copies by one text, which the id ties to the other
    nulls = [r for r in near_duplicates(awkward, 3, 85).collect() if r[0] is None]
    assert sorted(str(r[2]) for r in nulls) == ["4", "None"]
    kept = keep_one(awkward, 5, 80)
    assert kept.columns == awkward.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "7", "8", "9", "None", "None"]
    empty = near_duplicates(docs_of([]), 3, 85)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]
