import random

import pytest

from chronowarn.llm.decontaminate import contaminated, drop_contaminated


@pytest.mark.parametrize("size", [15, 59])
def test_an_item_in_a_third_of_the_documents_is_found(spark, docs_of, size):
    rng = random.Random(size)
    body = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    item, rows = body(size), []
    for i in range(600):
        n = rng.randint(0, 48)
        rows.append((i, " ".join(body(n) + (item if i % 3 == 0 else body(size)) + body(48 - n))))
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(body(20)))], "item_id long, text string")
    frame = docs_of(rows)
    assert sorted((r["doc_id"], r["item_id"]) for r in contaminated(frame, bench).collect()) == [(i, 7) for i in range(0, 600, 3)]
    assert sorted(r["doc_id"] for r in drop_contaminated(frame, bench).collect()) == [i for i in range(600) if i % 3]
