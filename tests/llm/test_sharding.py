import zlib
from collections import defaultdict

from chronowarn.llm.queries import ORACLES, QUERIES
from chronowarn.llm.sharding import byte_shards

FOLDER = "/root/testdata/sf0.001"


def test_query_equals_sql(spark, sql, sorted_rows):
    assert sorted_rows(QUERIES["op3_sharding"](spark, FOLDER)) == sql(ORACLES["op3_sharding"])


def test_awkward_rows(awkward, docs_of):
    got = byte_shards(awkward, 4).collect()
    rows = {(r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in awkward.collect()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == rows and len(got) == awkward.count()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    assert byte_shards(docs_of([])).collect() == []


def test_sizes_are_near_equal(docs_of):
    got = byte_shards(docs_of([(i, "x" * (i * 37 % 211)) for i in range(2000)]), 10).collect()
    total = defaultdict(int)
    for r in got:
        total[r["shard"]] += r["size"]
    assert len(total) == 10 and max(total.values()) - min(total.values()) <= 2 * max(r["size"] for r in got)
