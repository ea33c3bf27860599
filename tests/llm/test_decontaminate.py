import random

from chronowarn.llm.decontaminate import contaminated, drop_contaminated
from chronowarn.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_query_finds_every_verbatim_item(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").toPandas()
    want = {(d, i) for d, t in zip(docs.doc_id, docs.text) for i, b in zip(items.item_id, items.text) if b in t}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op5_benchmark_decontamination"](spark, FOLDER).collect()}
    assert want <= got
    flat = {d: " ".join(t.split()).lower() for d, t in zip(docs.doc_id, docs.text)}
    texts = {i: " ".join(b.split()).lower() for i, b in zip(items.item_id, items.text)}
    assert all(texts[i] in flat[d] for d, i in got)  # no clean document is named


def test_paraphrases_and_lookalikes(spark, docs_of):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(5)] + [(90, " ".join(word() for _ in range(200))), (91, None), (92, ""), (0, "the of and")]
    body = lambda n: " ".join(word() for _ in range(n))
    first = items[0][1].split()
    swapped = [w if n % 5 else word() for n, w in enumerate(first)]           # one word in five replaced
    answerless = first[:26] + [word() for _ in range(14)]                    # the answer is not there
    shuffled = rng.sample(first, len(first))
    docs = [(1, body(70) + " " + items[0][1].upper() + " " + body(90)), (2, body(33) + " " + " ".join(swapped) + " " + body(50)), (3, body(50) + " " + " ".join(answerless) + " " + body(9)),
            (4, body(20) + " " + " ".join(shuffled)), (5, body(300)), (6, None), (7, ""), (8, body(90) + items[5][1] + " " + body(20)), (None, items[1][1]), (9, items[2][1]), (9, items[2][1])]
    frame, bench = docs_of(docs), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in contaminated(frame, bench).collect())
    assert got == sorted([("1", 0), ("2", 0), ("8", 90), ("None", 1), ("9", 2), ("9", 2)])
    left = drop_contaminated(frame, bench)
    assert left.columns == frame.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 6, 7]


def test_empty_sides(spark, awkward, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "some words of an item that nobody wrote")], "item_id long, text string")
    assert contaminated(awkward, none).collect() == [] and contaminated(docs_of([]), one).collect() == [] and contaminated(awkward, one).collect() == []
    assert drop_contaminated(awkward, one).count() == awkward.count()
