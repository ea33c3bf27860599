"""Every stage of the pipeline held against a brute-force version on its own input."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from chronowarn.llm.queries import QUERIES, near_sql
from chronowarn.llm.shared import written
from test_quality_rules import base

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark, sql, sorted_rows):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES:
        result = written(stage(spark, docs, FOLDER), f"test-{name}")
        if name == "sharding":
            break
        assert result.columns == docs.columns and dict(result.dtypes) == dict(docs.dtypes)
        after = {r["doc_id"]: r["text"] for r in result.collect()}
        assert len(after) == result.count() and all(before[d] == t for d, t in after.items())
        gone = set(before) - set(after)
        if name == "quality_rules":
            failed = {d for d, t in before.items() if (b := base(t))[0] < 10 or 100 * b[4] > 20 * b[0]}
            assert failed <= gone
            clean = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1").collect()
            assert sum(r["doc_id"] in gone and r["doc_id"] not in failed for r in clean) <= 0.01 * len(clean)
        if name == "near_dedup":
            view = pa.table({"doc_id": list(before), "text": list(before.values())})
            want = sql("WITH RECURSIVE " + near_sql("fixture", 5, 80) + " SELECT doc_id FROM near WHERE kept", fixture=view)
            assert sorted(repr((d,)) for d in after) == want[1] and gone
        if name == "decontamination":
            flat = lambda t: " ".join(t.split()).lower()
            items = [flat(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            assert gone == {d for d, t in before.items() if any(i in flat(t) for i in items)} and gone
        if name == "mixing":
            insults = re.compile(r"\b(trash|idiot|moron|scum|stupid)\b")
            labels = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            clean = [d for d in before if d in labels and labels[d]["quality"] == 1 and labels[d]["toxic"] == 0]
            toxic = [d for d, t in before.items() if insults.search(t)]
            assert sum(d in gone for d in clean) <= 0.02 * len(clean)
            assert sum(d in gone for d in toxic) >= 0.4 * len(toxic)
        docs, before = result, after
    got = result.collect()
    assert {r["doc_id"] for r in got} == set(before) and {r["shard"] for r in got} == set(range(40))


def test_run_is_the_stages(spark):
    rows = QUERIES["pipeline"](spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    again = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.exceptAll(again).isEmpty() and again.exceptAll(rows).isEmpty() and rows.count() > 20
    assert corpus_pipeline.ORACLE_SQL is None
    assert rows.where(F.col("size") < 16).isEmpty()
