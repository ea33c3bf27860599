import re

import corpus_pipeline

FOLDER = "/root/testdata/sf0.1"


def test_toxic_documents_go(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    left = {r["doc_id"] for r in corpus_pipeline.mixing_stage(spark, docs, FOLDER).select("doc_id").collect()}
    insults = re.compile(r"\b(trash|idiot|moron|scum|stupid)\b")
    toxic = [r["doc_id"] for r in docs.collect() if insults.search(r["text"] or "")]
    known = {r["doc_id"]: r for r in labels.collect()}
    clean = [d for d, r in known.items() if r["quality"] == 1 and r["toxic"] == 0]
    print("toxic", len(toxic), "left", sum(d in left for d in toxic), "labelled toxic", sum(r["toxic"] == 1 for r in known.values()),
          "left", sum(d in left for d, r in known.items() if r["toxic"] == 1), "clean", len(clean), "left", sum(d in left for d in clean))
    assert sum(d in left for d in toxic) <= 0.02 * len(toxic) and len(toxic) > 100
    assert sum(d not in left for d in clean) <= 0.02 * len(clean)
