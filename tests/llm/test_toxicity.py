import zlib

import numpy as np

from chronowarn.llm import toxicity as tox
from chronowarn.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def plain_bag(text):
    """N-grams of the marked words of a text, one by one."""
    words, word = [], ""
    for c in (text or "").lower() + " ":
        if ord(c) >= 128 or c.isalnum():
            word += c
        elif word:
            words.append(word)
            word = ""
    return {("." + w + ".")[i : i + n] for w in words for n in range(3, 7) for i in range(len(w) + 3 - n)}


def bucket_of(gram):
    codes = np.array([ord(c) for c in gram], np.uint64)
    total = (codes * tox._FACTOR[: len(codes)]).sum(keepdims=True) + np.uint64(len(codes))
    return int(tox.tokens.mix(total)[0] >> np.uint64(64 - tox.BITS))


def test_bags_equal_plain_ngrams():
    texts = ["You're an idiot, a REAL one!", None, "", "...", "é", "größe naïve\n\tstraße", "x" * 40, "a bb ccc", "\U0001F600mixed\U0001F600 end"]
    row, bucket = tox.bags(texts)
    for i, text in enumerate(texts):
        assert set(bucket[row == i].tolist()) == {bucket_of(g) for g in plain_bag(text)}, text


def test_long_texts_are_whole(monkeypatch):
    words = [f"w{i:x}q{i % 7}" for i in range(4000)]
    text = " ".join(words) + " " + "z" * 3000 + " end"
    whole = tox.bags(["head", text, "tail"])
    monkeypatch.setattr(tox, "SEGMENT", 500)
    cut = tox.bags(["head", text, "tail"])
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut))


def test_unseen_misspellings_share_ngrams(spark, docs_of):
    rng = np.random.default_rng(3)
    clean = ["".join(rng.choice(list("aeioutnrs"), 6)) for _ in range(300)]
    ends = ["ed", "ing", "er", "ly", "ish", "ous"]
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice(clean, 60))
        if i % 5 == 0:
            text[7] = "zvokk" + ends[int(rng.integers(0, 4))]
        rows.append((i, " ".join(text)))
        labels.append((i, 1 if i % 5 == 0 else 0))
    new = [(9001, " ".join(clean[:50] + ["zvokkous"])), (9002, " ".join(clean[:50] + ["xzvokkish"])), (9003, " ".join(clean[:50])), (9004, "")]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in tox.toxicity(docs_of(rows + new), table).collect()}
    assert got[9001]["predicted"] == got[9002]["predicted"] == 1 and got[9003]["predicted"] == got[9004]["predicted"] == 0
    assert all(got[d]["predicted"] == t for d, t in labels)


def test_held_out_accuracy_and_contract(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    df = QUERIES["op12_toxicity"](spark, FOLDER)
    assert [f.simpleString() for f in df.schema.fields] == ["doc_id:bigint", "held_out:boolean", "score:double", "predicted:int"]
    got = {r["doc_id"]: r for r in df.collect()}
    assert len(got) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in got.items())
    # some labels of this table are noise: toxic ones on texts without a telling word
    test = [(got[d]["predicted"], t) for d, t in labels.items() if d in got and got[d]["held_out"]]
    assert np.mean([p for p, t in test if t == 1]) > 0.9 and np.mean([p for p, t in test if t == 0]) < 0.01 and len(test) > 500


def test_held_out_labels_teach_nothing(spark, docs_of):
    rows = [(i, ("vekkor " if i % 3 == 0 else "") + "plain words of no matter") for i in range(120)]
    docs = docs_of(rows)
    labels = [(i, int(i % 3 == 0)) for i in range(120)]
    other = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    one, two = (sorted(map(tuple, tox.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (labels, other))
    assert one == two and {r[3] for r in one} == {0, 1}


def test_awkward(spark, awkward, docs_of):
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, 1), (None, 1), (8, None), (4, 0), (9, 7)], "doc_id long, toxic int")
    out = tox.toxicity(awkward, labels).collect()
    assert len(out) == awkward.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] for r in out if r["doc_id"] is None)
    none = tox.toxicity(awkward, labels.where("false")).collect()
    assert len(none) == awkward.count() and all(abs(r["score"] - 0.5) < 1e-6 for r in none)
    assert tox.toxicity(docs_of([]), labels).collect() == []
