import re
from collections import Counter

import numpy as np

from chronowarn.llm import quality_rules as qr
from chronowarn.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark, awkward):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op8_quality_rules"](spark, FOLDER).collect()}
    assert len(got) == len(texts)
    for i, text in texts:
        r, want = got[i], base(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    measured = qr.measure(awkward.select("doc_id", "text")).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted([(str(r["doc_id"]), *[r[n] for n in names]) for r in measured]) == sorted((str(i), *base(t)) for i, t in rows)


def test_overlapping_repeats(docs_of):
    texts = ["a a a a a a a a", "a b c d e x a b c d e f a b c d e", "a b c d e f g h", " \x0b a\x0cb\rc d e\n\na b c d e \t"]
    got = {r["doc_id"]: r["n_repeat_words"] for r in qr.measure(docs_of(list(enumerate(texts)), clash=False).select("doc_id", "text")).collect()}
    assert got == {i: base(t)[4] for i, t in enumerate(texts)}


def estimate(x, bins, share):
    """The same estimate in NumPy: lowest bins that hold the share, mean, covariance with floors."""
    order = np.sort(np.unique(bins))
    held = np.array([(bins <= b).sum() for b in order])
    last = order[np.flatnonzero(held >= np.ceil(share * len(x)))[0]]
    near = x[bins <= last]
    return near.mean(0), np.cov(near.T, bias=True) + np.diag(np.square(qr.FLOOR))


def test_estimates_equal_numpy_and_reject_outliers(spark):
    rng = np.random.default_rng(4)
    mixing = rng.normal(size=(5, 5)) * 0.2
    x = rng.normal(size=(400, 5)) @ mixing + [1.6, 0.2, 0.1, 0.0, -0.1]
    x[:80] += [3, 2, -2, 1, 1]
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "_group string, " + ", ".join(f"{d} double" for d in qr.DIMENSIONS))
    fit = qr.estimates(rows).collect()[0]

    grain = np.array(qr.FLOOR) / 4
    binned = np.floor(x / grain + 0.5)
    middle = np.array([np.sort(c)[(len(c) - 1) // 2] for c in binned.T]) * grain
    d2 = (((x - middle) / qr.FLOOR) ** 2).sum(1)
    for _ in range(qr.STEPS + 1):
        centre, cov = estimate(x, np.floor(qr.BINS * np.log2(d2 + 1e-3)), qr.SHARE)
        d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
    assert np.allclose([fit[f"m{i}"] for i in range(5)], centre, atol=1e-6)
    lower = np.array([[fit[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    assert np.allclose(lower @ lower.T, cov, atol=1e-6)
    assert np.sqrt(d2[:80]).min() > np.sqrt(d2[80:]).max()


def test_labels_agree(spark):
    got = {r["doc_id"]: r["kept"] for r in QUERIES["op8_quality_rules"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    good = [got[r["doc_id"]] for r in labels if r["quality"] == 1]
    bad = [got[r["doc_id"]] for r in labels if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.05


def test_awkward_rows(awkward, docs_of):
    kept = qr.keep_sound(awkward)
    assert kept.columns == awkward.columns
    sound = [str(r["doc_id"]) for r in awkward.collect() if (b := base(r["text"]))[0] >= 10 and 100 * b[4] <= 20 * b[0]]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(sound) == ["4", "5", "5", "6", "None"]  # the long text repeats itself
    verdicts = qr.quality_rules(awkward).collect()
    assert len(verdicts) == awkward.count() and all(r["distance"] is None for r in verdicts)
    assert qr.quality_rules(docs_of([])).collect() == []
    odd = docs_of([(1, "word " * 9 + "x", None, None, 1), (2, None, None, "s", None)])
    assert [r["base_failed"] for r in qr.quality_rules(odd).orderBy("doc_id").collect()] == [True, True]
