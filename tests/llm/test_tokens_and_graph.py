"""Word hashing against Python's words, components against union-find."""

import random
import re

import numpy as np
import pyarrow as pa

from chronowarn.llm import tokens
from chronowarn.llm.shared import components


def test_words_equal_python(monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", 64)  # many cuts
    rng = random.Random(5)
    for _ in range(200):
        rows = [rng.choice([None, "".join(rng.choice("aBz9 \n\té.") for _ in range(rng.randint(0, 200)))]) for _ in range(rng.randint(0, 6))]
        for inside, pattern in ((tokens.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (tokens.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
            hashes, starts = tokens.words(*tokens.text_bytes(pa.array(rows, pa.string())), inside)
            want = [re.findall(pattern, (r or "").replace("B", "b")) for r in rows]
            assert np.diff(starts).tolist() == [len(w) for w in want]
            assert hashes.tolist() == [tokens.hash_one(w) for ws in want for w in ws]


def test_shingles_of_short_texts():
    sets = [tokens.shingle_sets(*tokens.words(*tokens.text_bytes(pa.array([t])), tokens.NOT_SPACE), 3)[0] for t in ("", "a b", "a b c", "a b c a b c a")]
    assert [len(s) for s in sets] == [0, 1, 1, 3]
    assert sets[1][0] != sets[2][0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 99), (7, 7), (200, 201)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 99: 99, 100: 99, 101: 99, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
