import random

import numpy as np

from chronowarn.llm.line_dedup import common_lines, dedup_lines, line_table, runs
from chronowarn.llm.queries import QUERIES
from test_line_dedup import FOLDER, sentence


def removed(docs_of, rows):
    return {r["doc_id"]: r["removed"] for r in dedup_lines(docs_of(rows)).collect()}


def test_a_common_line_goes_from_every_later_document(docs_of):
    rng = random.Random(12)
    notice = sentence(rng)
    rows = [(i, "\n".join([sentence(rng), notice, sentence(rng)] if i % 2 else [sentence(rng) for _ in range(3)])) for i in range(1, 61)]
    got = removed(docs_of, rows)
    assert got == {i: [1] if i % 2 and i > 1 else [] for i in range(1, 61)}  # 30 of 60 texts hold it


def test_a_passage_that_stands_twice_goes(docs_of):
    rng = random.Random(13)
    passage, other = [sentence(rng), sentence(rng, 5)], [sentence(rng), sentence(rng)]
    own = lambda: [sentence(rng)]
    rows = [(1, passage + own()), (2, passage + own() + passage), (3, own() + other + own() + other), (4, own() + other)]
    got = removed(docs_of, [(i, "\n".join(t)) for i, t in rows])
    assert got == {1: [], 2: [0, 1, 3, 4], 3: [], 4: [1, 2]}


def test_a_block_of_lines_first_held_elsewhere_goes(docs_of):
    rng = random.Random(14)
    one, two = sentence(rng, 5), sentence(rng, 5)
    own = lambda: sentence(rng, 6)
    rows = [(1, [own(), one]), (2, [two, own()]), (3, [own(), one, two, own()]), (4, [one, two, own()]), (5, [own(), one, own(), two])]
    got = removed(docs_of, [(i, "\n".join(t)) for i, t in rows])
    assert got == {1: [], 2: [], 3: [], 4: [0, 1], 5: []}


def test_every_common_block_is_covered_by_common_runs():
    rng = random.Random(15)
    for _ in range(300):
        pool = [sentence(rng, rng.choice((0, 1, 2, 3, 5, 9))) for _ in range(6)]
        x, y = (line_table("\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for _ in range(2))
        first, last, hashes, _ = runs(y)
        shared = {j for a, b, h in zip(first, last, hashes) if h in runs(x)[2] for j in range(a, b + 1)}
        want, places = set(), {}
        for i in range(len(x)):
            for j in range(len(y)):
                n = 0
                while i + n < len(x) and j + n < len(y) and x["hash"][i + n] == y["hash"][j + n]:
                    n += 1
                w = y["words"][j : j + n]
                if n and w.sum() >= 8 and w.max() >= 3:
                    want |= {k for k in range(j, j + n) if y["words"][k]}
        assert {j for j in shared if y["words"][j]} == want
        assert set(common_lines(x, y)) <= want


def test_query_equals_brute_force_without_a_cut(spark):
    """Every pair (first holder, later document) that shares a line or run, found in plain Python."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    first = {}
    for d in sorted(texts):
        first.setdefault(texts[d], d)
    tables, holder, pairs = {d: line_table(t) for t, d in first.items()}, {}, set()
    for d in sorted(tables):
        words, lines = tables[d]["words"], texts[d].split("\n")
        keys = {(line.strip(),) for line, n in zip(lines, words) if n >= 3}
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if words[a] and words[b - 1] and words[a:b].sum() >= 8 and words[a:b].max() >= 3:
                    keys.add(tuple(line.strip() for line in lines[a:b]))
                    break
        for key in keys:
            pairs.add((holder.setdefault(key, d), d))
    removed = {d: set() for d in texts}
    for a, b in pairs:
        if a != b:
            removed[b] |= set(common_lines(tables[a], tables[b]))
    for t, d in first.items():
        for c in (c for c, text in texts.items() if text == t and c != d):     # a later copy loses every line of the whole block
            lines = tables[d]["words"]
            removed[c] = set(np.flatnonzero(lines).tolist()) if lines.sum() >= 8 and lines.max() >= 3 else set()
    got = {r["doc_id"]: set(map(int, filter(None, r["removed"].split(",")))) for r in QUERIES["op7_line_dedup"](spark, FOLDER).collect()}
    assert got == removed and any(removed.values())
