import hashlib
import random

import numpy as np

from chronowarn.llm import tokens
from chronowarn.llm.line_dedup import BLOCK_WORDS, align, common_lines, dedup_lines, line_table, line_tables, runs

FOLDER = "/root/testdata/sf0.001"


def sentence(rng, n=9):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        pool = [sentence(rng, rng.randint(0, 6)) for _ in range(8)]
        x, y = ("\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(2))
        a, b = line_table(x), line_table(y)
        pairs = align(a, b)
        assert all(x.split("\n")[i] == y.split("\n")[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    same = line_table("\n".join(pool))
    assert align(same, same) == [(i, i) for i in range(len(same))]


def test_blocks_need_words_and_order():
    rng = random.Random(3)
    one, two, three = (sentence(rng) for _ in range(3))
    x = line_table("\n".join([one, two, "short line", three]))
    assert common_lines(x, line_table("\n".join(["own first line here", two, "short line", "own last"]))) == [1, 2]
    assert common_lines(x, line_table("short line\nown words that are new")) == []
    assert len(common_lines(x, line_table("\n".join([three, one])))) == 1  # moved: only one of them is in order
    assert BLOCK_WORDS == 8


def test_later_document_loses_the_block(docs_of):
    rng = random.Random(4)
    block = [sentence(rng) for _ in range(3)]
    own = lambda: [sentence(rng) for _ in range(4)]
    a, b, c = own() + block, own()[:2] + block + own()[:1], own()
    copy = "\n".join(own())
    rows = [(10, "\n".join(a)), (20, "\n".join(b)), (30, "\n".join(c)), (40, copy), (41, copy), (42, copy), (None, "\n".join(a)), (50, None), (51, ""), (20, "\n".join(b)),
            (60, block[0] + "\nsomething of its own"), (61, "tiny"), (62, "tiny")]
    df = docs_of(rows)
    got = {(r["doc_id"], i): (r["text"], r["removed"]) for i, r in enumerate(dedup_lines(df).collect())}
    by = {}
    for (d, _), v in got.items():
        by.setdefault(d, []).append(v)
    assert len(got) == len(rows)
    assert by[10] == [("\n".join(a), [])] and by[None] == [("\n".join(a), [])]
    assert by[20] == [("\n".join(b[:2] + b[5:]), [2, 3, 4])] * 2
    assert by[30][0][1] == [] and by[40][0][1] == [] and by[41] == by[42] == [("", [0, 1, 2, 3])]
    assert by[50] == [(None, [])] and by[51] == [("", [])] and by[60] == [("something of its own", [0])]
    assert by[61] == by[62] == [("tiny", [])]
    assert dedup_lines(df.where("false")).collect() == []


def test_rows_that_repeat_an_id_are_compared(docs_of):
    rng = random.Random(6)
    block, own = [sentence(rng) for _ in range(2)], lambda: [sentence(rng)]
    rows = [(1, block + own()), (1, own() + block), (2, own() + block + own())]
    rows = [(i, "\n".join(t)) for i, t in rows]
    got = {}
    for r in dedup_lines(docs_of(rows)).collect():
        got.setdefault(r["doc_id"], []).append(r["removed"])
    later = max(rows[:2], key=lambda r: hashlib.md5(r[1].encode()).digest())[1]
    assert got[2] == [[1, 2]] and sorted(got[1]) == sorted([[], [0, 1] if later == rows[0][1] else [1, 2]])


def test_tables_of_a_column_equal_plain_lines(monkeypatch):
    rng = random.Random(7)
    pool = ["", " ", "one", " one\t", "two words", "ünï cödé line", "x" * 300, "a b c d e f g h i", "\r", "A one"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) for _ in range(60)] + ["", "\n", "\n\n a", "word " * 3000]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]
    for piece in (1 << 18, 64):
        monkeypatch.setattr(tokens, "PIECE", piece)
        lines, cut = line_tables(data, offsets)
        seen = {}
        for text, a, b in zip(texts, cut[:-1], cut[1:]):
            plain = text.split("\n")
            assert lines["words"][a:b].tolist() == [len(x.split()) for x in plain]
            for h, x in zip(lines["hash"][a:b].tolist(), plain):
                assert seen.setdefault(h, x.strip()) == x.strip()
            assert np.array_equal(line_table(text), lines[a:b])
        assert len(seen) == len({x.strip() for t in texts for x in t.split("\n")})
        first, last, hashes, _ = runs(lines, cut)
        at = np.searchsorted(cut, first, side="right") - 1
        one = [(f + cut[i], n + cut[i], h) for i in range(len(texts)) for f, n, h in zip(*runs(lines[cut[i] : cut[i + 1]])[:3])]
        assert sorted(zip(first.tolist(), last.tolist(), hashes.tolist())) == sorted((int(f), int(n), int(h)) for f, n, h in one) and (last < cut[at + 1]).all()
