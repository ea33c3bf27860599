"""Line dedup by pairwise alignment: shared lines find the pairs, patience diff finds the common blocks."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronowarn.llm import tokens
from chronowarn.llm.shared import star_compare, written

ANCHOR_WORDS = 3     # words of a line that may anchor an alignment
BLOCK_WORDS = 8      # words of an aligned block that is deleted
BASE = np.uint64(tokens.BASE)
LINE = np.dtype([("hash", np.int64), ("words", np.int32)])


def line_tables(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``LINE`` records of all lines of a column's texts, and where each row's lines begin in them.

    A line's hash is a polynomial over its bytes without white space at its ends; the bytes are handled in pieces of a
    fixed size, whatever the length of a text or line.
    """
    n = len(data)
    stops = np.flatnonzero(data == 0x0A)
    ends = np.sort(np.r_[stops, offsets[1:]])                  # a line ends at a line feed or with its text
    starts = np.sort(np.r_[stops + 1, offsets[:-1]])
    cut = np.r_[0, np.cumsum(np.diff(np.searchsorted(stops, offsets)) + 1)]
    solid = tokens.NOT_SPACE[data]
    fresh = solid.copy()
    fresh[1:] &= ~solid[:-1]
    fresh[offsets[(offsets < n)]] = solid[offsets[(offsets < n)]]
    words = np.flatnonzero(fresh)
    out = np.zeros(len(ends), LINE)
    out["words"] = np.searchsorted(words, ends) - np.searchsorted(words, starts)
    some = np.flatnonzero(out["words"])
    places = np.flatnonzero(solid)
    first, last = places[np.searchsorted(places, starts[some])], places[np.searchsorted(places, ends[some]) - 1] + 1
    value = np.zeros(len(some), np.uint64)
    for at in range(0, n, tokens.PIECE):
        part = data[at : at + tokens.PIECE]
        up, down = tokens.powers(len(part) + 1)
        total = np.r_[np.uint64(0), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])]
        a, b = np.searchsorted(last, at, side="right"), np.searchsorted(first, at + len(part))
        x, y = np.maximum(first[a:b] - at, 0), np.minimum(last[a:b] - at, len(part))
        ahead = np.array([pow(tokens.BASE, int(k), 1 << 64) for k in (at - first[a:b])[first[a:b] < at]], np.uint64)   # lines begun in an earlier piece
        scale = down[x].copy()
        scale[first[a:b] < at] = ahead
        value[a:b] += (total[y] - total[x]) * scale
    out["hash"][some] = tokens.mix(value + (last - first).astype(np.uint64)).view(np.int64)
    return out, cut


def line_table(text: str) -> np.ndarray:
    """Hash and number of words of every line of ``text`` (white space at a line's ends does not matter)."""
    raw = text.encode("utf-8", "surrogatepass")
    return line_tables(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


def runs(lines: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """First line, last line and hash of the shortest runs of adjacent lines that a block may be.

    Such a run has ``BLOCK_WORDS`` words and a line of ``ANCHOR_WORDS``, and lies in one of the texts that begin at the
    lines ``cut``.  The first so many (the last number) begin at each line that has words, the rest end at each.  A block
    common to two documents is covered by runs common to them.
    """
    cut = np.array([0, len(lines)]) if cut is None else cut
    words = lines["words"].astype(np.int64)
    some, strong = np.flatnonzero(words), np.flatnonzero(words >= ANCHOR_WORDS)
    if not len(strong):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    text = np.searchsorted(cut, some, side="right")
    begin, end = cut[text - 1], cut[text]
    total = np.r_[0, np.cumsum(words)]
    stop = np.searchsorted(total, total[some] + BLOCK_WORDS) - 1
    after = np.searchsorted(strong, some)
    last = np.maximum(stop, np.where(after < len(strong), strong[np.minimum(after, len(strong) - 1)], len(lines)))
    good = last < end
    first, last = some[good], last[good]
    ahead = len(first)
    start = np.searchsorted(total, total[some + 1] - BLOCK_WORDS, side="right") - 1
    before = np.searchsorted(strong, some, side="right") - 1
    left = np.minimum(start, np.where(before >= 0, strong[np.maximum(before, 0)], -1))
    good = left >= begin
    first, last = np.r_[first, left[good]], np.r_[last, some[good]]
    up, down = tokens.powers(len(lines) + 1)     # wraps: the hash of a run is a polynomial modulo 2^64
    value = np.r_[np.uint64(0), np.cumsum(lines["hash"].astype(np.uint64) * up[: len(lines)])]
    value = (value[last + 1] - value[first]) * down[first]
    mixed = (value + (last - first).astype(np.uint64))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * BASE
    mixed ^= mixed >> np.uint64(32)
    return first, last, np.where(first == last, lines["hash"][first], mixed.astype(np.int64)), ahead


def anchors(lines: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the lines of ``ANCHOR_WORDS`` words or more and of the runs that may be blocks, each once a text."""
    strong = np.flatnonzero(lines["words"] >= ANCHOR_WORDS)
    first, _, hashes, _ = runs(lines, cut)
    text = np.searchsorted(cut, np.r_[strong, first], side="right") - 1
    value = np.r_[lines["hash"][strong], hashes]
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (value[1:] != value[:-1])] if len(text) else np.zeros(0, bool)
    return text[new], value[new]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of ``pairs`` (in order of the first) that rises in the second: patience sorting."""
    tops, piles, back = [], [], []
    for n, (_, y) in enumerate(pairs):
        at = bisect.bisect_left(tops, y)
        back.append(piles[at - 1] if at else -1)
        tops[at : at + 1] = [y]
        piles[at : at + 1] = [n]
    chain, n = [], piles[-1] if piles else -1
    while n >= 0:
        chain.append(pairs[n])
        n = back[n]
    return chain[::-1]


def _once(lines: np.ndarray, lo: int, hi: int) -> dict[int, int]:
    values, first, counts = np.unique(lines["hash"][lo:hi], return_index=True, return_counts=True)
    return {v: lo + i for v, i in zip(values[counts == 1].tolist(), first[counts == 1].tolist())}


def _once_runs(found, lo: int, hi: int) -> dict[int, tuple[int, int]]:
    """First and last line of every run that lies in the lines ``lo`` to ``hi`` and is there once."""
    first, last, hashes, ahead = found
    a, b = np.searchsorted(first[:ahead], lo), np.searchsorted(last[:ahead], hi)
    values, at, counts = np.unique(hashes[a:b], return_index=True, return_counts=True)
    return {v: (int(first[a + i]), int(last[a + i])) for v, i in zip(values[counts == 1].tolist(), at[counts == 1].tolist())} if a < b else {}


def _run_chain(left, right) -> list[tuple[int, int]]:
    """Rising chain of the starts of common runs, without one that begins inside an earlier run on another diagonal."""
    both = {left[h][0]: (right[h][0], left[h][1] - left[h][0]) for h in left if h in right}
    chain, end = [], 0
    for i, j in _increasing(sorted((i, j) for i, (j, _) in both.items())):
        if chain and i - j != chain[-1][0] - chain[-1][1] and (i <= chain[-1][0] + end or j <= chain[-1][1] + end):
            continue
        chain.append((i, j))
        end = both[i][1]
    return chain


def align(x: np.ndarray, y: np.ndarray, runs_x=None, runs_y=None) -> list[tuple[int, int]]:
    """Patience diff of two line tables: matched (line of x, line of y), both rising.

    Lines that occur once on either side anchor the longest rising chain; equal lines next to an anchor join it,
    and what lies between anchors is aligned in the same way, as long as it has lines, or else runs, that occur once
    there.  ``runs_x`` and ``runs_y`` are the ``runs`` of both.
    """
    matched, todo = [], [(0, len(x), 0, len(y))]
    xs, ys = x["hash"].tolist(), y["hash"].tolist()
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and xs[a] == ys[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and xs[b - 1] == ys[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a >= b or c >= d:
            continue
        left, right = _once(x, a, b), _once(y, c, d)
        chain = _increasing(sorted((i, right[h]) for h, i in left.items() if h in right))
        if not chain:
            runs_x, runs_y = runs_x or runs(x), runs_y or runs(y)
            chain = _run_chain(_once_runs(runs_x, a, b), _once_runs(runs_y, c, d))
        if not chain:
            continue
        edges = [(a, c), *[(i + 1, j + 1) for i, j in chain]]
        ends = [*chain, (b, d)]
        matched.extend(chain)
        todo.extend((i, k, j, m) for (i, j), (k, m) in zip(edges, ends))
    return sorted(matched)


def common_lines(x: np.ndarray, y: np.ndarray, runs_x=None, runs_y=None) -> list[int]:
    """Lines of ``y`` in blocks of at least ``BLOCK_WORDS`` words that hold a line of ``ANCHOR_WORDS`` and are in ``x``.

    Blocks are aligned, and so keep the order of ``x``; a run that stands more than once in ``x`` or in ``y`` has no one
    place in that order, and every copy of it in ``y`` counts.
    """
    runs_x, runs_y = runs_x or runs(x), runs_y or runs(y)
    out, block = [], []

    def close():
        words = y["words"][block] if block else np.zeros(0, np.int32)
        if words.sum() >= BLOCK_WORDS and words.max() >= ANCHOR_WORDS:
            out.extend(j for j in block if y["words"][j])
        block.clear()

    last = (-2, -2)
    for i, j in align(x, y, runs_x, runs_y):
        if (i, j) != (last[0] + 1, last[1] + 1):
            close()
        block.append(j)
        last = (i, j)
    close()
    several = np.intersect1d(np.r_[_several(runs_x), _several(runs_y)], np.intersect1d(runs_x[2], runs_y[2]))
    for n in np.flatnonzero(np.isin(runs_y[2], several)).tolist() if len(several) else ():
        out.extend(j for j in range(runs_y[0][n], runs_y[1][n] + 1) if y["words"][j])
    return sorted(set(out))


def _several(found) -> np.ndarray:
    """Hashes of runs that stand in more than one place: of those that begin at, or of those that end at each line."""
    out = []
    for part in (found[2][: found[3]], found[2][found[3] :]):
        values, counts = np.unique(part, return_counts=True)
        out.append(values[counts > 1])
    return np.concatenate(out)


def _lines(batches):
    for batch in tokens.pieces(batches, 1 << 20):
        if not batch.num_rows:
            continue
        lines, cut = line_tables(*tokens.text_bytes(batch.column(2)))
        text, value = anchors(lines, cut)
        held = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)), pa.array(value))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([lines[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()), held],
                                         ["doc_id", "text_key", "data", "anchors"])


def _compare(batches):
    at, heads = None, []
    for batch in tokens.pieces(batches):
        ids, found = [], []
        for head, block, role, id_, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
            mine = np.frombuffer(data, LINE)
            if (head, block) != at:
                at, heads = (head, block), []
            if role == 0:
                heads.append((mine, runs(mine)))
                continue
            own = runs(mine)
            lines = sorted({j for h, r in heads for j in common_lines(h, mine, r, own)})
            if lines:
                ids.append(id_)
                found.append(lines)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(found, pa.list_(pa.int32()))], ["text_key", "lines"])


def _cut(batches):
    for batch in tokens.pieces(batches):
        texts, totals = [], []
        for text, lines in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            gone = set(lines or ())
            parts = (text or "").split("\n")
            texts.append(None if text is None else "\n".join(p for i, p in enumerate(parts) if i not in gone))
            totals.append(len(parts) if text else 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(totals, pa.int64()),
                                          pa.array([sorted(x or ()) for x in batch.column(2).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "text", "n_lines", "removed"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with aligned common blocks deleted from the later document.

    Returns doc_id, text (what is left), n_lines, removed (deleted line numbers from 0).  The document with the
    smaller doc_id is the earlier one.

    1. Equal texts form one class.  The first copy stands for it, so later copies lose every line of it that lies in
       a block of ``BLOCK_WORDS`` words; they cost no pairs.
    2. Every line of ``ANCHOR_WORDS`` words and every shortest run of adjacent lines that may be a block, taken once per
       document, pairs the first document that holds it with each later one: at most as many pairs as lines and runs,
       however frequent one is.  All pairs are compared.
    3. Patience diff aligns each pair; blocks of ``BLOCK_WORDS`` words go from the later document, and of a passage that
       stands several times in one of the two every copy in the later.  Line hashes travel for that, the first document's
       once per block of partners; texts are shuffled once, when the lines are cut out.

    Null text stays null, empty text stays; a null doc_id is left whole; rows that repeat an id and text lose the
    same lines, and of rows that repeat an id with different texts the one with the smaller text hash is the earlier.
    Empty input gives no rows; extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.select("doc_id", F.unhex(F.md5("text")).alias("text_key"), "text")
    lined = written(keyed.where("doc_id is not null and text is not null").mapInArrow(
        _lines, "doc_id long, text_key binary, data binary, anchors array<long>"), "lines")
    classes = written(lined.groupBy("text_key").agg(F.min("doc_id").alias("doc_id")), "texts")
    heads = lined.join(classes, ["text_key", "doc_id"], "left_semi")
    heads = written(heads.groupBy("text_key").agg(F.min(F.struct("doc_id", "data", "anchors")).alias("s")).select("text_key", "s.*"), "heads")

    held = heads.select("doc_id", "text_key", F.explode("anchors").alias("line"))
    firsts = held.groupBy("line").agg(F.min(F.struct("doc_id", "text_key")).alias("s"), F.count(F.lit(1)).alias("df")).where("df > 1")
    firsts = written(firsts.select("line", F.col("s")["text_key"].alias("head")), "first-holders")   # a table, so that a frequent line's holders can be dealt over tasks
    shared = held.join(firsts, "line").where("text_key <> head")
    pairs = written(shared.select("head", F.col("text_key").alias("member")).distinct(), "line-pairs")
    found = star_compare(pairs, heads.select(F.col("text_key").alias("id"), "data"), _compare, "text_key binary, lines array<int>")
    found = found.select("text_key", F.explode("lines").alias("line")).groupBy("text_key").agg(F.array_sort(F.collect_set("line")).alias("lines"))  # a text's own lines

    first = heads.join(found, "text_key", "left").select(F.col("doc_id").alias("first"), "text_key", "lines", "data")
    marks = lined.select("doc_id", "text_key").distinct().join(first, "text_key").select(
        "doc_id", "text_key", F.when(F.col("doc_id") == F.col("first"), F.col("lines")).alias("lines"),
        F.when(F.col("doc_id") != F.col("first"), F.col("data")).alias("copy"))
    marks = written(marks.mapInArrow(_whole, "doc_id long, text_key binary, lines array<int>").where("size(lines) > 0"), "marks")
    left = keyed.join(marks, ["doc_id", "text_key"], "left")
    return left.select("doc_id", "text", "lines").mapInArrow(_cut, "doc_id long, text string, n_lines long, removed array<int>")


def _whole(batches):
    """Lines to delete: those found for first documents, and every line of a whole block for later copies."""
    for batch in tokens.pieces(batches):
        out = []
        for lines, copy in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if copy is not None:
                t = np.frombuffer(copy, LINE)
                lines = np.flatnonzero(t["words"]).tolist() if t["words"].sum() >= BLOCK_WORDS and len(t) and t["words"].max() >= ANCHOR_WORDS else []
            out.append(lines or [])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "text_key", "lines"])
