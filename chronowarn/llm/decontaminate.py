"""Benchmark decontamination: latent semantic retrieval of passages, then subsequence and answer checks."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronowarn.llm import tokens

HALF_PASSAGE = 32     # a passage is two halves of so many words, and starts at every half
BUCKETS = 1 << 16     # hashed columns that give words outside the benchmark their frequency
RANK = 32             # corpus directions of the decomposition
COSINE = 0.3          # least cosine of a passage and an item
SURE = 0.8            # weighted share of an item's words in order that settles a match
LIKELY = 0.6          # share that, with the answer check, makes a paraphrase
ANSWER = 0.6          # weighted share of the item's answer (its last quarter) that must be there
ITEM_BLOCK = 1024     # benchmark passages searched for at once
LUT_BITS = 22


@dataclass
class Index:
    """What every task needs to search for a block of benchmark passages; its size follows the benchmark alone."""
    vocabulary: np.ndarray                 # sorted word hashes: the exact columns
    idf: np.ndarray                        # of the columns
    other_idf: np.ndarray                  # of hashed buckets
    basis: np.ndarray = None               # columns x rank
    items: list = field(default_factory=list)     # (item id, word columns, answer start)
    queries: np.ndarray = None             # latent unit vectors of item passages
    length: np.ndarray = None              # TF-IDF length of each query
    most: np.ndarray = None                # times that its commonest word stands in each query
    owner: np.ndarray = None               # item number of each query
    lut: np.ndarray = None

    def columns(self, hashes: np.ndarray) -> np.ndarray:
        """Column of each word, -1 outside the benchmark's vocabulary."""
        if self.lut is None:
            self.lut = np.zeros(1 << LUT_BITS, bool)
            self.lut[self.vocabulary >> np.uint64(64 - LUT_BITS)] = True
        out = np.full(len(hashes), -1, np.int32)
        maybe = np.flatnonzero(self.lut[hashes >> np.uint64(64 - LUT_BITS)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), max(0, len(self.vocabulary) - 1))
        same = self.vocabulary[at] == hashes[maybe]
        out[maybe[same]] = at[same]
        return out


def _halves(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word offset of every half passage of a batch (the last ends the list), and first half of every row."""
    counts = -(-np.diff(starts) // HALF_PASSAGE)
    first = np.r_[0, np.cumsum(counts)]
    within = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    return np.r_[np.repeat(starts[:-1], counts) + within * HALF_PASSAGE, starts[-1]], first


def _split(batches):
    """Batches as (ids, word hashes, row starts), piece by piece."""
    for part in tokens.pieces(batches):
        yield part.column(0), *tokens.words(*tokens.text_bytes(part.column(1)), tokens.ALNUM)


def _frequencies(vocabulary: np.ndarray):
    """Half passages that hold each benchmark word or hashed bucket (numbered behind the words); -1 counts them all."""
    index = Index(vocabulary, None, None)

    def run(batches):
        total, n = np.zeros(len(vocabulary) + BUCKETS, np.int64), 0
        for _, hashes, starts in _split(batches):
            cut, _ = _halves(starts)
            column = index.columns(hashes).astype(np.int64)
            other = column < 0
            column[other] = len(vocabulary) + (hashes[other] & np.uint64(BUCKETS - 1)).astype(np.int64)
            half = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
            seen = np.sort(half * len(total) + column)
            seen = seen[np.r_[True, seen[1:] != seen[:-1]]] if len(seen) else seen
            total += np.bincount(seen % len(total), minlength=len(total))
            n += len(cut) - 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[n, total[some]])], ["col", "n"])
    return run


def _norms(index: Index, hashes, column, cut):
    """Squared TF-IDF length of every half passage and the part inside the vocabulary.

    A repeated word adds its square each time, which is less than the square of the sum: cosines err upwards, so the
    search passes over nothing that the exact cosine would find.
    """
    inside = column >= 0
    weight = index.other_idf[hashes & np.uint64(BUCKETS - 1)] ** 2
    weight[inside] = index.idf[column[inside]] ** 2
    total = np.r_[0.0, np.cumsum(weight)]
    own = np.r_[0.0, np.cumsum(np.where(inside, weight, 0.0))]
    return total[cut[1:]] - total[cut[:-1]], own[cut[1:]] - own[cut[:-1]]


def _gather(table: np.ndarray, column: np.ndarray, cut: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Sum of ``table`` rows over the words of each ``wanted`` half passage; words of column -1 add nothing."""
    padded = np.r_[table, np.zeros((1, table.shape[1]), table.dtype)]  # row -1
    out = np.zeros((len(cut) - 1, table.shape[1]), np.float32)
    place = np.arange(HALF_PASSAGE)
    for a in range(0, len(wanted), 4096):
        halves = wanted[a : a + 4096]
        at = cut[halves][:, None] + place
        words = np.where(at < cut[halves + 1][:, None], column[np.minimum(at, len(column) - 1)], -1)
        part = np.zeros((len(halves), table.shape[1]), np.float32)
        for j in range(HALF_PASSAGE):
            part += padded[words[:, j]]
        out[halves] = part
    return out


def _range_finder(index: Index, omega: np.ndarray):
    """Partial sums of A^T (A omega) over half passages A (unit rows), one row of numbers per column."""
    scaled = (index.idf[:, None] * omega).astype(np.float32)

    def run(batches):
        total = np.zeros(omega.shape)
        for _, hashes, starts in _split(batches):
            cut, _ = _halves(starts)
            if len(cut) < 2:
                continue
            column = index.columns(hashes)
            norm, _ = _norms(index, hashes, column, cut)
            sketch = _gather(scaled, column, cut, np.arange(len(cut) - 1)) / np.maximum(norm, 1e-9)[:, None]
            inside = np.flatnonzero(column >= 0)
            half = np.searchsorted(cut, inside, side="right") - 1
            for k in range(total.shape[1]):
                total[:, k] += np.bincount(column[inside], weights=sketch[half, k], minlength=len(total))
        total *= index.idf[:, None]
        some = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64()))], ["col", "v"])
    return run


def decompose(y: np.ndarray, omega: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Orthonormal basis of the leading corpus directions and of the items.

    ``y`` is A^T A omega.  The Nystrom form y (omega^T y)^+ y^T of A^T A gives the leading right singular vectors;
    what the items have outside them is joined, so that no item is lost in the low rank.
    """
    q, _ = np.linalg.qr(y)
    small = np.linalg.pinv(omega.T @ y, rcond=1e-9)
    r = q.T @ y
    _, vectors = np.linalg.eigh((r @ small @ r.T + (r @ small @ r.T).T) / 2)
    corpus = q @ vectors
    rest = items.T - corpus @ (corpus.T @ items.T)
    u, s, _ = np.linalg.svd(rest, full_matrices=False)
    own = u[:, s > 1e-8 * max(1.0, s.max(initial=0))]
    return np.c_[corpus, own].astype(np.float32)


def weighted_lcs(item: np.ndarray, weight: np.ndarray, text: np.ndarray) -> float:
    """Greatest weight of a common subsequence of ``item`` and ``text`` (columns; -1 matches nothing)."""
    best = np.zeros(len(text) + 1)
    for w, c in zip(weight, item):
        step = np.where(text == c, best[:-1] + w, 0.0)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], step))
    return float(best[-1])


def _search(index: Index):
    """Rows (doc, item, cosine, share, answer share, first word) of every item that a row of texts holds."""
    table = (index.idf[:, None] * index.basis).astype(np.float32)

    def run(batches):
        for ids, hashes, starts in _split(batches):
            rows = _search_found(index, table, hashes, starts)
            out = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), *[pa.array(c, pa.float64()) for c in out[2:5]], pa.array(out[5], pa.int64())],
                ["doc_id", "item_id", "cosine", "share", "answer_share", "first_word"])
    return run


def _search_found(index: Index, table, hashes, starts):
    cut, first = _halves(starts)
    n = len(cut) - 1
    if n < 1 or not len(index.queries):
        return []
    column = index.columns(hashes)
    norm, own = _norms(index, hashes, column, cut)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = np.r_[row[1:] == row[:-1], False]  # a half and the next one of the same text
    norm = norm + np.where(pair, np.r_[norm[1:], 0], 0)
    own = own + np.where(pair, np.r_[own[1:], 0], 0)
    # a query's dot product is at most ``most`` times the passage's own weight, and has to reach COSINE of both lengths
    least = np.minimum((index.length**2 / index.most).min(), (index.length / index.most).min() * np.sqrt(norm))
    alive = (own >= COSINE * least * (1 - 1e-6)) & (own > 0)
    needed = alive | np.r_[False, (alive & pair)[:-1]]
    latent = _gather(table, column, cut, np.flatnonzero(needed))
    keep = np.flatnonzero(alive)
    both = latent[keep] + np.where(pair[keep][:, None], latent[np.minimum(keep + 1, n - 1)], 0)
    best: dict[tuple[int, int], tuple] = {}
    mark = np.zeros(len(index.vocabulary) + 1, bool)
    for at in range(0, len(keep), 4096):
        cosine = both[at : at + 4096] @ index.queries.T / np.minimum(np.sqrt(norm[keep[at : at + 4096]])[:, None], index.length)
        near = cosine >= COSINE
        for p in np.flatnonzero(near.any(1)).tolist():
            h, r = int(keep[at + p]), int(row[keep[at + p]])
            for q in np.flatnonzero(near[p]).tolist():
                number = int(index.owner[q])
                _, words, answer = index.items[number]
                text = column[max(starts[r], cut[h] - len(words)) : min(starts[r + 1], cut[h] + 2 * HALF_PASSAGE + len(words))]
                mark[text] = True  # column -1 marks the spare last place
                weight = index.idf[words]
                there = weight * mark[words]
                mark[text] = False
                if there.sum() < LIKELY * weight.sum():  # no subsequence can carry more than the words that are there
                    continue
                share = weighted_lcs(words, weight, text) / weight.sum()
                held = there[answer:].sum() / weight[answer:].sum()
                found = (share, held, min(1.0, float(cosine[p, q])), int(cut[h] - starts[r]))
                if share >= SURE or (share >= LIKELY and held >= ANSWER):
                    best[r, number] = max(found, best.get((r, number), found))
    return [(r, index.items[i][0], c, s, a, w) for (r, i), (s, a, c, w) in sorted(best.items())]


def _item_tables(texts: list[str], ids: list[int], vocabulary: np.ndarray):
    hashes, starts = tokens.words(*tokens.text_bytes(pa.array(texts, pa.string())), tokens.ALNUM)
    column = np.searchsorted(vocabulary, hashes)
    return [(i, column[a:b], (b - a) - max(1, (b - a) // 4)) for i, a, b in zip(ids, starts[:-1].tolist(), starts[1:].tolist()) if b > a]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Items of ``benchmark`` (item_id, text) that rows of ``docs`` (doc_id, text) hold, whole or as a paraphrase.

    Returns doc_id, item_id, cosine, share, answer_share, first_word: one row per document row and item found.

    1. Document frequencies of words are counted over the half passages of all texts.
    2. TF-IDF rows of all half passages over the benchmark's words go through a distributed randomised range finder;
       its Nystrom form gives the latent directions, to which the items' own vectors are joined.
    3. Every passage of 64 words (starting every 32) of every text is compared with every item passage by latent
       cosine, in blocks of items; passages whose words cannot reach ``COSINE`` are passed over.  A passage counts as
       no longer than the item passage, so what stands around a copy does not matter: one of the passages that meet
       an exact copy holds half of its squared length or more, however common its words are.
    4. A candidate counts if a common subsequence around it carries ``SURE`` of the item's word weight, or ``LIKELY``
       of it and ``ANSWER`` of its last quarter, where the answer stands.

    No text is shuffled; the driver holds the benchmark's words and vectors, which do not grow with the documents.
    The benchmark is the query set: it is read into the driver in blocks of ``ITEM_BLOCK`` items.  Null or empty texts
    and items match nothing; a null doc_id stays null; repeated rows give repeated results; repeated items count once;
    an empty table on either side gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, cosine double, share double, answer_share double, first_word long"
    found = spark.createDataFrame([], schema)
    for index in indexes(docs, benchmark):
        found = found.union(docs.mapInArrow(_search(index), schema))
    return found


def indexes(docs: DataFrame, benchmark: DataFrame):
    """One index per block of ``ITEM_BLOCK`` items, read block by block."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy("item_id", "text")
    for block in itertools.batched(rows.toLocalIterator(), ITEM_BLOCK):
        index = build_index(docs, [r["item_id"] for r in block], [r["text"] for r in block])
        if index:
            yield index


def build_index(docs: DataFrame, ids: list[int], texts: list[str]) -> Index | None:
    vocabulary = np.unique(tokens.words(*tokens.text_bytes(pa.array(texts, pa.string())), tokens.ALNUM)[0])
    if not len(vocabulary):
        return None
    counted = docs.mapInArrow(_frequencies(vocabulary), "col long, n long").groupBy("col").agg(F.sum("n").alias("n")).toArrow()
    column, counts = counted["col"].to_numpy(), counted["n"].to_numpy()
    df = np.zeros(len(vocabulary) + BUCKETS)
    df[column[column >= 0]] = counts[column >= 0]
    n = max(1, int(counts[column == -1].sum()))
    idf = np.log((n + 1) / (df + 1)) + 0.1
    index = Index(vocabulary, idf[: len(vocabulary)], idf[len(vocabulary) :])
    index.items = _item_tables(texts, ids, vocabulary)

    passages, owner, length, most = [], [], [], []
    for number, (_, words, _) in enumerate(index.items):
        for at in range(0, len(words), 2 * HALF_PASSAGE):
            v = np.zeros(len(vocabulary))
            np.add.at(v, words[at : at + 2 * HALF_PASSAGE], index.idf[words[at : at + 2 * HALF_PASSAGE]])
            length.append(np.linalg.norm(v))
            most.append(np.unique(words[at : at + 2 * HALF_PASSAGE], return_counts=True)[1].max())
            passages.append(v / length[-1])
            owner.append(number)
    vectors = np.array(passages)
    rank = min(RANK, len(vocabulary))
    omega = np.random.default_rng(20261001).standard_normal((len(vocabulary), rank))
    y = np.zeros(omega.shape)
    sums = docs.mapInArrow(_range_finder(index, omega), "col long, v array<double>")
    sums = sums.select("col", F.posexplode("v").alias("k", "x")).groupBy("col", "k").agg(F.sum("x").alias("x")).toArrow()
    y[sums["col"].to_numpy(), sums["k"].to_numpy()] = sums["x"].to_numpy()
    index.basis = decompose(y, omega, vectors)
    latent = (vectors @ index.basis).astype(np.float32)
    index.queries = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    index.owner, index.length, index.most = np.array(owner), np.array(length), np.array(most)
    return index


def _keep(index: Index, place: int):
    """Batches of whole rows without those whose text (column ``place``) holds an item."""
    table = (index.idf[:, None] * index.basis).astype(np.float32)

    def run(batches):
        for part in tokens.pieces(batches):
            hashes, starts = tokens.words(*tokens.text_bytes(part.column(place)), tokens.ALNUM)
            gone = {r for r, *_ in _search_found(index, table, hashes, starts)}
            yield part.filter(pa.array([i not in gone for i in range(part.num_rows)], pa.bool_()))
    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item, by the rules of ``contaminated``; all columns stay.

    Every row is judged by its own text in one narrow pass, so null or repeated ids make no difference.
    """
    kept = docs
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    for index in indexes(plain, benchmark):
        kept = kept.mapInArrow(_keep(index, docs.columns.index("text")), docs.schema)
    return kept
