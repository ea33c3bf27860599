"""MinHash near-duplicate groups with tensored banding and exact confirmation."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chronowarn.llm import tokens
from chronowarn.llm.shared import components, star_compare, whole_row, written

HALF = 2            # minhashes in each half of a table key
MISS = 1.5e-5       # wanted bound on the chance that one half never agrees at the threshold
BLOCK_HASHES = 500_000  # shingles of one head's members that a task compares with as many others


def collections(percent: int) -> int:
    """How many minhash groups each of the two collections needs at this threshold."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** HALF))


def _features(shingle: int, percent: int):
    n_hashes = 2 * HALF * collections(percent)
    factor, shift = tokens.constants(n_hashes, 7), tokens.constants(n_hashes, 11)

    def run(batches):
        for batch in tokens.pieces(batches):
            hashes, starts = tokens.words(*tokens.text_bytes(batch.column(1)), tokens.NOT_SPACE)
            sets = tokens.shingle_sets(hashes, starts, shingle)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            sketch = np.zeros((len(sets), n_hashes), np.uint32)
            key = np.zeros((len(sets), 2), np.uint64)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                cut = np.r_[0, np.cumsum(sizes[full])[:-1]]
                for k in range(n_hashes):
                    v = flat * factor[k] + shift[k]
                    sketch[full, k] = (np.minimum.reduceat(v ^ (v >> np.uint64(29)), cut) >> np.uint64(16)).astype(np.uint32)
                for k in range(2):
                    key[full, k] = np.add.reduceat(tokens.mix(flat + np.uint64(k + 1) * shift[0]), cut)
            flags = sizes > 0
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes), pa.array(key[:, 0].view(np.int64)), pa.array(key[:, 1].view(np.int64)),
                pa.array([row.tobytes() if keep else None for row, keep in zip(sketch, flags)], pa.binary())],
                ["doc_id", "n_shingles", "key_a", "key_b", "sketch"])
    return run


def _table_keys(percent: int):
    m = collections(percent)
    weight = tokens.constants(HALF, 13)

    def run(batches):
        for batch in tokens.pieces(batches):
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, 2, m, HALF).astype(np.uint64)
            half = tokens.mix((sketch * weight).sum(3))  # (rows, collection, group)
            table = np.arange(m * m, dtype=np.uint64).reshape(m, m)
            key = tokens.mix(half[:, 0, :, None] + half[:, 1, None, :] * np.uint64(tokens.BASE) + table)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), m * m)))], ["key", "cid"])
    return run


def _sets(shingle: int):
    def run(batches):
        for batch in tokens.pieces(batches):
            hashes, starts = tokens.words(*tokens.text_bytes(batch.column(1)), tokens.NOT_SPACE)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in tokens.shingle_sets(hashes, starts, shingle)], pa.binary())], ["id", "data"])
    return run


def _confirm(percent: int):
    """Links whose full sets meet the threshold; the head's sets stay while its members pass."""
    def run(batches):
        at, heads = None, []
        for batch in tokens.pieces(batches):
            a, b = [], []
            for head, block, role, id_, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                mine = np.frombuffer(data, np.uint64)
                if (head, block) != at:
                    at, heads = (head, block), []
                if role == 0:
                    heads.append(mine)
                elif any(_linked(h, mine, percent) for h in heads):
                    a.append(head)
                    b.append(id_)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    same = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def _between(percent: int):
    """Links between components among the members of one head: left rows against all right rows at once.

    The right sets are numbered over their union; a left set marks its numbers and the marks are summed per right
    set, which gives all intersections exactly.  Only links that join two components are returned.
    """
    def links(left, right):
        if not left or not right:
            return
        ids, comps = np.array([r[1] for r in right], np.int64), np.array([r[2] for r in right], np.int64)
        sets = [np.frombuffer(r[3], np.uint64) for r in right]
        sizes = np.array([len(s) for s in sets])
        union, flat = np.unique(np.concatenate(sets), return_inverse=True)
        cut, mark = np.r_[0, np.cumsum(sizes)[:-1]], np.zeros(len(union), np.int32)
        for _, id_, comp, data in left:
            mine = np.frombuffer(data, np.uint64)
            comp = renamed.get(comp, comp)
            if not len(mine) or (comps == comp).all():
                continue
            at = np.minimum(np.searchsorted(union, mine), len(union) - 1)
            at = at[union[at] == mine]
            mark[at] = 1
            same = np.add.reduceat(mark[flat], cut)
            mark[at] = 0
            near = np.flatnonzero((100 * same >= percent * (len(mine) + sizes - same)) & (comps != comp))
            for other in np.unique(comps[near]).tolist():
                yield id_, int(ids[near[comps[near] == other][0]])
                comps[comps == other] = comp
                for k, v in list(renamed.items()):
                    if v == other:
                        renamed[k] = comp
                renamed[other] = comp

    renamed: dict[int, int] = {}

    def run(batches):
        at, left, right = None, [], []
        for batch in tokens.pieces(batches):
            found = []
            for head, lo, hi, *row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (head, lo, hi) != at:
                    found.extend(links(left, right))
                    at, left, right = (head, lo, hi), [], []
                    renamed.clear()
                (right if row[0] else left).append(row)
            yield _links(found)
        yield _links(list(links(left, right)))
    return run


def _links(found):
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct ``shingle``-word runs over lower-cased words between white space; fewer
    words make one run.  Documents are linked when 100 * intersection >= ``percent`` * union of the full sets.

    1. Documents with equal sets form one class, so copies cost one row whatever their number.
    2. Tensored banding: two collections of m groups of two minhashes give m * m tables, whose keys combine one
       group of each.  m is taken from the threshold so that a linked pair meets in some table but for about
       three chances in 100,000.
    3. Every bucket is compared as a star with its smallest member, its head, on full sets (``star_compare``).
    4. Any two members of a bucket have its head in common.  Where the members of a head are still in several
       components, those outside the largest are compared with all of them on full sets, in blocks of bounded size;
       only links that join components leave the task, so no group is expanded into pairs.

    No bucket is capped.  Null text and text without words: n_shingles 0, alone.  Null doc_id: the component of its
    class where that has an id, else null and kept only then.  Repeated rows share a component; rows that repeat an id
    with other texts are linked through it.  Empty input gives no rows.  Extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = written(docs.mapInArrow(_features(shingle, percent), "doc_id long, n_shingles long, key_a long, key_b long, sketch binary"), "features")
    full = feats.where("n_shingles > 0")
    classes = full.groupBy("key_a", "key_b", "n_shingles").agg(F.min("doc_id").alias("cid"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes")
    known = classes.where("cid is not null")

    keys = known.select("cid", "sketch").repartition(F.col("cid")).mapInArrow(_table_keys(percent), "key long, cid long")
    buckets = keys.groupBy("key").agg(F.min("cid").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    stars = written(keys.join(buckets, "key").where("cid <> head").select("head", F.col("cid").alias("member")).distinct(), "stars")

    ids = stars.select(F.col("head").alias("doc_id")).union(stars.select("member")).distinct()
    # one plan at every size: the texts are dealt by id, never joined with a list of ids sent to every task;
    # so the disk a run needs grows with its input
    sets = written(docs.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(shingle), "id long, data binary"), "sets")
    links = written(star_compare(stars, sets, _confirm(percent), "a long, b long"), "links")

    members = full.join(classes.drop("sketch"), ["key_a", "key_b", "n_shingles"]).select("doc_id", "cid")
    repeated = members.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a <> b").select("a", "b")
    links = links.union(repeated)
    groups = components(links)

    # heads whose members are still in several components
    placed = stars.join(groups, stars.member == groups.node, "left").select("head", "member", F.coalesce("component", "member").alias("comp"))
    placed = placed.join(known.select(F.col("cid").alias("member"), "n_shingles"), "member")
    parts = placed.groupBy("head", "comp").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_size"))
    mixed = parts.groupBy("head").agg(F.max_by("comp", F.struct("_n", "comp")).alias("_main"), F.count(F.lit(1)).alias("_comps"), F.sum("_size").alias("_all"))
    rest = placed.join(mixed.where("_comps > 1"), "head").withColumn("_k", F.ceil(F.col("_all") / BLOCK_HASHES).cast("int"))
    rest = rest.withColumn("_at", F.pmod(F.xxhash64("member"), F.col("_k")).cast("int")).withColumn("_to", F.explode(F.expr("sequence(0, _k - 1)")))
    left = rest.where("comp <> _main").select("head", F.col("_at").alias("_left"), F.col("_to").alias("_right"), F.lit(0).alias("side"), "member", "comp")
    right = rest.select("head", F.col("_to").alias("_left"), F.col("_at").alias("_right"), F.lit(1).alias("side"), "member", "comp")
    rows = left.union(right).join(sets.withColumnRenamed("id", "member"), "member").select("head", "_left", "_right", "side", "member", "comp", "data")
    rows = rows.repartition("head", "_left", "_right").sortWithinPartitions("head", "_left", "_right", "side", "member")
    more = written(rows.mapInArrow(_between(percent), "a long, b long").distinct(), "across")
    groups = components(links.union(more)) if not more.isEmpty() else groups

    named = classes.select("key_a", "key_b", "n_shingles", "cid").join(groups, F.col("cid") == F.col("node"), "left").select(
        "key_a", "key_b", "n_shingles", F.coalesce("component", "cid").alias("component_id"))
    out = feats.drop("sketch").join(named, ["key_a", "key_b", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each near-duplicate group; of rows that repeat a doc_id the smallest text stays.

    All columns stay.  Rows with a null doc_id stay (they cannot be told apart).
    """
    gone = near_duplicates(docs, shingle, percent).where("not kept and doc_id is not null").select("doc_id").distinct()
    left = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("doc_id"), "text").join(gone.hint("merge"), "doc_id", "left_anti")
    ranked = left.withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    return ranked.where("_rank = 1 or doc_id is null").select("_row.*")
