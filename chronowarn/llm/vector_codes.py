"""Product codes of vectors: exact integer k-means of every part over Hilbert-sorted blocks with boxes and sums.

Each part of every vector goes into one of four tables sorted along a Hilbert curve and cut into flat blocks.  A block
holds its rows as one integer matrix, the smallest box around them and their sum.  A round measures the box against
all entries of the codebook: an entry whose least distance to the box is above another's greatest one can win nowhere
in it.  The entries that are left are the block's shortlist, and a small exact kernel compares the rows with those; a
shortlist of one takes the stored sum and looks at no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronowarn.llm import tokens
from chronowarn.llm.shared import written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK = 64                # rows of a block
LARGEST = 1 << 28         # scaled components stay below this, so that all sums fit in 64 bits
KEY_AXES, KEY_BITS = 16, 4


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of every row of ``cells`` (rows x axes, whole numbers below ``2 ** bits``).

    Axes times bits are 64 at most.  The turns of the curve are undone from the highest bit down, all rows at once.
    """
    axes = cells.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        high, low = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(len(axes)):
            turned = (axes[i] & high) != 0
            swap = np.where(turned, np.uint64(0), (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(turned, low, swap)
            axes[i] ^= swap
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    flip = np.zeros(axes.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(axes[-1] & (one << np.uint64(level)), (one << np.uint64(level)) - one, np.uint64(0))
    axes ^= flip
    key = np.zeros(axes.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << one) | ((axis >> np.uint64(level)) & one)
    return key


def _cells(rows: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Rows on the grid of the curve: neighbouring components are averaged to ``KEY_AXES`` axes at most."""
    z = (rows - centre) / spread
    if rows.shape[1] > KEY_AXES:
        cuts = np.linspace(0, rows.shape[1], KEY_AXES + 1).astype(int)
        z = np.add.reduceat(z, cuts[:-1], axis=1) / np.sqrt(np.diff(cuts))
    levels = 1 << KEY_BITS
    return np.clip(np.floor((z + 2) * (levels / 4)), 0, levels - 1).astype(np.uint64)


def _part_rows(width: int, seeds: np.ndarray):
    """(rid, part, key, data) of every part; ``seeds`` (entries x components) set the scale of the grid only."""
    centre, spread = seeds.mean(0), seeds.std(0) + 1.0

    def run(batches):
        for batch in tokens.pieces(batches):
            rows = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, PARTS * width)
            for part in range(PARTS):
                span = slice(part * width, (part + 1) * width)
                mine = np.ascontiguousarray(rows[:, span])
                keys = hilbert_keys(_cells(mine, centre[span], spread[span]), KEY_BITS) if width else np.zeros(len(rows), np.uint64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(np.full(len(rows), part, np.int32)), pa.array((keys ^ np.uint64(1 << 63)).view(np.int64)),
                    pa.array([r.tobytes() for r in mine], pa.binary())], ["rid", "part", "key", "data"])
    return run


BLOCK_SCHEMA = "part int, n int, low binary, high binary, total binary, rids binary, data binary"


def _blocks(batches):
    """Sorted part rows to flat blocks of ``BLOCK`` rows of one part."""
    def block(part, rids, data):
        rows = np.frombuffer(b"".join(data), np.int32).reshape(len(rids), -1)
        wide = rows.astype(np.int64)
        return {"part": part, "n": len(rids), "low": wide.min(0).tobytes(), "high": wide.max(0).tobytes(), "total": wide.sum(0).tobytes(),
                "rids": np.array(rids, np.int64).tobytes(), "data": rows.tobytes()}

    schema = pa.schema([("part", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("low", "high", "total", "rids", "data")]])
    now, rids, data = None, [], []
    for batch in tokens.pieces(batches):
        out = []
        for rid, part, row in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if rids and (part != now or len(rids) == BLOCK):
                out.append(block(now, rids, data))
                rids, data = [], []
            now = part
            rids.append(rid)
            data.append(row)
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if rids:
        yield pa.RecordBatch.from_pylist([block(now, rids, data)], schema=schema)


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entries that can be nearest, alone or tied, to some point of the box from ``low`` to ``high``, ascending."""
    least = np.maximum(low - entries, 0) + np.maximum(entries - high, 0)
    most = np.maximum(np.abs(entries - low), np.abs(entries - high))
    return np.flatnonzero((least * least).sum(1) <= (most * most).sum(1).min())


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest of ``entries`` (ties: the lowest) and squared distance of every row, in whole numbers.

    Floating-point products are used only where every intermediate value is a whole number below 2**53.
    """
    reach = max(int(np.abs(rows).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * max(1, rows.shape[1]) * reach * reach < 1 << 53:
        x, e = rows.astype(np.float64), entries.astype(np.float64)
        far = (x * x).sum(1)[:, None] - 2.0 * (x @ e.T) + (e * e).sum(1)
        best = far.argmin(1)
        return best, far[np.arange(len(rows)), best].astype(np.int64)
    best, least = np.zeros(len(rows), np.int64), np.full(len(rows), np.iinfo(np.int64).max)
    for i, entry in enumerate(entries.astype(np.int64)):
        gap = rows.astype(np.int64) - entry
        far = (gap * gap).sum(1)
        closer = far < least
        best[closer], least[closer] = i, far[closer]
    return best, least


def _read(batch):
    """Part, box, sum, row ids and rows of every block of a batch."""
    for part, n, low, high, total, rids, data in zip(*(batch.column(i).to_pylist() for i in range(7))):
        yield part, *(np.frombuffer(x, np.int64) for x in (low, high, total, rids)), np.frombuffer(data, np.int32).reshape(n, -1)


def _round(books: list[np.ndarray]):
    """Rows, and sum of rows, that each entry of each part's codebook wins, summed over a task."""
    width = books[0].shape[1]

    def run(batches):
        counts, sums = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, width), np.int64)
        for batch in tokens.pieces(batches):
            for part, low, high, total, rids, rows in _read(batch):
                able = shortlist(low, high, books[part])
                if len(able) == 1:
                    counts[part, able[0]] += len(rids)
                    sums[part, able[0]] += total
                    continue
                won = able[nearest(rows, books[part][able])[0]]
                order = np.argsort(won, kind="stable")
                heads = np.flatnonzero(np.r_[True, won[order][1:] != won[order][:-1]])
                counts[part] += np.bincount(won, minlength=ENTRIES)
                sums[part, won[order][heads]] += np.add.reduceat(rows[order].astype(np.int64), heads, axis=0)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]),
                                          pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])
    return run


def _codes(books: list[np.ndarray]):
    def run(batches):
        for batch in tokens.pieces(batches):
            for part, low, high, _, rids, rows in _read(batch):
                able = shortlist(low, high, books[part])
                best, far = nearest(rows, books[part][able])
                yield pa.RecordBatch.from_arrays([pa.array(rids), pa.array(np.full(len(rids), part, np.int32)), pa.array(able[best].astype(np.int32)), pa.array(far)],
                                                 ["rid", "part", "entry", "far"])
    return run


def improve(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: an entry becomes the floored mean of the rows it wins, one without rows stays."""
    width = books[0].shape[1]
    won = blocks.mapInArrow(_round(books), "part int, entry int, n long, total array<long>")
    won = won.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).cast("array<long>").alias("total"))
    books = [b.copy() for b in books]
    for row in won.toArrow().to_pylist():     # PARTS times ENTRIES rows at most
        books[row["part"]][row["entry"]] = [s // row["n"] for s in row["total"]]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimals, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 and label of every kept row of ``vectors`` (vec_id, embedding, label).

    A row is kept if its vector is there and has no null, NaN or infinite component.  Components become
    floor(1024 x); a vector is cut into ``PARTS`` equal parts.  Each part's codebook starts as that part of the kept
    rows with the ``ENTRIES`` smallest ids (equal ids: the smaller vector first; a null id never starts an entry) and
    has as many entries as there are such rows.  After ``ROUNDS`` rounds all parts are assigned once more.

    code: two hexadecimal digits per part; error: the squared distances summed over parts; label_error: errors summed
    over rows of equal label, null labels together.  Rows that repeat an id are coded one by one.  Empty input, or no
    row with an id, gives no rows.  Vectors of unequal length, of a length that ``PARTS`` does not divide, or with a
    component of ``LARGEST`` / 1024 or more raise ValueError.  Extra columns are ignored.

    Codebooks (PARTS x ENTRIES rows) are all that the driver and the tasks' closures hold.  Equal vectors are dealt by a
    hash of their row, so copies spread over tasks and make blocks whose box is a point.
    """
    spark = vectors.sparkSession
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("embedding").isNotNull() & whole)
    rows = rows.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * F.lit(float(SCALE)))).alias("v"))
    kept = written(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    size, least, most = kept.agg(F.max(F.size("v")), F.min(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    first = kept.where("vec_id is not null").select("vec_id", "v").orderBy("vec_id", "v").limit(ENTRIES).toArrow()["v"].to_pylist()
    label = kept.schema["label"].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"vec_id long, code string, error long, label_error long, codebooks_sha256 string, label {label}")
    if size != least or size % PARTS:
        raise ValueError(f"vectors of {least} to {size} components cannot be cut into {PARTS} equal parts")
    if (most or 0) >= LARGEST:
        raise ValueError("components are too large for exact 64-bit distances")
    width = size // PARTS
    seeds = np.array(first, np.int64).reshape(len(first), size)
    books = [seeds[:, p * width : (p + 1) * width].copy() for p in range(PARTS)]

    parts = kept.select("rid", F.col("v").cast("array<int>").alias("v")).mapInArrow(_part_rows(width, seeds), "rid long, part int, key long, data binary")
    parts = parts.withColumn("deal", F.xxhash64("rid")).repartitionByRange("part", "key", "deal").sortWithinPartitions("part", "key", "deal")
    blocks = written(parts.select("rid", "part", "data").mapInArrow(_blocks, BLOCK_SCHEMA), "vector-blocks")
    for _ in range(ROUNDS):
        books = improve(blocks, books)
    told = blocks.mapInArrow(_codes(books), "rid long, part int, entry int, far long").groupBy("rid").agg(
        F.concat(*[F.lpad(F.lower(F.hex(F.max(F.when(F.col("part") == p, F.col("entry"))))), 2, "0") for p in range(PARTS)]).alias("code"), F.sum("far").alias("error"))
    coded = written(kept.select("rid", "vec_id", "label").join(told, "rid").select("vec_id", "label", "code", "error"), "codes")
    totals = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "label-errors")
    return coded.join(totals, coded.label.eqNullSafe(totals["_label"])).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "label")
