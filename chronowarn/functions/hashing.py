"""Seeded draws from content: the same seed gives the same result on any partitioning."""

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

HASH_SPACE = 4294967296.0


def seeded_digest(seed, *parts) -> Column:
    """md5 text of ``seed|part|...``."""
    columns = [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def hash_int(seed, *parts) -> Column:
    """First 32 bits of the seeded digest as a BIGINT."""
    return F.conv(F.substring(seeded_digest(seed, *parts), 1, 8), 16, 10).cast("long")


_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_LANES = 8192


def _md5_words(m: np.ndarray) -> np.ndarray:
    """First digest word of one-block messages, ``m`` being 16 rows of words."""
    a, b, c, d = (np.full(m.shape[1], v, np.uint32) for v in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _SINES[i]
        f += m[g]
        a, d, c = d, c, b
        high = f >> np.uint32(32 - _TURNS[i])
        f <<= np.uint32(_TURNS[i])
        f |= high
        b = f + b
    return a + _START[0]


def hash_ints(prefix: str, numbers: np.ndarray) -> np.ndarray:
    """``hash_int`` of ``prefix`` followed by each nonnegative number, for many numbers inside a task.

    ``prefix`` holds the seed and the leading parts with a bar after each.
    """
    head = prefix.encode()
    numbers = np.asarray(numbers, np.int64)
    out = np.empty(len(numbers), np.uint32)
    digits = np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), numbers, side="right") + 1
    for k in np.unique(digits).tolist():
        size = len(head) + k
        if size > 55:
            raise ValueError("the hashed text must fit one block of 55 bytes")
        places = np.flatnonzero(digits == k)
        for at in range(0, len(places), _LANES):
            some = places[at:at + _LANES]
            block = np.zeros((len(some), 64), np.uint8)
            block[:, :len(head)] = np.frombuffer(head, np.uint8)
            rest = numbers[some]
            for j in range(k - 1, -1, -1):
                rest, digit = np.divmod(rest, 10)
                block[:, len(head) + j] = digit + 48
            block[:, size] = 128
            block[:, 56:64] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
            out[some] = _md5_words(np.ascontiguousarray(block.view("<u4").T)).byteswap()
    return out


def hash_uniform(seed, *parts) -> Column:
    return hash_int(seed, *parts) / F.lit(HASH_SPACE)


def hash_rank(df: DataFrame, id_col: str, seed, by=(), out: str = "hash_rank") -> DataFrame:
    """Rank 1..n of each row in seeded hash order, plus the stratum size ``<out>_n``.

    The hash prefix splits every stratum into 256 even buckets.  A window ranks inside a
    bucket, and the 256 bucket counts per stratum give the offset, so no task sorts a
    whole stratum.
    """
    by = list(by)
    digest = f"__{out}_h"
    bucket = f"__{out}_b"
    rows = df.withColumn(digest, seeded_digest(seed, id_col)).withColumn(
        bucket, F.conv(F.substring(digest, 1, 2), 16, 10).cast("int"))
    sizes = rows.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("__n"))
    order = W.partitionBy(*by).orderBy(bucket) if by else W.partitionBy(F.lit(0)).orderBy(bucket)
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    offsets = sizes.withColumn("__before", F.sum("__n").over(order) - F.col("__n")).withColumn(
        f"{out}_n", F.sum("__n").over(whole)).drop("__n")
    ranked = rows.withColumn(out, F.row_number().over(W.partitionBy(*by, bucket).orderBy(digest, id_col)))
    keys = by + [bucket]
    condition = None
    offsets = offsets.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__before", f"{out}_n")
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        condition = term if condition is None else condition & term
    return (ranked.join(offsets, condition, "inner")
            .withColumn(out, F.col(out) + F.col("__before"))
            .drop("__before", digest, bucket, *[f"__k_{k}" for k in keys]))
