"""Person-cluster resampling from per-person counts."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronowarn.functions.hashing import hash_int, hash_ints, hash_rank

BLOCK = 4096        # people of one block: a chunk of draws by a block of people is what a task multiplies
CHUNK = 512         # draws of one chunk
SLOTS = 1 << 18     # slots hashed at once


def person_index(people: DataFrame, id_col: str, seed: int) -> tuple[DataFrame, int]:
    """Dense index 1..n of each person in seeded hash order, and n."""
    ranked = hash_rank(people.select(id_col).distinct(), id_col, seed).select(id_col, F.col("hash_rank").alias("idx"))
    return ranked, people.select(id_col).distinct().count()


def draw_counts(spark, n: int, repetitions: int, seed: int) -> DataFrame:
    """How often each person index is drawn in each replicate (n slots per replicate, with replacement).

    Slots are generated in the executors and counted on the map side.
    """
    slots = spark.range(repetitions * n).select((F.col("id") / n).cast("long").alias("draw"), (F.col("id") % n).alias("slot"))
    picked = slots.select("draw", (hash_int(seed, F.lit("draw"), "draw", "slot") % n + 1).alias("idx"))
    return picked.groupBy("draw", "idx").agg(F.count(F.lit(1)).alias("times"))


def draw_cells(spark, n: int, repetitions: int, seed: int) -> DataFrame:
    """The draws of ``draw_counts`` as (block, draw, times): one byte for each person of a block.

    Slots are hashed and counted inside tasks, so a byte per person and draw is shuffled, not a row.  A draw of many
    slots gives several rows per block, whose counts add up.
    """
    pieces = -(-n // SLOTS)

    def count(batches):
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                draw, piece = divmod(unit, pieces)
                slots = np.arange(piece * SLOTS, min(n, (piece + 1) * SLOTS))
                picked = np.sort(hash_ints(f"{seed}|draw|{draw}|", slots).astype(np.int64) % n)
                blocks = np.unique(picked // BLOCK)
                cuts = np.searchsorted(picked, np.r_[blocks * BLOCK, n])
                cells = []
                for b, lo, hi in zip(blocks.tolist(), cuts[:-1], cuts[1:]):
                    times = np.bincount(picked[lo:hi] - b * BLOCK, minlength=min(BLOCK, n - b * BLOCK))
                    if times.max() > 255:
                        raise OverflowError("a person was drawn more than 255 times")
                    cells.append(times.astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(np.full(len(blocks), draw)), pa.array(cells, pa.binary())], ["block", "draw", "times"])

    tasks = max(1, min(repetitions * pieces, 8 * spark.sparkContext.defaultParallelism))
    return spark.range(0, repetitions * pieces, 1, tasks).mapInArrow(count, "block long, draw long, times binary")


def packed(draws: DataFrame) -> DataFrame:
    """Listed draws (draw, idx, times) in the form of ``draw_cells``."""
    place = F.struct((F.col("idx") - 1).cast("long").alias("i"), F.col("times").cast("long").alias("t"))
    held = draws.groupBy(F.floor((F.col("idx") - 1) / BLOCK).alias("block"), "draw").agg(F.collect_list(place).alias("p"))

    def pack(batches):
        for batch in batches:
            cells = []
            for p in batch.column(2).to_pylist():
                if max(x["t"] for x in p) > 255:
                    raise OverflowError("a person was drawn more than 255 times")
                cells.append(np.bincount([x["i"] % BLOCK for x in p], [x["t"] for x in p], BLOCK).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary())], ["block", "draw", "times"])

    return held.select(F.col("block").cast("long"), F.col("draw").cast("long"), "p").mapInArrow(pack, "block long, draw long, times binary")


def in_chunks(people: DataFrame, repetitions: int) -> DataFrame:
    """People repeated for every chunk of draws, with block and chunk as keys."""
    chunks = F.sequence(F.lit(0).cast("long"), F.lit((repetitions - 1) // CHUNK).cast("long"))
    return people.select("*", F.floor((F.col("idx") - 1) / BLOCK).cast("long").alias("block"), F.explode(chunks).alias("chunk"))


def draws_by_block(people: DataFrame, cells: DataFrame, repetitions: int, multiply, schema: str) -> DataFrame:
    """``multiply(people, draws, weights)`` for every block and chunk: ``weights`` has a row per draw, a column per person.

    ``people`` has idx and at most a few rows per idx; sums over blocks are left to the caller.
    """
    def work(key, rows: pa.Table, drawn: pa.Table) -> pa.Table:
        draws, place = np.unique(drawn["draw"].to_numpy(), return_inverse=True)
        counts = drawn["times"].to_pylist()
        weights = np.zeros((len(draws), BLOCK))
        for at, c in zip(place, counts):
            weights[at, :len(c)] += np.frombuffer(c, np.uint8)
        return multiply(rows, draws, weights[:, (rows["idx"].to_numpy() - 1) % BLOCK])

    left = in_chunks(people, repetitions).groupBy("block", "chunk")
    right = cells.withColumn("chunk", F.floor(F.col("draw") / CHUNK).cast("long")).groupBy("block", "chunk")
    return left.cogroup(right).applyInArrow(work, schema)


def resampled_sums(counts: DataFrame, draws: DataFrame, values, by=(), repetitions: int | None = None) -> DataFrame:
    """Sum of per-person counts in each replicate, by block products where ``draws`` comes from ``draw_cells``.

    The shuffled size is replicates (times blocks of people), not rows.
    """
    if "block" in draws.columns:
        return _block_sums(counts, draws, list(values), list(by), repetitions)
    joined = counts.join(draws, "idx")
    return joined.groupBy(*by, "draw").agg(*[F.sum(F.col(v) * F.col("times")).alias(v) for v in values])


def _block_sums(counts: DataFrame, cells: DataFrame, values: list[str], by: list[str], repetitions: int) -> DataFrame:
    types = dict(counts.dtypes)
    people = counts.select("idx", *by, F.array(*[F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values]).alias("v"))

    def multiply(rows: pa.Table, draws: np.ndarray, weights: np.ndarray) -> pa.Table:
        v = rows["v"].combine_chunks().flatten().to_numpy().reshape(-1, len(values))
        keys = [tuple(r[b] for b in by) for r in rows.select(by).to_pylist()] if by else [()] * len(v)
        out = {b: [] for b in by}
        sums, which = [np.zeros((0, len(values)))], [np.zeros(0, np.int64)]
        for key in dict.fromkeys(keys):
            mine = np.array([k == key for k in keys])
            sums.append(weights[:, mine] @ v[mine])
            which.append(draws)
            for b, x in zip(by, key):
                out[b] += [x] * len(draws)
        columns = [pa.array(out[b], rows.schema.field(b).type) for b in by]
        return pa.table([*columns, pa.array(np.concatenate(which)), *[pa.array(c) for c in np.vstack(sums).T]], [*by, "draw", *values])

    schema = ", ".join([f"`{b}` {types[b]}" for b in by] + ["draw long"] + [f"`{v}` double" for v in values])
    parts = draws_by_block(people, cells, repetitions, multiply, schema)
    whole = [F.sum(v).cast("long") if types[v] in ("int", "bigint", "smallint", "tinyint") else F.sum(v) for v in values]
    return parts.groupBy(*by, "draw").agg(*[c.alias(v) for c, v in zip(whole, values)])


def resampled_medians(people: DataFrame, cells: DataFrame, value: str, repetitions: int, by: str) -> DataFrame:
    """(by, draw, m): median of a person's value in each draw of ``draw_cells``; people without a value are passed over.

    A task adds up how often a draw takes each distinct value of its block, so equal values travel once a block.
    """
    types = dict(people.dtypes)

    def multiply(rows: pa.Table, draws: np.ndarray, weights: np.ndarray) -> pa.Table:
        v, keys = rows["x"].to_numpy(), np.array(rows[by].to_pylist(), object)
        out = {"by": [], "draw": [], "x": [], "times": []}
        for key in dict.fromkeys(keys.tolist()):
            mine = keys == key
            values, place = np.unique(v[mine], return_inverse=True)
            held = np.zeros((len(draws), len(values)), np.int64)
            np.add.at(held.T, place, weights[:, mine].astype(np.int64).T)
            d, k = np.nonzero(held)
            out["by"] += [key] * len(d)
            for name, column in (("draw", draws[d]), ("x", values[k]), ("times", held[d, k])):
                out[name].append(column)
        whole = lambda c, t: np.concatenate(c) if c else np.zeros(0, t)
        return pa.table([pa.array(out["by"], rows.schema.field(by).type), pa.array(whole(out["draw"], np.int64)), pa.array(whole(out["x"], float)),
                         pa.array(whole(out["times"], np.int64))], [by, "draw", "x", "times"])

    known = people.filter(F.col(value).isNotNull()).select("idx", by, F.col(value).cast("double").alias("x"))
    parts = draws_by_block(known, cells, repetitions, multiply, f"`{by}` {types[by]}, draw long, x double, times long")
    return parts.groupBy(by, "draw").agg(F.percentile("x", 0.5, F.col("times")).alias("m"))


def percentile_interval(samples: DataFrame, values, by=(), level: float = 0.95) -> DataFrame:
    """Long table of linear percentile intervals; undefined replicates are counted, not filled."""
    tail = (1 - level) / 2
    long = samples.select(*by, F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])).alias("z")).select(*by, "z.*")
    return long.groupBy(*by, "metric").agg(
        F.percentile("value", tail).alias("low"), F.percentile("value", 1 - tail).alias("high"), F.count("value").alias("valid_replicates"))
