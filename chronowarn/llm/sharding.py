"""Contiguous shards of near-equal bytes, cut from global prefix sums.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronowarn.llm.shared import written

ROW_BYTES = 16  # charged to every row besides its text


def _before(totals: DataFrame, by: str, column: str) -> Column:
    """Sum of ``column`` over the partitions ahead; ``totals`` has one short row per partition."""
    return F.coalesce(F.sum(column).over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def byte_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with size, text_crc32, shard (0 to ``shards`` - 1) and slot.

    Rows are put in the order (doc_id, text_crc32, size), nulls first, over range partitions and written once with
    their partition number.  Byte and row totals per partition give each partition's offset; running sums inside it
    give every row's place in the whole.  A row goes to the shard that holds the middle of its bytes:
    floor((2 * bytes before + size) * shards / (2 * all bytes)), so a shard differs from the target by less than one
    row at either end.  slot counts from 0 within the shard.

    Only sizes and ids are shuffled, never texts.  Null text: size 16, checksum null text as empty (0).  Repeated rows
    are separate rows, in any order among themselves.  Empty input: no rows.  Extra columns are ignored.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id"), size.alias("size"), crc.alias("text_crc32"))
    keys = ("doc_id", "text_crc32", "size")
    ranged = written(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranged")

    totals = ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    totals = totals.select("_part", _before(totals, "_part", "_bytes").alias("_bytes0"), _before(totals, "_part", "_rows").alias("_rows0"))
    everything = ranged.agg(F.sum("size").alias("_all"))

    ahead = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select(*keys, "_part", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("_bytes1"),
                           (F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1).alias("_rows1"))
    placed = placed.join(totals, "_part").join(F.broadcast(everything)).select(  # one row
        *keys, (F.col("_rows0") + F.col("_rows1")).alias("_row"),
        F.expr(f"cast(cast(2 * (_bytes0 + _bytes1) + size as decimal(38,0)) * {shards} div (2 * _all) as int)").alias("shard"))
    placed = written(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(  # at most ``shards`` rows
        *keys, "shard", (F.col("_row") - F.col("_first")).alias("slot"))
