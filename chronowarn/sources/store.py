"""Append-only tables: duplicate keys are refused, earlier rows are never rewritten."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


class DuplicateRows(ValueError):
    """A batch repeats a key inside itself or against the stored table."""


def table_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def repeated_keys(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    return batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def append(batch: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Append a batch whose keys are new; the whole batch is refused otherwise."""
    spark = batch.sparkSession
    if repeated_keys(batch, keys).limit(1).count():
        raise DuplicateRows(f"batch repeats {list(keys)}")
    if table_exists(spark, path):
        stored = spark.read.parquet(path).select(*keys)
        if batch.select(*keys).join(stored, list(keys), "left_semi").limit(1).count():
            raise DuplicateRows(f"{list(keys)} already stored")
    batch.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_new(batch: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Idempotent append: rows whose keys are stored already are left out (replayed micro-batches)."""
    fresh = batch.dropDuplicates(list(keys))
    if table_exists(batch.sparkSession, path):
        fresh = fresh.join(batch.sparkSession.read.parquet(path).select(*keys), list(keys), "left_anti")
    fresh.write.mode("append").parquet(path)


def digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and an order-free content digest: sums of 32-bit pieces of each row's md5."""
    cols = list(columns or df.columns)
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in cols])
    h = F.md5(text)
    piece = lambda a: F.conv(F.substring(h, a, 8), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(piece(1)).alias("digest_a"), F.sum(piece(9)).alias("digest_b"))


def audit_entry(df: DataFrame, operation: str) -> DataFrame:
    """One audit row for an operation: name, time, row count and digest."""
    return digest(df).select(F.lit(operation).alias("operation"), F.current_timestamp().alias("at"), "rows", "digest_a", "digest_b")


def features_as_of(features: DataFrame, as_of: str = "as_of") -> DataFrame:
    """Features of each person-day that had arrived by ``as_of``, as one sorted array of structs.

    A person-day holds one value per feature name, so the array is bounded by the feature list.
    """
    known = features.filter(F.col("available_at") <= F.col(as_of))
    return known.groupBy("participant_id", "day").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("features"))


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content digest differs from, or is absent on either side of, the manifest."""
    found = files.select("path", F.sha2("content", 256).alias("actual"))
    j = manifest.select("path", "sha256").join(found, "path", "full")
    state = F.when(F.col("actual").isNull(), "missing_file").when(F.col("sha256").isNull(), "unlisted_file").when(F.col("actual") != F.col("sha256"), "changed")
    return j.withColumn("problem", state).filter("problem IS NOT NULL")


AUDIT = "step int, operation string, status string, rows_before long, rows_added long, digest_a long, digest_b long"


def append_audited(batch: DataFrame, path: str, keys: Sequence[str], audit: str, operation: str, parents: DataFrame | None = None) -> str:
    """Append ``batch`` and write one audit row; returns the row's status.

    ``refused_orphans``: a row lacks its parent (``parents`` holds the key columns it must have); ``refused_repeats``:
    a key is there already or twice in the batch; nothing is written then but the audit row.  After an append the rows
    that were there before must have the count and digest they had, else the store is reported as damaged.
    """
    spark = batch.sparkSession
    stored = spark.read.parquet(path) if table_exists(spark, path) else batch.limit(0)
    before = digest(stored, batch.columns).first()
    step = spark.read.parquet(audit).count() if table_exists(spark, audit) else 0
    status, added = "appended", 0
    if parents is not None and not batch.join(parents, parents.columns, "left_anti").isEmpty():
        status = "refused_orphans"
    else:
        try:
            append(batch, path, keys)
        except DuplicateRows:
            status = "refused_repeats"
    now = spark.read.parquet(path) if table_exists(spark, path) else stored
    after = digest(now, batch.columns).first()
    if status == "appended":
        added = after["rows"] - before["rows"]
        kept = digest(now.join(batch.select(*keys), list(keys), "left_anti"), batch.columns).first()
        if kept != before:
            raise ValueError(f"{operation}: stored rows changed while {path} grew")
    elif after != before:
        raise ValueError(f"{operation}: a refused batch changed {path}")
    row = (step, operation, status, before["rows"], added, after["digest_a"] or 0, after["digest_b"] or 0)
    spark.createDataFrame([row], AUDIT).write.mode("append").parquet(audit)
    return status
