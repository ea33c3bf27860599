"""Table files: JSON, JSON lines and CSV with strict headers and rows; lossless export."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


class BadHeader(ValueError):
    """A header has blank or repeated names, or does not match the declared schema."""


def _csv_header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.option("header", "false").csv(path).limit(1).collect()
    return [] if not first else [("" if v is None else str(v).strip()) for v in first[0]]


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read by file suffix against a declared schema; ragged or malformed rows fail the job."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        header = _csv_header(spark, path)
        if any(not h for h in header) or len(set(header)) != len(header):
            raise BadHeader(f"blank or repeated column in {path}")
        if header != schema.fieldNames():
            raise BadHeader(f"columns {header} differ from {schema.fieldNames()}")
        return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").csv(path)
    if suffix == "jsonl":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if suffix == "json":
        return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    if suffix == "parquet":
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"unsupported table file {path}")


def export_view(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write without rounding; an existing target is an error."""
    writer = df.write.mode("errorifexists")
    if fmt == "json":
        writer.option("ignoreNullFields", "false").json(path)
    elif fmt == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.parquet(path)


TARGETS = ("participant_id", "variable", "value", "unit", "start_at", "end_at", "available_at", "provenance_kind")


def map_columns(df: DataFrame, column_map: dict[str, str], timezone: str, source_id: str) -> DataFrame:
    """Wide acquisition rows to observations; every target column must be mapped exactly once."""
    if sorted(column_map.values()) != sorted(TARGETS):
        raise ValueError("each target column must be mapped exactly once")
    if set(column_map) - set(df.columns):
        raise ValueError(f"unknown source columns {sorted(set(column_map) - set(df.columns))}")
    back = {v: k for k, v in column_map.items()}
    out = {t: F.col(back[t]) for t in TARGETS}
    for t in ("start_at", "end_at", "available_at"):
        out[t] = out[t].cast("timestamp")
    numeric = F.col(back["value"]).cast("string").try_cast("double")
    text = F.when(numeric.isNull(), F.col(back["value"]).cast("string"))
    rest = [out[t].alias(t) for t in TARGETS if t != "value"]
    return df.select(*rest, numeric.alias("value_num"), text.alias("value_text"), F.lit(timezone).alias("timezone"), F.lit(source_id).alias("source_id"))


def first_existing_table(spark: SparkSession, names) -> DataFrame:
    """The first recognised table name that exists in the catalog."""
    for n in names:
        if spark.catalog.tableExists(n):
            return spark.table(n)
    raise ValueError(f"none of {list(names)} exists")


def matrix_long(df: DataFrame, record: str, features) -> DataFrame:
    """Record x feature interchange in long form: one (record, feature, value) row per cell."""
    return df.select(record, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("z")).select(record, "z.*")


def input_view(df: DataFrame, allowed) -> DataFrame:
    """Only whitelisted input columns; any label-like extra column is an error."""
    extra = [c for c in df.columns if c not in set(allowed)]
    if extra:
        raise ValueError(f"columns not allowed in an input view: {extra}")
    return df


def read_sessions(spark: SparkSession, path: str, header: str, columns) -> DataFrame:
    """Delimited rows that follow a header line inside a mixed text file.

    Each file's header position is found first (one small row per file); lines are kept by
    comparing their position in the file with it.  A line with another number of fields stops the read.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), at.alias("at"))
    heads = lines.filter(F.col("value") == header).groupBy("file").agg(F.min("at").alias("head_at"))
    body = lines.join(heads, "file").filter((F.col("at") > F.col("head_at")) & (F.trim("value") != ""))
    parts = F.split("value", ",")
    ragged = F.raise_error(F.concat(F.lit("line with another number of fields: "), F.col("value"))).cast("array<string>")
    checked = body.select(F.when(F.size(parts) == len(columns), parts).otherwise(ragged).alias("parts"))
    return checked.select(*[F.get("parts", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def seal_packet(rows: DataFrame, folder: str, parts: dict[str, list[str]]) -> DataFrame:
    """Write column groups of one plan as separate tables, so answers never travel with inputs; returns a manifest."""
    from chronowarn.sources.store import digest

    manifest = None
    for name, columns in parts.items():
        target = f"{folder}/{name}"
        rows.select(*columns).write.mode("errorifexists").parquet(target)
        stored = rows.sparkSession.read.parquet(target)
        entry = digest(stored).select(F.lit(name).alias("part"), F.lit(",".join(columns)).alias("columns"), "rows", "digest_a", "digest_b")
        manifest = entry if manifest is None else manifest.unionByName(entry)
    return manifest


def normalise_fields(rows: DataFrame, key: str, specs: dict[str, tuple[float, float]]) -> DataFrame:
    """Wide monitoring rows to (record, field, raw, value, state): valid, missing, unreadable or out of range."""
    from chronowarn.sources.adapters import WARD_MISSING, is_missing

    cells = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("raw"), F.lit(lo).cast("double").alias("low"), F.lit(hi).cast("double").alias("high")) for f, (lo, hi) in specs.items()]
    long = rows.select(key, F.explode(F.array(*cells)).alias("z")).select(key, "z.*")
    number = F.col("raw").try_cast("double")
    state = F.when(is_missing("raw", WARD_MISSING), "missing").when(number.isNull(), "unreadable").when(~number.between(F.col("low"), F.col("high")), "out_of_range").otherwise("valid")
    return long.withColumn("state", state).withColumn("value", F.when(F.col("state") == "valid", number)).drop("low", "high")
