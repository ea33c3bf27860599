"""Session settings shared by jobs, tests and the benchmark."""

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "chronowarn", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for truncated lineage, named by ``spark.checkpoint.dir``.

    A cluster must name it: a folder of one machine would be lost to the others.  Only a local master gets a
    temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df, label: str):
    """Write an intermediate once to the shared folder and read it back: lineage ends here.

    Parquet keeps column pruning and gives later joins true sizes, and a lost executor
    only re-reads files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def spread(rows):
    """Short rows that cost much each, dealt evenly to all cores by a number of tasks that adaptive execution keeps.

    Adaptive execution merges tasks by bytes, so a table of few megabytes would be read by one task in every pass.
    """
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


_WRITTEN: dict[tuple, str] = {}


def _listing(spark: SparkSession, folder: str) -> tuple:
    """Name, length and time of what lies in ``folder``, so that changed input is not answered from old tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def _table_key(spark: SparkSession, folder: str, label: str) -> tuple:
    return spark.sparkContext.applicationId, folder, _listing(spark, folder), label


def built_table(spark: SparkSession, folder: str, label: str):
    """The shared table of that name where this session has built it, else None."""
    path = _WRITTEN.get(_table_key(spark, folder, label))
    return spark.read.parquet(path) if path and _readable(spark, path) else None


def shared_table(spark: SparkSession, folder: str, label: str, build):
    """A panel table several queries read: built on first use in a session, then re-read."""
    built = built_table(spark, folder, label)
    if built is not None:
        return built
    key = _table_key(spark, folder, label)
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    build().write.parquet(path)
    _WRITTEN[key] = path
    return spark.read.parquet(path)


def forget_shared_tables() -> None:
    """Make the next query build its own panel tables (used for cold timings)."""
    _WRITTEN.clear()


def _readable(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
