"""Registration of queries over the provided tables and their reference SQL."""

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name`` for the survey ids it covers."""
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        run.__name__ = name
        QUERIES[name] = run
        COVERS[name] = tuple(ids.split())
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the scan has fewer splits than cores, for work that costs much per row.

    Decided by the number of splits alone; a table of many files or row groups is left where it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def rnd(column, digits: int = 6) -> Column:
    return F.round(column if isinstance(column, Column) else F.col(column), digits)


def sql_rnd(expression: str, digits: int = 6) -> str:
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0)"


def sql_pmod(expression: str, period: float) -> str:
    p = f"{period}::DOUBLE"
    return f"(({expression}) - floor(({expression}) / {p}) * {p})"


def sql_turn(expression: str, period: float = 24) -> str:
    """``sql_pmod`` with 0 for what lies within 1e-9 of the full period."""
    p = sql_pmod(expression, period)
    return f"(CASE WHEN {p} > {period} - 1e-9::DOUBLE THEN 0::DOUBLE ELSE {p} END)"


def sql_direction(cosine: str, sine: str) -> str:
    """Clock hour of a mean cosine and a mean sine, NULL where they cancel."""
    return f"(CASE WHEN sqrt(({cosine})**2 + ({sine})**2) > 1e-12 THEN {sql_turn(f'atan2({sine}, {cosine})*24/(2*pi())')} END)"


def rounded(df: DataFrame, columns: Iterable[str], digits: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, needs: str = "") -> None:
    """Name a reusable piece of reference SQL together with the pieces it reads."""
    CTES[name] = (tuple(needs.split()), sql)


def with_ctes(names: str, body: str, local: str = "") -> str:
    """Reference SQL that starts with every needed piece in dependency order."""
    seen: list[str] = []

    def visit(n: str) -> None:
        for dep in CTES[n][0]:
            visit(dep)
        if n not in seen:
            seen.append(n)

    for n in names.split():
        visit(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in seen]
    if local:
        parts.append(local)
    body = body.strip()
    if body.startswith(","):  # the body opens with further pieces of its own
        return "WITH RECURSIVE " + ",\n".join(parts) + body
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
