"""Intermediate tables in the cluster's shared folder, star comparisons and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronowarn.session import materialise

STAR_BLOCK = 256


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below ``spark.checkpoint.dir`` and read it back: lineage ends, lost executors only re-read."""
    return materialise(df, f"llm-{label}")


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct ``_row``, so that no column of an operator can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def star_compare(pairs: DataFrame, payload: DataFrame, compare, schema: str, block: int = STAR_BLOCK) -> DataFrame:
    """Run ``compare`` over the pairs (head, member), one head with a block of its members at a time.

    ``payload`` holds (id, data); an id may have several rows.  A head with many members is copied once per
    ``block`` members, so no head gathers its group in one task.  ``compare`` is a ``mapInArrow`` function over
    rows (head, block, role, id, data) sorted so that the head's own row (role 0) comes before its members (1).
    """
    sizes = pairs.groupBy("head").agg(F.count(F.lit(1)).alias("_n"))
    dealt = pairs.join(sizes, "head").select(
        "head", "member", F.pmod(F.xxhash64("member"), F.ceil(F.col("_n") / block)).cast("int").alias("block"))
    members = dealt.join(payload.withColumnRenamed("id", "member"), "member").select(
        "head", "block", F.lit(1).alias("role"), F.col("member").alias("id"), "data")
    heads = dealt.select("head", "block").distinct().join(payload.withColumnRenamed("id", "head"), "head").select(
        "head", "block", F.lit(0).alias("role"), F.col("head").alias("id"), "data")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))   # a stated number: short rows that cost much are not merged by their bytes
    rows = heads.unionByName(members).repartition(tasks, "head", "block").sortWithinPartitions("head", "block", "role", "id")
    return rows.mapInArrow(compare, schema)


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node of undirected ``edges`` (a, b), as (node, component).

    Minimum labels travel along the edges and then jump to the label's own label, so a path of length n is
    closed in about log n rounds.  Every round is a written table; nothing is gathered on the driver.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "component": "_c"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("_c").alias("_near"))
        moved = labels.join(near, "node").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("_new"))
        up = labels.select(F.col("node").alias("_new"), F.col("component").alias("_up"))
        step = written(moved.join(up, "_new").select("node", "_old", F.least("_new", "_up").alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where("component <> _old").isEmpty():
            return labels

