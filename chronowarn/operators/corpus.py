"""Text-corpus preparation: leakage checks, families, deduplication, review samples, coverage."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronowarn.functions.hashing import hash_uniform, seeded_digest
from chronowarn.session import materialise


def leaking_groups(rows: DataFrame, split: str, keys: Sequence[str]) -> DataFrame:
    """Key values that occur in more than one split.  Only extremes travel, so a common key costs nothing extra."""
    long = rows.select(split, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("z"))
    groups = long.select(split, "z.*").filter("value IS NOT NULL AND value <> ''").groupBy("key", "value").agg(
        F.min(split).alias("first_split"), F.max(split).alias("last_split"))
    return groups.filter("first_split <> last_split")


def connected_families(rows: DataFrame, id_col: str, keys: Sequence[str]) -> DataFrame:
    """Smallest id reachable through shared key values, per row.

    Rows with the same whole key tuple are one node, so a crowd of copies is a single
    node.  Rounds alternate node -> key -> node minima (partial aggregates, never pairs of
    rows) with a jump to the label's own label; each round is written out to end lineage.
    """
    sig = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0002")) for k in keys]), 256)
    tagged = materialise(rows.select(id_col, sig.alias("__sig"), *keys), "families-in")
    nodes = tagged.groupBy("__sig").agg(F.min(id_col).alias("node"), *[F.first(k).alias(k) for k in keys])
    edges = nodes.select("node", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(k).cast("string").alias("v")) for i, k in enumerate(keys)])).alias("z"))
    edges = materialise(edges.select("node", F.sha2(F.concat_ws("\u0001", "z.k", "z.v"), 256).alias("key")).filter("z.v IS NOT NULL AND z.v <> ''"), "families-edges")
    labels = materialise(nodes.select("node", F.col("node").alias("label")), "families-0")
    step = 0
    while True:
        step += 1
        by_key = edges.join(labels, "node").groupBy("key").agg(F.min("label").alias("m"))
        reach = edges.join(by_key, "key").groupBy("node").agg(F.min("m").alias("m"))
        moved = labels.join(reach, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m", F.col("label"))).alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        nxt = moved.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("up", F.col("label"))).alias("label"))
        nxt = materialise(nxt, f"families-{step}")
        changed = nxt.filter("old <> label").limit(1).count()
        labels = nxt.select("node", "label")
        if not changed:
            break
    owners = tagged.join(nodes.select("__sig", "node"), "__sig").join(labels, "node")
    return owners.select(id_col, F.col("label").alias("family"))


def one_per_key(rows: DataFrame, keys: Sequence[str], id_col: str, seed, conflict: str | None = None) -> DataFrame:
    """Mark each row kept or dropped: the hash-smallest id of a key stays; keys whose ``conflict`` values differ lose all rows."""
    digest = seeded_digest(seed, id_col)
    tagged = rows.withColumn("__h", digest)
    agg = [F.min_by(F.col(id_col), F.struct("__h", id_col)).alias("__keep"), F.count(F.lit(1)).alias("copies")]
    bad = F.lit(False)
    if conflict:
        agg += [F.min(conflict).alias("__lo"), F.max(conflict).alias("__hi")]
        bad = F.coalesce(F.col("__lo") != F.col("__hi"), F.lit(False))
    groups = tagged.groupBy(*keys).agg(*agg)
    joined = tagged.join(groups, list(keys))
    fate = F.when(bad, "conflicting_scores").when(F.col(id_col) == F.col("__keep"), "kept").otherwise("duplicate")
    return joined.withColumn("fate", fate).drop("__h", "__keep", "__lo", "__hi")


def exposed_keys(new: DataFrame, seen: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """New rows sharing any key value with earlier exposure, with the keys they share."""
    def long(df, *extra):
        z = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("z")
        return df.select(*extra, z).select(*extra, "z.*").filter("value IS NOT NULL AND value <> ''")
    earlier = long(seen).distinct()
    hits = long(new, id_col).join(earlier, ["key", "value"], "left_semi")
    return hits.groupBy(id_col).agg(F.concat_ws(",", F.array_sort(F.collect_set("key"))).alias("shared"))


def component_roles(families: DataFrame, seed: int, validation_fraction: float) -> Column:
    return F.when(hash_uniform(seed, "family") < validation_fraction, "validation").otherwise("train")


def round_robin_sample(rows: DataFrame, metric: str, band: str, id_col: str, per_metric: int, seed: int) -> DataFrame:
    """Per metric, take bands in turn in hash order until ``per_metric`` rows are chosen.

    No band can supply more than ``per_metric`` rows, so each (metric, band, hash bucket)
    keeps its first ``per_metric`` before the final small ranking.
    """
    h = rows.withColumn("__h", seeded_digest(seed, metric, id_col)).withColumn("__b", F.conv(F.substring("__h", 1, 2), 16, 10).cast("int"))
    first = W.partitionBy(metric, band, "__b").orderBy("__h", id_col)
    near = h.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= per_metric)
    turn = W.partitionBy(metric, band).orderBy("__h", id_col)
    near = near.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= per_metric)
    order = W.partitionBy(metric).orderBy("turn", band)
    return near.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= per_metric).drop("__h", "__b", "__r")


def coverage(rows: DataFrame, role: str, metric: str, value: str, person: str) -> DataFrame:
    """Rows, labelled rows, people, range, end points and five score bands per role and metric."""
    v = F.col(value)
    band = F.least(F.floor(v / 20), F.lit(4))
    people = rows.filter(v.isNotNull()).groupBy(role, metric, person).agg(F.lit(1).alias("one")).groupBy(role, metric).agg(F.count(F.lit(1)).alias("people"))
    main = rows.groupBy(role, metric).agg(
        F.count(F.lit(1)).alias("rows"), F.count(v).alias("labelled"), F.min(v).alias("minimum"), F.max(v).alias("maximum"),
        F.count_if(v == 0).alias("zero"), F.count_if(v == 100).alias("hundred"), *[F.count_if(band == b).alias(f"band{b}") for b in range(5)])
    return main.join(people, [role, metric], "left").fillna(0, ["people"])


def readiness(cov: DataFrame, role: str, metric: str) -> DataFrame:
    """Blocking messages: roles with metrics that have no labelled rows (one row per role, metrics are few)."""
    return cov.filter("labelled = 0").groupBy(role).agg(F.concat_ws(", ", F.array_sort(F.collect_set(metric))).alias("missing_metrics"))


def fixed_anchor_drift(rows: DataFrame, group: str, order: str, value: str, by: str) -> DataFrame:
    """Mean and largest absolute difference from each group's first row."""
    anchor = rows.groupBy(group).agg(F.min_by(value, order).alias("anchor"), F.min(order).alias("__o"))
    j = rows.join(anchor, group).filter(F.col(order) > F.col("__o"))
    d = F.abs(F.col(value) - F.col("anchor"))
    return j.groupBy(by).agg(F.count(F.lit(1)).alias("pairs"), F.avg(d).alias("mean_drift"), F.max(d).alias("largest_drift"))
