"""Document quality: classifier evidence combined with host and path posteriors by empirical Bayes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronowarn.llm import tokens
from chronowarn.llm.classify import SAMPLE, fit_labelled
from chronowarn.llm.shared import written

EDGE = 1e-4          # posteriors are kept this far from 0 and 1
KEEP = 0.5           # posterior from which a document is kept
WEAKEST, STRONGEST = 2.0, 1e4   # bounds of a prior's weight in documents


def _evidence(model):
    shift = np.log(model.prior[1] / model.prior[0])

    def run(batches):
        for batch in tokens.pieces(batches):
            p = np.clip(model.posteriors(batch.column(1))[:, 1], EDGE, 1 - EDGE) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (0, 2, 3)], pa.array(p), pa.array(np.log(p / (1 - p)) - shift)],
                                             ["doc_id", "host", "path", "p_document", "evidence"])
    return run


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(centre: str) -> Column:
    """Weight of a beta prior whose spread equals that of the sites' rates beyond chance (method of moments)."""
    chance = F.sum(F.col("n") * F.col(centre) * (1 - F.col(centre))) / F.sum("n")
    between = F.sum(F.col("n") * (F.col("rate") - F.col(centre)) ** 2) / F.sum("n")
    spare = F.greatest(between - F.sum(F.col(centre) * (1 - F.col(centre))) / F.sum("n"), F.lit(1e-6))
    return F.least(F.greatest(chance / spare - 1, F.lit(WEAKEST)), F.lit(STRONGEST))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """host_posterior and path_posterior of every (host, path) of ``scored`` (host, path, y in 0 to 1).

    Counts are partial sums per (host, path); hosts and the corpus are sums of those.  A host's rate is shrunk toward
    the corpus rate, a path's toward its host's posterior; the prior weights come from the spread of the rates.
    """
    paths = written(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good")), "sites")
    total = paths.agg((F.sum("good") / F.sum("n")).alias("corpus"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("rate", F.col("good") / F.col("n"))
    hosts = hosts.join(F.broadcast(total))  # one row
    weight = hosts.agg(_strength("corpus").alias("weight"))
    hosts = hosts.join(F.broadcast(weight)).select(  # one row
        "host", ((F.col("good") + F.col("weight") * F.col("corpus")) / (F.col("n") + F.col("weight"))).alias("host_posterior"))
    inside = paths.withColumnRenamed("host", "_host").join(hosts, F.col("_host").eqNullSafe(F.col("host"))).withColumn("rate", F.col("good") / F.col("n"))
    weight = inside.agg(_strength("host_posterior").alias("weight"))
    return inside.join(F.broadcast(weight)).select(  # one row
        "host", "path", "host_posterior", ((F.col("good") + F.col("weight") * F.col("host_posterior")) / (F.col("n") + F.col("weight"))).alias("path_posterior"))


def quality(docs: DataFrame, labels: DataFrame, host="source", path="lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, p_document, host_posterior, path_posterior, posterior, kept for every row of ``docs``.

    A label is good if quality is 1 and toxic is not 1.  The classifier sees at most ``sample`` labelled documents;
    everything else covers all rows.  A site's evidence is the label of a labelled document and the classifier's
    probability of another.  posterior joins a document's own evidence (its odds without the sample's prior) with
    the odds of its path; kept: posterior at least ``KEEP``.

    ``host`` and ``path`` name the columns that stand for the site and the part of it; nulls are sites of their own.
    Null text is judged as empty; null doc_id has no label; of labels that repeat a doc_id the worse counts; rows
    that repeat a doc_id are separate documents.  Without labels the classifier says one half and the sites nothing.
    Empty input gives no rows.  Extra columns are ignored.
    """
    good = F.when(F.col("quality").isNotNull(), ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) != 1)).cast("int"))
    model = fit_labelled(docs, labels, good, 2, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    scored = written(rows.mapInArrow(_evidence(model), "doc_id long, host string, path string, p_document double, evidence double"), "evidence")
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), good.alias("_good")).where("_good is not null").groupBy("doc_id").agg(F.min("_good").alias("_good"))
    known = scored.join(told, "doc_id", "left").withColumn("y", F.coalesce(F.col("_good").cast("double"), F.col("p_document")))
    sites = site_posteriors(known).withColumnsRenamed({"host": "_host", "path": "_path"})
    both = scored.join(sites, scored.host.eqNullSafe(sites["_host"]) & scored.path.eqNullSafe(sites["_path"]))
    prior = F.least(F.greatest("path_posterior", F.lit(EDGE)), F.lit(1 - EDGE))
    odds = F.col("evidence") + _logit(prior)
    return both.select("doc_id", "p_document", "host_posterior", "path_posterior", (1 / (1 + F.exp(-odds))).alias("posterior")).withColumn("kept", F.col("posterior") >= KEEP)
