"""Seeded role assignment, folds and stratified roles in hash order."""

from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from chronowarn.functions.hashing import hash_rank, hash_uniform

ROLES = ("reference", "development", "calibration", "test")
FRACTIONS = (0.25, 0.35, 0.2, 0.2)


def split_people(people: DataFrame, id_col: str, seed: int, fractions=FRACTIONS, roles=ROLES) -> DataFrame:
    """Role by hash rank with boundaries floor(cumulative fraction * n); the last role takes the rest."""
    ranked = hash_rank(people.select(id_col).distinct(), id_col, seed)
    bounds = list(accumulate(fractions))[:-1]
    role = F.lit(roles[-1])
    for bound, name in reversed(list(zip(bounds, roles))):
        role = F.when(F.col("hash_rank") <= F.floor(F.lit(round(bound, 12)) * F.col("hash_rank_n")), name).otherwise(role)
    return ranked.select(id_col, role.alias("role"))


def stratified_roles(people: DataFrame, id_col: str, stratum: str, seed: int) -> DataFrame:
    """In strata of five or more people a tenth (at least one) is test and the next tenth validation."""
    ranked = hash_rank(people.select(id_col, stratum).distinct(), id_col, seed, by=[stratum])
    n, r = F.col("hash_rank_n"), F.col("hash_rank")
    tenth = F.when(n >= 5, F.greatest(F.lit(1), F.bround(n * 0.1).cast("int"))).otherwise(0)
    role = F.when(r <= tenth, "test").when(r <= 2 * tenth, "validation").otherwise("train")
    return ranked.select(id_col, stratum, role.alias("role"))


def person_folds(people: DataFrame, id_col: str, seed: int, folds: int) -> DataFrame:
    """Even folds by hash rank modulo the number of folds."""
    ranked = hash_rank(people.select(id_col).distinct(), id_col, seed)
    return ranked.select(id_col, ((F.col("hash_rank") - 1) % folds).cast("int").alias("fold"))


def grouped_stratified_folds(labels: DataFrame, id_col: str, label_col: str, seed: int, folds: int) -> DataFrame:
    """People with any positive row and people without are dealt to folds separately."""
    people = labels.groupBy(id_col).agg(F.max(label_col).alias("stratum"))
    ranked = hash_rank(people, id_col, seed, by=["stratum"])
    return ranked.select(id_col, "stratum", ((F.col("hash_rank") - 1) % folds).cast("int").alias("fold"))


def component_role(component_col: str, seed: int, validation_fraction: float):
    """Role of a whole component by its hashed uniform."""
    return F.when(hash_uniform(seed, component_col) < validation_fraction, "validation").otherwise("train")
