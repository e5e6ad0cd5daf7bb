"""Which dependencies are wanted, present and installable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Orders in which package managers are asked.
POLICIES = {"display": ["brew", "npm", "pip"], "install": ["brew", "pip", "npm"]}


def wanted(deps: DataFrame, selected: DataFrame, key: str, *, all_of_them: bool = False, also: str = "false") -> DataFrame:
    """Dependencies whose key is selected, or that the condition `also` takes in; with all_of_them, all."""
    if all_of_them:
        return deps
    chosen = selected.select(F.col(key).alias("__key")).distinct().withColumn("__in", F.lit(True))
    return deps.join(chosen, F.col(key) == F.col("__key"), "left").where(f"coalesce(__in, false) or coalesce({also}, false)").drop("__key", "__in")


def counts(deps: DataFrame, present: str = "present") -> DataFrame:
    """(state, n) for installed and missing, both shown. Entries without a check, whose `present` is null, count as neither."""
    states = F.explode(F.array(F.struct(F.lit("installed").alias("state"), F.col("i").alias("n")), F.struct(F.lit("missing").alias("state"), F.col("m").alias("n"))))
    return deps.agg(F.count(F.when(F.col(present), 1)).alias("i"), F.count(F.when(~F.col(present), 1)).alias("m")).select(states.alias("s")).select("s.*")


def manager(policy: str = "display"):
    """The first package manager that has a package for the row, else `manual`."""
    return F.coalesce(*[F.when(F.col(m) != "", m) for m in POLICIES[policy]], F.lit("manual"))


def package_lists(deps: DataFrame, policy: str = "display") -> DataFrame:
    """(manager, packages, n): the packages of each manager by name, of a list of dependencies."""
    package = F.coalesce(*[F.when(F.col(m) != "", F.col(m)) for m in POLICIES[policy]], F.col("name"))
    return deps.select(manager(policy).alias("manager"), package.alias("p")).groupBy("manager").agg(F.sort_array(F.collect_list("p")).alias("packages"), F.count(F.lit(1)).alias("n"))
