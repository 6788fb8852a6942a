"""Budgets that all tasks share: running costs over ordered rows, so that what lies beyond a limit keeps a row that says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.relations import checkpointed


def running_sums(df: DataFrame, group: list[str], order: list[str], costs: dict[str, Column]) -> DataFrame:
    """df with a column for each of costs: the sum over all rows of its group up to this one and with it, in the given order.

    Rows are sorted by range, so a group of any size lies in many tasks; sums by partition and group turn those within a
    partition into running ones. Rows equal in all of `order` come in any order; nulls come first.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = {f"__c{i}": c for i, c in enumerate(costs.values())}
    laid = df.withColumns(own).repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    laid = checkpointed(laid.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sums = laid.groupBy("__part", *group).agg(*[F.sum(c).alias(f"__s{c}") for c in own])
    earlier = (Window.partitionBy(*group) if group else Window).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sums = sums.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], *[F.coalesce(F.sum(f"__s{c}").over(earlier), F.lit(0)).alias(f"__b{c}") for c in own])
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    within = Window.partitionBy("__part", *group).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    return laid.join(sums, same).select(*df.columns, *[(F.col(f"__b{c}") + F.sum(c).over(within)).alias(name) for name, c in zip(costs, own)])


def running(df: DataFrame, group: list[str], order: list[str], cost: Column | str) -> DataFrame:
    """df with `upto`: the cost of all rows of its group up to this one and with it."""
    return running_sums(df, group, order, {"upto": F.col(cost) if isinstance(cost, str) else cost})


def beyond(df: DataFrame, group: list[str], order: list[str], cost: Column | str, most: int, already: Column | int = 0) -> DataFrame | None:
    """The rows of df that lie beyond the limit: up to and with them their group costs more than `most`, `already` included.

    None if there are none. Sums by group tell which groups pass the limit; only these are put in order.
    """
    cost, already = F.col(cost) if isinstance(cost, str) else cost, F.lit(already) if isinstance(already, int) else already
    sums = df.groupBy(*group).agg(F.sum(cost).alias("__sum"), F.max(already).alias("__already"))
    heavy = checkpointed(sums.where(F.col("__sum") + F.col("__already") > most).select(*[F.col(g).alias(f"__h{i}") for i, g in enumerate(group)], F.col("__already")))
    if heavy.isEmpty():
        return None
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__h{i}"))
    some = df.join(heavy, same).select(*df.columns, "__already")
    return running(some, group, order, cost).where(F.col("upto") + F.col("__already") > most).select(*df.columns)


def first_rows(df: DataFrame, group: list[str], order: list[str], k: int, most: int) -> DataFrame:
    """df with `taken`: TAKEN for the first k rows of each group as long as all groups together take at most `most`, else
    GROUP_LIMIT or BUDGET_LIMIT; no row goes without saying so.

    Groups stand in their order, and rows in theirs; both numbers are running counts over ranges, so neither a group nor
    the whole meets in one task.
    """
    own = running(df, group, order, F.lit(1).cast("long")).withColumnRenamed("upto", "__k")
    all_ = running(own, [], [*group, *order], (F.col("__k") <= k).cast("long"))
    taken = F.when(F.col("__k") > k, "GROUP_LIMIT").when(F.col("upto") > most, "BUDGET_LIMIT").otherwise("TAKEN")
    return all_.select(*df.columns, taken.alias("taken"))
