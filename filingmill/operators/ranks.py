"""Ranks, running sums and order statistics of groups of any size.

A window with ``partitionBy`` puts a group into one task. Here rows are ordered by range over all tasks, groups included;
what a range holds of a group is counted, and those few counts (at most one per group and range) are summed along the
ranges, so that every row knows what comes before it. A group of any size is thus dealt over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filingmill.sources.store import stored


def ordered(rows: DataFrame, name: str, *by: Column) -> DataFrame:
    """The rows stored in the order ``by``, dealt over tasks by range, with ``part``, the range a row lies in, and ``at``,
    unique and rising in that order. Rows that are equal in all of ``by`` share a range, so ``by`` should tell rows apart.
    The other functions take such rows, whose order begins with the group."""
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(sorted_rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), name)


def _with_before(lines: DataFrame, size: Column, group: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """Rows with ``__low``, the least ``at`` of their group in their range, and ``__before``, the sizes of the group's earlier ranges."""
    earlier = W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    sums = lines.groupBy(*group, "part").agg(size.alias("n"), F.min("at").alias("low"))
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    sums = sums.toDF(*[f"__{c}" for c in sums.columns])
    on = F.col("part") == F.col("__part")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return lines.join(sums, on), sums.columns


def ranked(lines: DataFrame, *group: str) -> DataFrame:
    """``k``: places from 1 within each group, ``row_number`` without its window."""
    met, added = _with_before(lines, F.count("*"), group)
    return met.withColumn("k", F.col("at") - F.col("__low") + F.col("__before") + 1).drop(*added, "part", "at")


def running(lines: DataFrame, value: str, *group: str) -> DataFrame:
    """``before``: the sum of ``value`` over the earlier rows of the group."""
    within = W.partitionBy(*group, "part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)  # a range's share of a group
    met, added = _with_before(lines.withColumn("__own", F.coalesce(F.sum(value).over(within), F.lit(0))), F.sum(value), group)
    return met.withColumn("before", F.col("__own") + F.col("__before")).drop(*added, "__own", "part", "at")


def average_ranks(rows: DataFrame, value: str, name: str, *group: str) -> DataFrame:
    """Rows with ``name``, the rank of ``value`` in its group, equal values at their average rank. Equal values are counted
    first, so the values of a group are ranked, not its rows; rows without a value drop out."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__ties"))
    placed = running(ordered(counts, name, *[F.asc(c) for c in (*group, value)]), "__ties", *group)
    rank = F.col("before") + (F.col("__ties") + 1) / 2
    return rows.join(placed.select(*group, value, rank.alias(name)), [*group, value])


def percentiles(lines: DataFrame, value: str, steps: list[float], *group: str) -> DataFrame:
    """(group, n, edges): interpolated quantiles of ``value``, by which the lines are ordered in their group. Only the rows at
    the places that the steps fall between are gathered, two per step, so no buffer holds a group."""
    counted = ranked(lines, *group)
    sizes = lines.groupBy(*group).agg(F.count("*").alias("n")).toDF(*[f"__{c}" for c in (*group, "n")])
    on = F.lit(True)
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    met = counted.join(sizes, on)
    at = [(F.col("__n") - 1) * F.lit(float(s)) for s in steps]
    wanted = F.array(*[f(p) + 1 for p in at for f in (F.floor, F.ceil)])
    needed = met.where(F.array_contains(wanted, F.col("k"))).groupBy(*group).agg(
        F.max("__n").alias("n"), F.map_from_entries(F.collect_set(F.struct("k", value))).alias("found")
    )
    edges = []
    for s in steps:
        p = (F.col("n") - 1) * F.lit(float(s))
        low, high = F.col("found")[F.floor(p) + 1], F.col("found")[F.ceil(p) + 1]
        edges.append(F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high))
    return needed.select(*group, "n", F.array(*edges).alias("edges"))
