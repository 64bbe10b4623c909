"""Parameter dates and their places.

A place is the number of a date among the sorted dates. A calendar has one row per day, so at most the 3,652,059 days that a
date can be: it says which date is the first on or after a day. Rows that hold for a span of days look up the places of its
ends by an equal join and are put to the dates between; so the cost is the rows plus the result, for any number of dates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dates:
    """Dates of a parameter table: ``days`` (day, place), ``n`` of them from ``low`` to ``high``."""

    days: DataFrame
    low: object
    high: object
    n: int

    @classmethod
    def of(cls, table: DataFrame, column: str) -> Dates:
        dates = table.select(F.col(column).cast("date").alias("day")).where("day is not null").distinct()
        low, high, n = dates.agg(F.min("day"), F.max("day"), F.count("*")).first()
        marked = dates.withColumn("is_date", F.lit(1))
        if n:
            span = F.explode(F.sequence(F.lit(low).cast("date"), F.date_add(F.lit(high).cast("date"), 1))).alias("day")
            every = table.sparkSession.range(1).select(span)
        else:
            every = marked.select("day")
        before = W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)  # days of a calendar
        place = (F.coalesce(F.sum(F.coalesce("is_date", F.lit(0))).over(before), F.lit(0)) + 1).cast("int")
        return cls(every.join(marked, "day", "left").select("day", place.alias("place"), "is_date"), low, high, n)

    def first_from(self, rows: DataFrame, day: Column, name: str) -> DataFrame:
        """``name``: place of the first date on or after ``day``, n + 1 where there is none; rows without a day drop out."""
        if not self.n:
            return rows.where("false").withColumn(name, F.lit(1))
        clamped = F.greatest(F.least(day, F.date_add(F.lit(self.high).cast("date"), 1)), F.lit(self.low).cast("date"))
        days = F.broadcast(self.days.select(F.col("day").alias("__day"), F.col("place").alias(name)))  # days of a calendar
        return rows.withColumn("__at", F.when(day.isNotNull(), clamped)).join(days, F.col("__at") == F.col("__day")).drop("__at", "__day")

    def named(self, rows: DataFrame, place: str, name: str) -> DataFrame:
        """The date of each place, instead of it."""
        days = F.broadcast(self.days.where("is_date = 1").select(F.col("place").alias("__place"), F.col("day").alias(name)))
        return rows.join(days, F.col(place) == F.col("__place")).drop("__place", place)

    def expanded(self, rows: DataFrame, first: Column, last: Column, name: str = "place") -> DataFrame:
        """Rows once per place from ``first`` to ``last``."""
        return rows.withColumn("__first", first).withColumn("__last", last).where("__first <= __last").withColumn(
            name, F.explode(F.sequence("__first", "__last"))
        ).drop("__first", "__last")
