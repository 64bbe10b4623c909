"""Returns from prices, long form: one row per ticker and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def compound(r: Column) -> Column:
    """Product of 1 + r, less 1; nulls are skipped, nothing gives 0."""
    return F.coalesce(F.product(1 + r), F.lit(1.0)) - 1


def by_ticker():
    return W.partitionBy("ticker").orderBy("date")


def change(price: str) -> Column:
    """Relative change of a price to the ticker's row before."""
    return F.try_divide(F.col(price), F.lag(price).over(by_ticker())) - 1


def daily_returns(prices: DataFrame, start=None, end=None) -> DataFrame:
    """(ticker, date, ret), the change to the ticker's last date; the range is cut afterwards."""
    r = prices.select("ticker", "date", change("price").alias("ret"))
    return in_range(r, start, end)


def in_range(rows: DataFrame, start=None, end=None) -> DataFrame:
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    return rows


def month_prices(prices: DataFrame) -> DataFrame:
    """The last price that is not null in each month, at the month's last day."""
    good = prices.where("price is not null")
    return good.groupBy(
        "ticker", F.last_day("date").alias("date0")
    ).agg(F.max_by("price", "date").alias("price")).withColumnRenamed("date0", "date")


def price_gaps(prices: DataFrame) -> DataFrame:
    """Month prices on every month of a ticker's life, gaps filled with the last price before."""
    monthly = month_prices(prices).withColumn("next", F.lead("date").over(by_ticker()))
    # A month's price holds until the month before the ticker's next one.
    until = F.coalesce(F.add_months(F.trunc("next", "month"), -1), F.trunc("date", "month"))
    held = F.explode(F.sequence(F.trunc("date", "month"), until, F.expr("interval 1 month"))).alias("m")
    return monthly.select("ticker", held, "price").select("ticker", F.last_day("m").alias("date"), "price")


def monthly_returns(prices: DataFrame, start=None, end=None) -> DataFrame:
    """(ticker, date, ret) at calendar month ends; a month without prices gives 0 and the next the whole move."""
    return in_range(price_gaps(prices).select("ticker", "date", change("price").alias("ret")), start, end)


def compound_to_monthly(daily: DataFrame) -> DataFrame:
    """Daily returns to months, at calendar month ends."""
    return daily.groupBy(
        "ticker", F.last_day("date").alias("month")
    ).agg(compound(F.col("ret")).alias("ret")).withColumnRenamed("month", "date")


def date_to_period(days: DataFrame, periods: DataFrame) -> DataFrame:
    """Each date with its period, start < date <= end; dates are distinct first, so both sides have a row per date or period."""
    return days.select("date").distinct().join(periods, (F.col("date") > F.col("period_start")) & (F.col("date") <= F.col("period_end")))


def period_returns_by_ticker(returns: DataFrame, periods: DataFrame) -> DataFrame:
    """(ticker, period_start, period_end, ret): compounded over the period; dates meet periods once, then an equi-join."""
    dated = returns.join(date_to_period(returns, periods), "date")
    return dated.groupBy("ticker", "period_start", "period_end").agg(compound(F.col("ret")).alias("ret"))


def price_coverage(prices: DataFrame, start, end) -> DataFrame:
    """Per ticker: first and last date, days, whether the series reaches ``end`` and has data in the range."""
    a, z = F.lit(start).cast("date"), F.lit(end).cast("date")
    return prices.groupBy("ticker").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_days"),
        (F.max("date") >= z).alias("complete"),
        F.max(F.col("date").between(a, z)).alias("has_data"),
    )


def missing_tickers(asked: DataFrame, prices: DataFrame) -> DataFrame:
    return asked.select("ticker").distinct().join(prices.select("ticker"), "ticker", "left_anti")
