"""Price bars and returns from CSV and chart JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingmill.functions.text import strip

# Names under which columns come.
ALIASES = {
    "date": ("date", "timestamp", "datetime"), "open": ("open", "open_price"), "high": ("high", "high_price"), "low": ("low", "low_price"),
    "close": ("close", "close_price", "last"), "volume": ("volume", "vol"),
    "adj_close": ("adj_close", "adj close", "adjclose", "adjusted_close"),
}
RETURN_NAMES, PRICE_NAMES = ("ret", "return", "returns"), ("price", "adj_close", "adjclose")
_CHART = (
    "struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<bigint>>>,"
    "adjclose:array<struct<adjclose:array<double>>>>>"
)


def _named(columns: list[str], names: tuple[str, ...]) -> str | None:
    return next((c for n in names for c in columns if c.strip().lower() == n), None)


def prices_from_rows(rows: DataFrame) -> DataFrame:
    """Bars of text rows with ``ticker``; column names by alias, missing prices from the close."""
    of = {k: _named(rows.columns, names) for k, names in ALIASES.items()}
    if not of["date"] or not of["close"]:
        raise ValueError("a date and a close column are needed")
    number = lambda k: strip(F.col(f"`{of[k]}`")).try_cast("double") if of[k] else F.lit(None).cast("double")
    close = number("close")
    return rows.select(
        "ticker", strip(F.col(f"`{of['date']}`")).try_cast("date").alias("date"),
        *[F.coalesce(number(k), close).alias(k) for k in ("open", "high", "low")], close.alias("close"),
        F.coalesce(number("volume").cast("bigint"), F.lit(0)).cast("bigint").alias("volume"),
        number("adj_close").alias("adj_close"), F.lit("csv").alias("source"),
    ).where("date is not null and close is not null")


def prices_from_csv(spark: SparkSession, path: str, ticker: str) -> DataFrame:
    return prices_from_rows(spark.read.csv(path, header=True).withColumn("ticker", F.lit(ticker)))


def prices_from_chart_json(raw: DataFrame, start=None, end=None) -> DataFrame:
    """Bars of chart JSON (``ticker``, ``value``); bars with any null of open, high, low, close are dropped."""
    c = raw.select("ticker", F.from_json("value", _CHART).alias("c"))
    quote = F.col("c.indicators.quote")[0]
    adjusted = F.col("c.indicators.adjclose")[0]["adjclose"]
    cols = c.select(
        "ticker", F.col("c.timestamp").alias("t"),
        *[quote[k].alias(k) for k in ("open", "high", "low", "close", "volume")],
        F.coalesce(adjusted, F.array().cast("array<double>")).alias("adj_close")
    )
    rows = cols.select(
        "ticker", F.explode(F.arrays_zip("t", "open", "high", "low", "close", "volume", "adj_close")).alias("z")
    ).select("ticker", "z.*")
    bars = rows.where("t is not null and open is not null and high is not null and low is not null and close is not null").select(
        "ticker", F.to_date(F.timestamp_seconds("t")).alias("date"), "open", "high", "low", "close",
        F.coalesce("volume", F.lit(0)).cast("bigint").alias("volume"), "adj_close",
        F.lit("yahoo_finance").alias("source")
    )
    if start is not None:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.where(F.col("date") <= F.lit(end).cast("date"))
    return bars


def returns_from_rows(rows: DataFrame) -> DataFrame:
    """(ticker, date, value, kind) of long text rows: the return column wins over a price; repeated days are averaged."""
    day, ret, price = (_named(rows.columns, n) for n in (("date",), RETURN_NAMES, PRICE_NAMES))
    if not day or not (ret or price):
        raise ValueError("a date and a return or price column are needed")
    value = strip(F.col(f"`{ret or price}`")).try_cast("double")
    found = rows.select(
        F.col("ticker"), strip(F.col(f"`{day}`")).try_cast("date").alias("date"), value.alias("value")
    ).where("date is not null")
    return found.groupBy("ticker", "date").agg(F.avg("value").alias("value")).withColumn("kind", F.lit("ret" if ret else "price"))


def returns_from_csv(spark: SparkSession, path: str) -> DataFrame:
    return returns_from_rows(spark.read.csv(path, header=True))
