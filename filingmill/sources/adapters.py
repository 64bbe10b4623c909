"""Price and universe adapters behind one interface: a name gives a function that returns the canonical columns.

``read_prices(spark, "chart", path, tickers, start, end)`` and ``read_universe(spark, "csv", path)`` look the name up; ``add_prices``
and ``add_universe`` make further ones known. A reader of prices gets the tickers asked for, so that it can open their files
alone; what it returns is cut to tickers and dates here as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingmill.functions.text import strip

from .filings import universe_from_csv
from .folders import register
from .prices import ALIASES, prices_from_chart_json

PriceReader = Callable[[SparkSession, str, list[str] | None], DataFrame]
UniverseReader = Callable[..., DataFrame]
BARS = ("ticker", "date", "open", "high", "low", "close", "volume", "adj_close", "source")
MEMBERS = ("ticker", "start_date", "end_date")
#: Characters of a text that Spark can hold at most; a longer file is an error.
WHOLE = 2**31 - 1
#: A cell of a CSV line with a comma before it: quoted, quotes in it doubled or escaped, or up to the next comma.
_CELL = r',("(?:[^"\\]++|\\.|"")*+"[^,]*+|[^,]*+)'


def _folder(spark: SparkSession, kind: str, path: str, tickers: list[str] | None, **options) -> DataFrame:
    register(spark)
    rows = spark.read.format(kind).options(path=path, **options).load()
    return rows.where(F.col("ticker").isin(tickers)) if tickers is not None else rows


def charts(spark: SparkSession, path: str, tickers: list[str] | None = None) -> DataFrame:
    """Bars of ``<ticker>.json`` files, each read whole, as JSON is one value."""
    return prices_from_chart_json(_folder(spark, "chart_folder", path, tickers, piece_chars=WHOLE).select("ticker", F.col("text").alias("value")))


def csv_files(spark: SparkSession, path: str, tickers: list[str] | None = None) -> DataFrame:
    """Bars of ``<ticker>.csv`` files, each with a header of its own; columns are found by alias, missing prices are the close."""
    # A long file comes in pieces of whole lines, each under the header.
    lines = _folder(spark, "csv_folder", path, tickers, lines=True).select("ticker", F.split("text", "\r?\n|\r").alias("lines"))
    # Every line as an array of its cells; the first line names them. A line is taken apart once: what is made of arrays of one
    # element is computed before its uses, and filters are not pushed below the generator.
    bare = lambda c: F.when(F.startswith(c, F.lit('"')), F.regexp_replace(c, r'^"(.*)"\s*$', "$1")).otherwise(c)
    quoted = lambda line: F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1)), bare)
    # Where no quote is, commas alone part the cells, which takes a fraction of the time.
    cells = lambda line: F.array(F.when(F.contains(line, F.lit('"')), quoted(line)).otherwise(F.split(line, ",")))
    place = lambda header, kind: F.coalesce(*[F.nullif(F.array_position(header, F.lit(name)), F.lit(0)) for name in ALIASES[kind]])
    named = F.transform(cells(F.col("lines")[0]), lambda header: F.transform(header, lambda c: F.lower(F.trim(c))))
    places = F.transform(named, lambda header: F.struct(*[(place(header, kind) - 1).cast("int").alias(kind) for kind in ALIASES]))
    rows = lines.select("ticker", "lines", F.explode(places).alias("at")).select("ticker", "at", F.explode(F.slice("lines", 2, 2**31 - 1)).alias("line"))
    rows = rows.select("ticker", "at", F.explode(cells(F.col("line"))).alias("cells"))
    cell = lambda kind: strip(F.get("cells", F.col("at")[kind]))
    number = lambda kind: cell(kind).try_cast("double")
    bars = rows.select(
        "ticker", cell("date").try_cast("date").alias("date"), *[number(k).alias(k) for k in ("open", "high", "low", "close")],
        number("volume").cast("bigint").alias("volume"), number("adj_close").alias("adj_close"), F.lit("csv").alias("source"),
    ).where("date is not null and close is not null")
    filled = {k: F.coalesce(k, "close") for k in ("open", "high", "low")}
    return bars.withColumns({**filled, "volume": F.coalesce("volume", F.lit(0).cast("bigint"))})


def static_universe(spark: SparkSession, tickers: list[str], start: str = "1900-01-01") -> DataFrame:
    """Members throughout: the tickers, upper case, each once."""
    names = sorted({t.strip().upper() for t in tickers if t and t.strip()})
    rows = spark.createDataFrame([(t,) for t in names], "ticker string")
    return rows.select("ticker", F.lit(start).cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"))


_prices: dict[str, PriceReader] = {"chart": charts, "csv": csv_files}
_universes: dict[str, UniverseReader] = {"csv": universe_from_csv, "static": static_universe}


def _add(known: dict, name: str, reader, replace: bool) -> None:
    if (name in known) != replace:
        raise ValueError(f"{name} is {'not ' if replace else ''}known")
    known[name] = reader


def add_prices(name: str, reader: PriceReader, replace: bool = False) -> None:
    _add(_prices, name, reader, replace)


def add_universe(name: str, reader: UniverseReader, replace: bool = False) -> None:
    _add(_universes, name, reader, replace)


def _checked(rows: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    missing = set(columns) - set(rows.columns)
    if missing:
        raise ValueError(f"{name} gives no {', '.join(sorted(missing))}")
    return rows.select(*columns)


def read_prices(spark: SparkSession, name: str, path: str, tickers: list[str] | None = None, start=None, end=None) -> DataFrame:
    """Bars of a known adapter, of some tickers and an inclusive range of dates; ValueError for an unknown name."""
    if name not in _prices:
        raise ValueError(f"{name} is not known")
    bars = _checked(_prices[name](spark, path, tickers), BARS, name)
    if tickers is not None:
        bars = bars.where(F.col("ticker").isin(tickers))
    for bound, keep in ((start, lambda d: F.col("date") >= d), (end, lambda d: F.col("date") <= d)):
        if bound is not None:
            bars = bars.where(keep(F.lit(bound).cast("date")))
    return bars


def read_universe(spark: SparkSession, name: str, *args, **options) -> DataFrame:
    """Membership intervals of a known adapter."""
    if name not in _universes:
        raise ValueError(f"{name} is not known")
    return _checked(_universes[name](spark, *args, **options), MEMBERS, name)
