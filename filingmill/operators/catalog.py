"""Look-ups, top-k lists, counts and detail views over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def between(rows: DataFrame, column: str, start=None, end=None) -> DataFrame:
    if start is not None:
        rows = rows.where(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col(column) <= F.lit(end).cast("date"))
    return rows


def list_filings(
    filings: DataFrame, ticker: str | None = None, form_type: str | None = None, start=None, end=None,
    limit: int | None = None
) -> DataFrame:
    rows = between(filings, "filed_date", start, end)
    if ticker:
        rows = rows.where(F.upper("ticker") == ticker.upper())
    if form_type:
        rows = rows.where(F.col("form_type") == form_type)
    rows = rows.orderBy(F.desc("filed_date"), "filing_id")
    return rows.limit(limit) if limit else rows


def get_signals(signals: DataFrame, ticker: str, start=None, end=None, name: str | None = None) -> DataFrame:
    rows = between(signals, "signal_date", start, end).where(F.col("ticker") == ticker)
    return (rows.where(F.col("signal_name") == name) if name else rows).orderBy("signal_date")


def get_composites(composites: DataFrame, ticker: str | None = None, start=None, end=None) -> DataFrame:
    rows = between(composites, "signal_date", start, end)
    return (rows.where(F.col("ticker") == ticker) if ticker else rows).orderBy("signal_date")


def signal_screen(
    composites: DataFrame, low: float | None = None, high: float | None = None, sort: str = "composite_score",
    descending: bool = True, offset: int = 0, limit: int = 50, **dates
) -> DataFrame:
    """A page of composites in a score range, with the count of all that fit."""
    rows = get_composites(composites, **dates)
    rows = rows if low is None else rows.where(F.col("composite_score") >= low)
    rows = rows if high is None else rows.where(F.col("composite_score") <= high)
    total = rows.agg(F.count("*").alias("total"))
    order = F.desc(sort) if descending else F.asc(sort)
    page = rows.orderBy(order, "ticker", "signal_date").offset(offset).limit(limit)
    return page.join(F.broadcast(total))  # one row


def get_bars(prices: DataFrame, ticker: str, start=None, end=None) -> DataFrame:
    return between(prices, "date", start, end).where(F.col("ticker") == ticker).orderBy("date")


def get_sentiments(results: DataFrame, filing_id: str, section: str | None = None, analyzer: str | None = None) -> DataFrame:
    rows = results.where(F.col("filing_id") == filing_id)
    rows = rows.where(F.col("section_name") == section) if section else rows
    return rows.where(F.col("analyzer_name") == analyzer) if analyzer else rows


def top_k(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)


def latest_filing(filings: DataFrame) -> DataFrame:
    """The last filing of each (cik, form_type)."""
    last = F.max_by(F.struct("filing_id", "filed_date"), F.struct("filed_date", "filing_id"))
    return filings.groupBy("cik", "form_type").agg(last.alias("l")).select("cik", "form_type", "l.*")


def latest_signals_per_ticker(composites: DataFrame, k: int = 10) -> DataFrame:
    return top_k(composites, ["ticker"], [F.desc("signal_date")], k)


def section_names(sections: DataFrame) -> DataFrame:
    return sections.groupBy("filing_id").agg(F.array_sort(F.collect_set("section_name")).alias("sections"))


def analysis_status(filings: DataFrame, sentiment: DataFrame, similarity: DataFrame) -> DataFrame:
    """Per filing whether each analyzer has results."""
    kinds = sentiment.select("filing_id", F.col("analyzer_name").alias("kind")).unionByName(
        similarity.select("filing_id", F.lit("similarity").alias("kind"))
    )
    has = lambda k: F.max(F.coalesce(F.col("kind") == k, F.lit(False))).alias(f"has_{k}")
    return filings.select("filing_id").join(kinds, "filing_id", "left").groupBy("filing_id").agg(
        has("dictionary"), has("similarity"), has("llm")
    )


def latest_filings_per_ticker(filings: DataFrame, sections: DataFrame, status: DataFrame, k: int = 20) -> DataFrame:
    top = top_k(filings.where("ticker is not null"), ["ticker"], [F.desc("filed_date"), "filing_id"], k)
    return top.join(section_names(sections), "filing_id", "left").join(status, "filing_id", "left")


def filing_detail(filings: DataFrame, sections: DataFrame, sentiment: DataFrame, similarity: DataFrame) -> DataFrame:
    """Filings with maps of their sections' word counts and lists of their results."""
    s = sections.groupBy("filing_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("section_name", "word_count")))).alias("sections")
    )
    a = sentiment.groupBy("filing_id").agg(
        F.array_sort(F.collect_list(F.struct("section_name", "analyzer_name", "sentiment_score"))).alias("sentiment")
    )
    b = similarity.groupBy("filing_id").agg(
        F.array_sort(F.collect_list(F.struct("section_name", "similarity_score", "change_score"))).alias("similarity")
    )
    return filings.join(s, "filing_id", "left").join(a, "filing_id", "left").join(b, "filing_id", "left")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def coverage_status(filings: DataFrame, composites: DataFrame) -> DataFrame:
    a = filings.agg(
        F.count("*").alias("filings"), F.countDistinct("ticker").alias("tickers"),
        F.min("filed_date").alias("first_filed"), F.max("filed_date").alias("last_filed")
    )
    b = composites.agg(F.count("*").alias("composites"), F.max("signal_date").alias("last_signal"))
    return a.join(F.broadcast(b))  # one row each


def distinct_tickers(rows: DataFrame) -> DataFrame:
    return rows.select("ticker").where("ticker is not null").distinct().orderBy("ticker")


def common_sections(a: DataFrame, b: DataFrame) -> DataFrame:
    """Section names that both filings have."""
    return a.select("section_name").intersect(b.select("section_name"))


def universe_superset(static: DataFrame, members: DataFrame) -> DataFrame:
    return static.select("ticker").union(members.select("ticker")).distinct()
