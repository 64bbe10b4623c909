"""Rebalance dates, quantile portfolios, turnover, period returns and equity curves.

Everything is keyed by ``rebalance_date``, and by ``strategy_id`` too where positions have that column, so that a
sweep of strategies (``sweep_positions``) runs through the same functions as one job. Windows that follow time
run over one row per strategy and period or day, never over positions or prices. Tables of dates and periods
are joined without hints: Spark broadcasts what it measures to be small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filingmill.sources.store import stored

from . import metrics
from .calendars import Dates
from .ranks import ordered, percentiles
from .returns import compound, date_to_period, period_returns_by_ticker

START_VALUE = 10_000.0
KEY = "strategy_id"


@dataclass(frozen=True)
class Strategy:
    """One parameter set of a sweep."""

    strategy_id: str
    quantiles: int = 5
    long_quantile: int = 1
    short_quantile: int | None = None
    cost_bps: float = 10.0


def _keys(rows: DataFrame) -> list[str]:
    return [KEY] if KEY in rows.columns else []


def check_params(
    start, end, universe: list, quantiles: int, long_quantile: int, short_quantile: int | None, half_life: int = 90,
    weighting: str = "equal", weights: dict | None = None
) -> None:
    """Raises ValueError for parameters that no job can run with."""
    if not start < end:
        raise ValueError("start must be before end")
    if not universe:
        raise ValueError("the universe is empty")
    for q in (long_quantile, short_quantile):
        if q is not None and not 1 <= q <= quantiles:
            raise ValueError(f"quantile {q} is not in 1..{quantiles}")
    if half_life < 1:
        raise ValueError("half_life must be at least 1")
    if weighting == "custom" and not weights:
        raise ValueError("custom weights are empty")


def rebalance_dates(spark: SparkSession, start: str, end: str, frequency: str = "quarterly") -> DataFrame:
    """Last weekdays of months, or of quarters' last months, inside [start, end]."""
    a, z = F.lit(start).cast("date"), F.lit(end).cast("date")
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(a, "month"), F.trunc(z, "month"), F.expr("interval 1 month"))).alias("m"))
    last = F.last_day("m")
    back = F.when(F.dayofweek(last) == 1, 2).when(F.dayofweek(last) == 7, 1).otherwise(0)
    days = months.select(F.date_sub(last, back).alias("rebalance_date")).where(F.col("rebalance_date").between(a, z))
    return days.where(F.month("rebalance_date") % 3 == 0) if frequency == "quarterly" else days


def holding_periods(days: DataFrame, end: str) -> DataFrame:
    """(period_start, period_end) of scheduled dates, before any is skipped; the last ends with the test."""
    after = F.lead("rebalance_date", 1).over(W.orderBy("rebalance_date"))  # parameter rows only
    return days.select(F.col("rebalance_date").alias("period_start"), F.coalesce(after, F.lit(end).cast("date")).alias("period_end"))


def universe_on_date(days: DataFrame, universe: DataFrame) -> DataFrame:
    """(rebalance_date, ticker) of members, interval ends inclusive; an end of null is open."""
    known = Dates.of(days, "rebalance_date")
    placed = known.first_from(universe, F.col("start_date"), "first")
    beyond = F.lit(known.high).cast("date")
    placed = known.first_from(placed, F.date_add(F.least(F.coalesce("end_date", beyond), beyond), 1), "after")
    inside = known.expanded(placed.select("ticker", "first", "after"), F.col("first"), F.col("after") - 1)
    return known.named(inside.select("ticker", "place").distinct(), "place", "rebalance_date").select("rebalance_date", "ticker")


def latest_signal_as_of(days: DataFrame, composites: DataFrame) -> DataFrame:
    """Per (rebalance_date, ticker) the composite of the greatest signal_date on or before it.

    A composite first counts for one date; of a ticker's composites that first count for the same date the last is kept, and
    holds until the date at which the ticker's next one counts. So rows are reduced before they are put to dates, and the
    window has one row per ticker and date."""
    known = Dates.of(days, "rebalance_date")
    placed = known.first_from(composites, F.col("signal_date"), "from").where(F.col("from") <= known.n)
    last = placed.groupBy("ticker", "from").agg(F.max(F.struct("signal_date", "composite_score")).alias("c"))
    until = F.coalesce(F.lead("from").over(W.partitionBy("ticker").orderBy("from")), F.lit(known.n + 1))
    held = known.expanded(last.withColumn("until", until), F.col("from"), F.col("until") - 1)
    return known.named(held, "place", "rebalance_date").select("rebalance_date", "ticker", "c.signal_date", "c.composite_score")


def filter_to_universe(signals: DataFrame, members: DataFrame) -> DataFrame:
    return signals.join(members, ["rebalance_date", "ticker"], "left_semi")


def quantile_buckets(scores: DataFrame, quantiles: int = 5, pandas_edges: bool = False) -> DataFrame:
    """Adds ``quantile``, 1 for the highest scores; dates with fewer tickers than quantiles, or with equal edges, are left out.

    ``pandas_edges`` takes the edge positions as that library computes them, with its float noise."""
    steps = [k / quantiles * 100 / 100 if pandas_edges else k / quantiles for k in range(quantiles + 1)]
    lines = ordered(scores, "scores", F.asc("rebalance_date"), F.asc("composite_score"), F.asc("ticker"))
    edges = percentiles(lines.where("composite_score is not null"), "composite_score", steps, "rebalance_date")
    fit = edges.where((F.col("n") >= quantiles) & (F.size(F.array_distinct("edges")) == quantiles + 1)).drop("n")
    below = F.size(F.filter("edges", lambda e: e < F.col("composite_score")))
    cut = lines.drop("part", "at").join(fit, "rebalance_date")
    return cut.withColumn("quantile", quantiles - F.greatest(below, F.lit(1)) + 1).drop("edges")


def _legs(strategies: list[Strategy]) -> list[tuple[str, int, float]]:
    return [
        (s.strategy_id, q, sign) for s in strategies for q, sign in ((s.long_quantile, 1.0), (s.short_quantile, -1.0))
        if q is not None and (sign > 0 or q != s.long_quantile)
    ]


def sweep_positions(scores: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """Positions (strategy_id, rebalance_date, ticker, weight, quantile, signal_score) of all strategies.

    Scores are cut into buckets once per number of quantiles; a bucket is then put to the strategies that hold it."""
    if len({s.strategy_id for s in strategies}) < len(strategies) or not strategies:
        raise ValueError("strategies need different names")
    found = None
    for n in sorted({s.quantiles for s in strategies}):
        legs = scores.sparkSession.createDataFrame(
            _legs([s for s in strategies if s.quantiles == n]), f"{KEY} string, quantile int, sign double"
        )
        size = F.count("*").over(W.partitionBy("rebalance_date", "quantile"))
        held = quantile_buckets(scores, n).withColumn("size", size).join(legs, "quantile")
        held = held.select(
            KEY, "rebalance_date", "ticker", (F.col("sign") / F.col("size")).alias("weight"), "quantile",
            F.col("composite_score").alias("signal_score")
        )
        found = held if found is None else found.unionByName(held)
    return found


def leg_weights(buckets: DataFrame, long_quantile: int = 1, short_quantile: int | None = None) -> DataFrame:
    """Positions (rebalance_date, ticker, weight, quantile, signal_score) of the held buckets."""
    held = buckets.where(F.col("quantile").isin(*[q for q in (long_quantile, short_quantile) if q is not None]))
    n = F.count("*").over(W.partitionBy("rebalance_date", "quantile"))
    sign = F.when(F.col("quantile") == long_quantile, 1.0).otherwise(-1.0)
    return held.select("rebalance_date", "ticker", (sign / n).alias("weight"), "quantile", F.col("composite_score").alias("signal_score"))


def prev_snapshot(positions: DataFrame) -> DataFrame:
    """([strategy_id,] k, rebalance_date, ticker, weight, before): weights beside those of the previous built snapshot."""
    key = _keys(positions)
    built = positions.select(*key, "rebalance_date").distinct()
    k = built.withColumn("k", F.row_number().over(W.partitionBy(*key).orderBy("rebalance_date")))  # one row per date
    now = positions.join(k, [*key, "rebalance_date"]).select(*key, "k", "ticker", "weight")
    last = now.select(*key, (F.col("k") + 1).alias("k"), "ticker", F.col("weight").alias("before"))
    both = now.join(last, [*key, "k", "ticker"], "full").na.fill(0.0, ["weight", "before"])
    return both.join(k, [*key, "k"])


def turnover(positions: DataFrame, cost_bps: float | dict[str, float] = 10.0) -> DataFrame:
    """([strategy_id,] rebalance_date, turnover, cost): half the absolute change of target weights; 1 at first.

    ``cost_bps`` is one number, or one per strategy."""
    key = _keys(positions)
    t = prev_snapshot(positions).groupBy(*key, "k", "rebalance_date").agg((F.sum(F.abs(F.col("weight") - F.col("before"))) / 2).alias("t"))
    t = t.select(*key, "rebalance_date", F.when(F.col("k") == 1, 1.0).otherwise(F.col("t")).alias("turnover"))
    if not isinstance(cost_bps, dict):
        return t.withColumn("cost", F.col("turnover") * cost_bps / 10_000)
    bps = positions.sparkSession.createDataFrame([(k, float(v)) for k, v in cost_bps.items()], f"{KEY} string, bps double")
    return t.join(bps, KEY).withColumn("cost", F.col("turnover") * F.col("bps") / 10_000).drop("bps")


def positions_with_returns(positions: DataFrame, returns: DataFrame, periods: DataFrame) -> DataFrame:
    """Positions with their return over the holding period; a ticker without data earns 0."""
    held = period_returns_by_ticker(returns, periods).select(F.col("period_start").alias("rebalance_date"), "ticker", "ret")
    dated = positions.join(periods.withColumnRenamed("period_start", "rebalance_date"), "rebalance_date")
    return dated.join(held, ["rebalance_date", "ticker"], "left").na.fill(0.0, ["ret"])


def portfolio_returns(placed: DataFrame, costs: DataFrame) -> DataFrame:
    """Per period gross, net and leg returns; long_short is the net return where a short leg is held."""
    key = _keys(placed)
    w, r = F.col("weight"), F.col("ret")
    legs = placed.groupBy(*key, F.col("rebalance_date").alias("period_start"), "period_end").agg(
        F.sum(w * r).alias("gross"), F.sum(F.when(w > 0, w * r).otherwise(0.0)).alias("long_return"),
        F.sum(F.when(w < 0, -w * r).otherwise(0.0)).alias("short_leg"), F.max(w < 0).alias("short"),
    )
    net = legs.join(
        costs.withColumnRenamed("rebalance_date", "period_start"), [*key, "period_start"]
    ).withColumn("net", F.col("gross") - F.col("cost"))
    return net.select(
        *key, "period_start", "period_end", "gross", "net", "turnover", "cost", "long_return",
        F.when(F.col("short"), F.col("short_leg")).alias("short_return"),
        F.when(F.col("short"), F.col("net")).alias("long_short_return"),
    )


def benchmark_equal_weight(returns: DataFrame) -> DataFrame:
    """Daily mean over the universe's known returns."""
    return returns.groupBy("date").agg(F.avg("ret").alias("ew"))


def equity_curve(
    positions: DataFrame, periods: DataFrame, returns: DataFrame, market: DataFrame, start_value: float = START_VALUE
) -> DataFrame:
    """Daily values: portfolio at target weights without cost, equal-weight universe, market (date, ret).

    On a day without market data ``spy_value`` is null; its product goes on at the next."""
    key = _keys(positions)
    built = positions.select(*key, F.col("rebalance_date").alias("period_start")).distinct()
    days = date_to_period(returns, periods).join(built, "period_start")
    dated = returns.join(date_to_period(returns, periods), "date").withColumnRenamed("period_start", "rebalance_date")
    own = dated.join(positions.select(*key, "rebalance_date", "ticker", "weight"), ["rebalance_date", "ticker"])
    own = own.groupBy(*key, "date").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("own"))
    shared = days.select(*key, "date").join(own, [*key, "date"], "left").join(benchmark_equal_weight(returns), "date", "left")
    daily = shared.join(market.select("date", F.col("ret").alias("spy")), "date", "left")
    w = W.partitionBy(*key).orderBy("date").rowsBetween(W.unboundedPreceding, 0)  # one row per day
    value = lambda c: F.round(start_value * F.product(1 + F.coalesce(F.col(c), F.lit(0.0))).over(w), 4)
    return daily.select(
        *key, "date", value("own").alias("portfolio_value"),
        F.when(F.col("spy").isNotNull(), value("spy")).alias("spy_value"), value("ew").alias("ew_value")
    )


def total_and_annualized(periods: DataFrame, per_year: int = 4) -> DataFrame:
    """total and annualized return of the net returns; none gives 0."""
    key = _keys(periods)
    a = periods.groupBy(*key).agg(compound(F.col("net")).alias("total_return"), F.count("*").alias("n"))
    return a.select(
        *key, "total_return",
        F.when(F.col("n") == 0, 0.0).otherwise(
            F.pow(1 + F.col("total_return"), F.lit(float(per_year)) / F.col("n")) - 1
        ).alias("annualized_return"),
        "n"
    )


def portfolio_history(period_rows: DataFrame, positions: DataFrame, start_value: float = START_VALUE, digits: int = 4) -> DataFrame:
    """Per snapshot the value before it (to ``digits``), turnover, cost and counts of legs."""
    key = _keys(period_rows)
    w = W.partitionBy(*key).orderBy("period_start").rowsBetween(W.unboundedPreceding, -1)  # one row per period
    value = F.round(start_value * F.coalesce(F.product(1 + F.col("net")).over(w), F.lit(1.0)), digits)
    legs = positions.groupBy(*key, F.col("rebalance_date").alias("period_start")).agg(
        F.count_if(F.col("weight") > 0).alias("n_long"), F.count_if(F.col("weight") < 0).alias("n_short")
    )
    return period_rows.select(*key, "period_start", value.alias("value_before"), "turnover", "cost").join(legs, [*key, "period_start"])


def position_values(history: DataFrame, positions: DataFrame, digits: int = 2) -> DataFrame:
    """Positions with leg and dollar_value, the snapshot's value before it times the absolute weight, rounded once to ``digits``."""
    key = _keys(positions)
    values = history.select(*key, F.col("period_start").alias("rebalance_date"), "value_before")
    leg = F.when(F.col("weight") >= 0, "long").otherwise("short")
    valued = positions.join(values, [*key, "rebalance_date"]).withColumns(
        {"leg": leg, "dollar_value": F.round(F.col("value_before") * F.abs("weight"), digits)}
    )
    return valued.drop("value_before")


def _evaluated(
    positions: DataFrame, periods: DataFrame, composites, returns, market, per_year: int, cost_bps, factors
) -> dict[str, DataFrame]:
    """Everything that follows from stored positions."""
    if positions.isEmpty():
        raise ValueError("no rebalance date gave a portfolio")
    key = _keys(positions)
    rows = stored(portfolio_returns(positions_with_returns(positions, returns, periods), turnover(positions, cost_bps)), "period_returns")
    series = rows.select(
        *([KEY] if key else [F.lit("portfolio").alias(KEY)]), F.col("period_end").alias("date"),
        F.col("net").alias("ret"), "turnover", "cost"
    )
    ics = metrics.ic_summary(metrics.information_coefficients(composites, returns))
    costs = series.groupBy(KEY).agg(F.avg("turnover").alias("average_turnover"), F.sum("cost").alias("total_cost"))
    numbers = metrics.compute_all(series.drop("turnover", "cost"), per_year, ics=ics, factors=factors).join(costs, KEY)
    annual = F.pow(1 + F.col("total_return"), F.lit(float(per_year)) / F.col("n")) - 1
    history = portfolio_history(rows, positions)
    return {
        "positions": positions, "period_returns": rows,
        "equity_curve": equity_curve(positions, periods, returns, market), "history": history,
        "position_values": position_values(history, positions), "metrics": numbers.withColumn("annualized_return", annual),
    }


def run_backtest(
    composites: DataFrame, universe: DataFrame, returns: DataFrame, market: DataFrame, start: str, end: str,
    frequency: str = "quarterly", quantiles: int = 5, long_quantile: int = 1, short_quantile: int | None = None,
    cost_bps: float = 10.0, factors: DataFrame | None = None
) -> dict[str, DataFrame]:
    """positions, period_returns, equity_curve, history, position_values and metrics of one strategy; ValueError if no date gives a portfolio."""
    days = rebalance_dates(composites.sparkSession, start, end, frequency)
    known = filter_to_universe(latest_signal_as_of(days, composites), universe_on_date(days, universe))
    positions = stored(leg_weights(quantile_buckets(known, quantiles), long_quantile, short_quantile), "positions")
    return _evaluated(
        positions, holding_periods(days, end), composites, returns, market, 4 if frequency == "quarterly" else 12,
        cost_bps, factors
    )


def run_sweep(
    composites: DataFrame, universe: DataFrame, returns: DataFrame, market: DataFrame, start: str, end: str,
    strategies: list[Strategy], frequency: str = "quarterly", factors: DataFrame | None = None
) -> dict[str, DataFrame]:
    """What ``run_backtest`` gives, of all strategies in one job, keyed by ``strategy_id``."""
    days = rebalance_dates(composites.sparkSession, start, end, frequency)
    known = stored(filter_to_universe(latest_signal_as_of(days, composites), universe_on_date(days, universe)), "known")
    positions = stored(sweep_positions(known, strategies), "positions")
    costs = {s.strategy_id: s.cost_bps for s in strategies}
    return _evaluated(
        positions, holding_periods(days, end), composites, returns, market, 4 if frequency == "quarterly" else 12,
        costs, factors
    )
