"""Returns, portfolios, backtests and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingmill.operators import metrics, portfolio, returns, signals
from filingmill.sources.store import stored

from . import standin as S
from .registry import query
from .standin import END, START, rounded, with_

_DAILY = f"""daily_all AS (SELECT ticker, date, price / lag(price) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM prices),
daily AS (SELECT * FROM daily_all WHERE date BETWEEN DATE '{START}' AND DATE '{END}')"""
_MONTHS = """months AS (SELECT ticker, last_day(date) AS date, arg_max(price, date) AS price FROM prices
  WHERE price IS NOT NULL GROUP BY ALL),
grid AS (SELECT ticker, CAST(last_day(unnest(generate_series(date_trunc('month', a), date_trunc('month', z),
  INTERVAL 1 MONTH))) AS DATE) AS date FROM (SELECT ticker, min(date) AS a, max(date) AS z FROM months GROUP BY ALL)),
filled AS (SELECT ticker, date, last_value(price IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price FROM grid LEFT JOIN months USING (ticker, date)),
monthly AS (SELECT ticker, date, price / lag(price) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM filled)"""
_REBALANCE = f"""days AS (SELECT * FROM (SELECT CAST(l - CASE dayofweek(l) WHEN 0 THEN 2 WHEN 6 THEN 1 ELSE 0 END AS DATE) AS rebalance_date
  FROM (SELECT last_day(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 MONTH))) AS l))
  WHERE rebalance_date BETWEEN DATE '{START}' AND DATE '{END}' AND month(rebalance_date) % 3 = 0),
periods AS (SELECT rebalance_date AS period_start, coalesce(lead(rebalance_date) OVER (ORDER BY rebalance_date),
  DATE '{END}') AS period_end FROM days)"""
_MEMBERS = (
    "members AS (SELECT DISTINCT rebalance_date, ticker FROM days JOIN universe ON start_date <= rebalance_date "
    "AND (end_date IS NULL OR end_date >= rebalance_date))"
)
_LATEST = """latest AS (SELECT rebalance_date, ticker, max(signal_date) AS signal_date, arg_max(composite_score,
  signal_date) AS composite_score
  FROM days JOIN scores ON signal_date <= rebalance_date GROUP BY ALL)"""
_BUCKETS = """known AS (SELECT * FROM latest SEMI JOIN members USING (rebalance_date, ticker)),
edges AS (SELECT rebalance_date, quantile_cont(composite_score, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e, count(*) AS n FROM known GROUP BY ALL),
buckets AS (SELECT k.*, 5 - greatest(len(list_filter(e, lambda x: x < composite_score)), 1) + 1 AS quantile FROM known k
  JOIN edges USING (rebalance_date) WHERE n >= 5 AND len(list_distinct(e)) = 6)"""
_LEGS = """positions AS (SELECT rebalance_date, ticker, CASE WHEN quantile = 1 THEN 1.0 ELSE -1.0 END / count(*)
  OVER (PARTITION BY rebalance_date, quantile) AS weight, quantile, composite_score AS signal_score
  FROM buckets WHERE quantile IN (1, 5))"""
_TURNOVER = """built_days AS (SELECT rebalance_date, row_number() OVER (ORDER BY rebalance_date) AS k
  FROM (SELECT DISTINCT rebalance_date FROM positions)),
pk AS (SELECT k, ticker, weight FROM positions JOIN built_days USING (rebalance_date)),
snaps AS (SELECT k, ticker, coalesce(a.weight, 0) AS weight, coalesce(b.weight, 0) AS before FROM pk a FULL
  JOIN (SELECT k + 1 AS k, ticker, weight FROM pk) b USING (k, ticker)),
turn AS (SELECT rebalance_date, CASE WHEN k = 1 THEN 1.0 ELSE sum(abs(weight - before)) / 2 END AS turnover FROM snaps
  JOIN built_days USING (k) GROUP BY k, rebalance_date)"""
_PLACED = """held AS (SELECT ticker, period_start, period_end, product(1 + ret) - 1 AS ret FROM monthly
  JOIN periods ON date > period_start AND date <= period_end WHERE ret IS NOT NULL GROUP BY ALL),
placed AS (SELECT p.*, q.period_end, coalesce(h.ret, 0) AS ret FROM positions p
  JOIN periods q ON q.period_start = p.rebalance_date LEFT JOIN held h ON h.ticker = p.ticker
  AND h.period_start = p.rebalance_date),
rows AS (SELECT rebalance_date AS period_start, period_end, sum(weight * ret) AS gross, sum(CASE WHEN weight > 0
  THEN weight * ret ELSE 0 END) AS long_return, sum(CASE WHEN weight < 0 THEN -weight * ret ELSE 0 END) AS short_return
  FROM placed GROUP BY ALL),
net AS (SELECT period_start, period_end, gross, gross - turnover * 10 / 10000 AS net, turnover,
  turnover * 10 / 10000 AS cost, long_return, short_return FROM rows JOIN turn ON rebalance_date = period_start)"""
_TO_DAYS = [S.UNIVERSE, S.SCORES, _REBALANCE]
_TO_LEGS = [*_TO_DAYS, _MEMBERS, _LATEST, _BUCKETS, _LEGS]
_TO_NET = [S.PRICES, _MONTHS, *_TO_LEGS, _TURNOVER, _PLACED]


def days(spark):
    return portfolio.rebalance_dates(spark, START, END)


def periods(spark):
    return portfolio.holding_periods(days(spark), END)


def latest(spark, d):
    known = portfolio.latest_signal_as_of(days(spark), S.scores(spark, d))
    return portfolio.filter_to_universe(known, portfolio.universe_on_date(days(spark), S.universe(spark, d)))


def positions(spark, d):
    return portfolio.leg_weights(portfolio.quantile_buckets(latest(spark, d)), 1, 5)


def net(spark, d):
    held = positions(spark, d)
    placed = portfolio.positions_with_returns(held, returns.monthly_returns(S.prices(spark, d)), periods(spark))
    return portfolio.portfolio_returns(placed, portfolio.turnover(held))


def daily(spark, d):
    return returns.daily_returns(S.prices(spark, d), START, END)


def monthly(spark, d):
    return returns.monthly_returns(S.prices(spark, d))


@query("daily_returns", with_(S.PRICES, _DAILY) + "SELECT ticker, date, round(ret, 4) + 0.0 AS ret FROM daily")
def _(spark, d):
    return rounded(daily(spark, d))


@query("price_gaps", with_(S.PRICES, _MONTHS) + "SELECT ticker, date, round(price, 8) AS price FROM filled")
def _(spark, d):
    return rounded(returns.price_gaps(S.prices(spark, d)), 8)


@query("monthly_returns", with_(S.PRICES, _MONTHS) + "SELECT ticker, date, round(ret, 4) + 0.0 AS ret FROM monthly")
def _(spark, d):
    return rounded(monthly(spark, d))


@query(
    "compound_to_monthly",
    with_(S.PRICES, _DAILY)
    + "SELECT ticker, last_day(date) AS date, round(coalesce(product(1 + ret), 1) - 1, 4) + 0.0 AS ret FROM daily "
      "GROUP BY ALL"
)
def _(spark, d):
    return rounded(returns.compound_to_monthly(daily(spark, d)))


@query(
    "period_returns_by_ticker",
    with_(S.PRICES, _MONTHS, *_TO_LEGS, _PLACED.partition(",\nplaced")[0])
    + "SELECT ticker, period_start, period_end, round(ret, 4) + 0.0 AS ret FROM held"
)
def _(spark, d):
    good = monthly(spark, d).where("ret is not null")
    return rounded(returns.period_returns_by_ticker(good, periods(spark)))


@query(
    "price_coverage",
    with_(S.PRICES)
    + f"SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS n_days, "
      f"max(date) >= DATE '{END}' AS complete, bool_or(date BETWEEN DATE '{START}' AND DATE '{END}') AS has_data "
      f"FROM prices GROUP BY ticker"
)
def _(spark, d):
    return returns.price_coverage(S.prices(spark, d), START, END)


@query(
    "rebalance_dates",
    with_(_REBALANCE)
    + "SELECT rebalance_date, count(l_orderkey) AS lines_until FROM days LEFT "
      "JOIN lineitem ON l_shipdate <= rebalance_date GROUP BY ALL"
)
def _(spark, d):
    by_day = S.read(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n"))
    return by_day.join(
        F.broadcast(days(spark)), F.col("day") <= F.col("rebalance_date"), "right"
    ).groupBy("rebalance_date").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines_until"))


@query(
    "holding_periods",
    with_(_REBALANCE, S.PRICES)
    + "SELECT period_start, period_end, count(date) AS n_prices FROM periods LEFT "
      "JOIN prices ON date > period_start AND date <= period_end GROUP BY ALL"
)
def _(spark, d):
    by_day = S.prices(spark, d).groupBy("date").agg(F.count("*").alias("n"))
    dated = returns.date_to_period(by_day, periods(spark)).join(by_day, "date").groupBy("period_start").agg(F.sum("n").alias("n"))
    return periods(spark).join(dated, "period_start", "left").select(
        "period_start", "period_end", F.coalesce("n", F.lit(0)).alias("n_prices")
    )


@query(
    "date_to_period",
    with_(_REBALANCE, S.PRICES)
    + "SELECT date, period_start, period_end FROM (SELECT DISTINCT date FROM prices) "
      "JOIN periods ON date > period_start AND date <= period_end"
)
def _(spark, d):
    return returns.date_to_period(S.prices(spark, d), periods(spark)).select("date", "period_start", "period_end")


@query("universe_on_date", with_(*_TO_DAYS, _MEMBERS) + "SELECT rebalance_date, ticker FROM members")
def _(spark, d):
    return portfolio.universe_on_date(days(spark), S.universe(spark, d))


@query(
    "latest_signal_as_of",
    with_(*_TO_DAYS, _LATEST)
    + "SELECT rebalance_date, ticker, signal_date, round(composite_score, 6) + 0.0 AS composite_score FROM latest"
)
def _(spark, d):
    return rounded(portfolio.latest_signal_as_of(days(spark), S.scores(spark, d)), 6)


@query(
    "filter_to_universe",
    with_(*_TO_DAYS, _MEMBERS, _LATEST)
    + "SELECT rebalance_date, ticker, signal_date, round(composite_score, 6) + 0.0 AS composite_score FROM latest "
      "SEMI JOIN members USING (rebalance_date, ticker)"
)
def _(spark, d):
    return rounded(latest(spark, d), 6)


@query("quantile_buckets", with_(*_TO_LEGS) + "SELECT rebalance_date, ticker, CAST(quantile AS INTEGER) AS quantile FROM buckets")
def _(spark, d):
    return portfolio.quantile_buckets(latest(spark, d)).select("rebalance_date", "ticker", "quantile")


@query(
    "leg_weights",
    with_(*_TO_LEGS)
    + "SELECT rebalance_date, ticker, round(weight, 6) AS weight, CAST(quantile AS INTEGER) AS quantile, "
      "round(signal_score, 6) + 0.0 AS signal_score FROM positions"
)
def _(spark, d):
    return rounded(positions(spark, d), 6)


@query(
    "prev_snapshot",
    with_(*_TO_LEGS, _TURNOVER)
    + "SELECT CAST(k AS INTEGER) AS k, ticker, round(weight, 6) AS weight, round(before, 6) AS before FROM snaps "
      "JOIN built_days USING (k)"
)
def _(spark, d):
    return rounded(portfolio.prev_snapshot(positions(spark, d)).select("k", "ticker", "weight", "before"), 6)


@query("turnover", with_(*_TO_LEGS, _TURNOVER) + "SELECT rebalance_date, round(turnover, 6) AS turnover FROM turn")
def _(spark, d):
    return rounded(portfolio.turnover(positions(spark, d)).drop("cost"), 6)


@query("transaction_cost", with_(*_TO_LEGS, _TURNOVER) + "SELECT rebalance_date, round(turnover * 10 / 10000, 8) AS cost FROM turn")
def _(spark, d):
    return rounded(portfolio.turnover(positions(spark, d)).drop("turnover"), 8)


@query(
    "positions_with_returns",
    with_(*_TO_NET)
    + "SELECT rebalance_date, ticker, period_end, round(weight, 6) AS weight, round(ret, 4) + 0.0 AS ret FROM placed"
)
def _(spark, d):
    placed = portfolio.positions_with_returns(positions(spark, d), monthly(spark, d), periods(spark))
    return placed.select(
        "rebalance_date", "ticker", "period_end", F.round("weight", 6).alias("weight"),
        (F.round("ret", 4) + 0.0).alias("ret")
    )


@query(
    "portfolio_returns",
    with_(*_TO_NET)
    + "SELECT period_start, period_end, round(gross, 4) + 0.0 AS gross, round(net, 4) + 0.0 AS net, round(turnover, "
      "6) AS turnover, round(cost, 8) AS cost, round(long_return, 4) + 0.0 AS long_return, round(short_return, "
      "4) + 0.0 AS short_return, round(net, 4) + 0.0 AS long_short_return FROM net"
)
def _(spark, d):
    return net(spark, d).withColumns(
        {
            c: F.round(c, n) + 0.0
            for c,
            n in (
                ("gross", 4), ("net", 4), ("turnover", 6), ("cost", 8), ("long_return", 4), ("short_return", 4),
                ("long_short_return", 4)
            )
        }
    )


@query(
    "total_and_annualized",
    with_(*_TO_NET)
    + "SELECT round(product(1 + net) - 1, 4) + 0.0 AS total_return, round(pow(product(1 + net), 4 / count(*)) - 1, "
      "4) + 0.0 AS annualized_return, count(*) AS n FROM net"
)
def _(spark, d):
    return rounded(portfolio.total_and_annualized(net(spark, d)))


@query("portfolio_history", with_(*_TO_NET) + """SELECT n.period_start, round(10000 * coalesce(product(1 + net)
  OVER (ORDER BY n.period_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1), 1) AS value_before,
  round(turnover, 6) AS turnover, round(cost, 8) AS cost, n_long, n_short FROM net n
  JOIN (SELECT rebalance_date AS period_start, count(*) FILTER (weight > 0) AS n_long, count(*)
  FILTER (weight < 0) AS n_short FROM positions GROUP BY ALL) USING (period_start)""")
def _(spark, d):
    h = portfolio.portfolio_history(net(spark, d), positions(spark, d), digits=1)
    return h.withColumns({"turnover": F.round("turnover", 6), "cost": F.round("cost", 8)})


@query(
    "signal_history",
    with_(S.SCORES)
    + "SELECT signal_date, ticker, round(composite_score, 6) + 0.0 AS composite_score, "
      "CAST(row_number() OVER (PARTITION BY signal_date ORDER BY composite_score DESC, ticker) AS INTEGER) AS rank "
      "FROM scores"
)
def _(spark, d):
    ranked = signals.composite_rank(S.scores(spark, d).select("signal_date", "ticker", "composite_score"))
    return rounded(ranked.select("signal_date", "ticker", "composite_score", "rank"), 6)


_CURVE = """curve_days AS (SELECT date, period_start FROM (SELECT DISTINCT date FROM daily)
  JOIN periods ON date > period_start AND date <= period_end WHERE period_start IN (SELECT rebalance_date
  FROM positions)),
own AS (SELECT date, sum(weight * coalesce(ret, 0)) AS own FROM daily JOIN curve_days USING (date)
  JOIN positions p ON p.rebalance_date = period_start AND p.ticker = daily.ticker GROUP BY ALL),
ew AS (SELECT date, avg(ret) AS ew FROM daily GROUP BY ALL), line AS (SELECT date, coalesce(own, 0) AS own, coalesce(ew,
  0) AS ew FROM curve_days LEFT JOIN own USING (date) LEFT JOIN ew USING (date))"""


@query("benchmark_equal_weight", with_(S.PRICES, _DAILY) + "SELECT date, round(avg(ret), 4) + 0.0 AS ew FROM daily GROUP BY ALL")
def _(spark, d):
    return rounded(portfolio.benchmark_equal_weight(daily(spark, d)))


_MARKET = "market AS (SELECT date, avg(ret) * 0.1 AS spy FROM daily WHERE dayofmonth(date) % 7 <> 3 GROUP BY ALL)"


def market(daily_rows):
    """A tenth of the universe's mean, without data on some days."""
    mean = portfolio.benchmark_equal_weight(daily_rows)
    return mean.where(F.dayofmonth("date") % 7 != 3).select("date", (F.col("ew") * 0.1).alias("ret"))


def _digits(c, n=6):
    """A number to n significant digits, which is what sums in another order leave alike."""
    return F.when(F.abs(c) == float("inf"), None).when(c == 0, 0.0).otherwise(
        F.round(c / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c)))), n - 1) + 0.0
    )


def _digits_sql(c, n=6):
    return f"CASE WHEN {c} IS NULL OR isinf({c}) THEN NULL WHEN {c} = 0 THEN 0.0 ELSE round({c} / pow(10.0, floor(log10(abs({c})))), {n - 1}) + 0.0 END"


@query("equity_curve", with_(S.PRICES, _DAILY, *_TO_LEGS, _CURVE, _MARKET) + f"""SELECT date,
  {_digits_sql("p", 3)} AS portfolio_value, {_digits_sql("e", 4)} AS ew_value, {_digits_sql("m", 5)} AS spy_value FROM (
  SELECT date, round(10000 * product(1 + own) OVER w, 4) AS p, round(10000 * product(1 + ew) OVER w, 4) AS e, CASE
  WHEN spy IS NOT NULL THEN round(10000 * product(1 + coalesce(spy, 0)) OVER w, 4) END AS m
  FROM line LEFT JOIN market USING (date) WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def _(spark, d):
    r = stored(daily(spark, d), "daily")  # used five times
    curve = portfolio.equity_curve(stored(positions(spark, d), "positions"), periods(spark), r, market(r))
    shown = {"portfolio_value": 3, "ew_value": 4, "spy_value": 5}
    return curve.select("date", *[_digits(F.col(c), n).alias(c) for c, n in shown.items()])


_OWN_METRICS = """measured AS (SELECT avg(net) AS mean, stddev_samp(net) AS std, count(*) AS n,
  avg(turnover) AS average_turnover, sum(cost) AS total_cost, product(1 + net) - 1 AS total_return,
  avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM net)"""
_RUN = """SELECT n, round(mean / std * 2, 4) + 0.0 AS sharpe, round(win_rate, 4) AS win_rate, round(average_turnover,
  6) AS average_turnover, round(total_cost, 6) AS total_cost, round(total_return, 4) + 0.0 AS total_return,
  round(pow(1 + total_return, 4 / n) - 1, 4) + 0.0 AS annualized_return FROM measured"""
_RUN_COLUMNS = {"sharpe": 4, "win_rate": 4, "average_turnover": 6, "total_cost": 6, "total_return": 4, "annualized_return": 4}


@query("run_backtest", with_(*_TO_NET, _OWN_METRICS) + _RUN)
def _(spark, d):
    r = stored(monthly(spark, d), "monthly")
    scores = stored(S.scores(spark, d), "scores")
    out = portfolio.run_backtest(scores, S.universe(spark, d), r, market(daily(spark, d)), START, END, short_quantile=5)
    return out["metrics"].select("n", *[(F.round(c, n) + 0.0).alias(c) for c, n in _RUN_COLUMNS.items()])


@query("position_values", with_(*_TO_NET) + """SELECT rebalance_date, ticker, CASE WHEN weight >= 0 THEN 'long'
  ELSE 'short' END AS leg, round(v * abs(weight), 0) + 0.0 AS dollar_value FROM positions JOIN (
  SELECT period_start AS rebalance_date, round(10000 * coalesce(product(1 + net) OVER (ORDER BY period_start
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1), 4) AS v FROM net) USING (rebalance_date)""")
def _(spark, d):
    held, rows = positions(spark, d), net(spark, d)
    return portfolio.position_values(portfolio.portfolio_history(rows, held), held, 0).select(
        "rebalance_date", "ticker", "leg", (F.col("dollar_value") + 0.0).alias("dollar_value")
    )


# ---------------------------------------------------------------- metrics, one strategy per ticker

_STRATEGIES = "strategies AS (SELECT ticker AS strategy_id, date, ret FROM monthly WHERE ret IS NOT NULL)"


def strategies(spark, d):
    return monthly(spark, d).where("ret is not null").withColumnRenamed("ticker", "strategy_id")


_BASIC = """SELECT strategy_id, round(avg(ret) / stddev_samp(ret) * sqrt(12), 4) + 0.0 AS sharpe,
  round(avg(ret) / stddev_samp(ret) FILTER (ret < 0) * sqrt(12), 4) + 0.0 AS sortino,
  round(stddev_samp(ret) * sqrt(12), 4) AS volatility, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END),
  4) AS win_rate, round(max(ret), 4) AS best, round(min(ret), 4) AS worst, count(*) AS n FROM strategies
  GROUP BY strategy_id"""


@query("sharpe", with_(S.PRICES, _MONTHS, _STRATEGIES) + f"SELECT strategy_id, sharpe FROM ({_BASIC})")
def _(spark, d):
    return rounded(metrics.basic(strategies(spark, d)).select("strategy_id", "sharpe"))


@query("sortino", with_(S.PRICES, _MONTHS, _STRATEGIES) + f"SELECT strategy_id, sortino FROM ({_BASIC})")
def _(spark, d):
    return rounded(metrics.basic(strategies(spark, d)).select("strategy_id", "sortino"))


@query("volatility", with_(S.PRICES, _MONTHS, _STRATEGIES) + f"SELECT strategy_id, volatility FROM ({_BASIC})")
def _(spark, d):
    return rounded(metrics.basic(strategies(spark, d)).select("strategy_id", "volatility"))


@query("win_rate", with_(S.PRICES, _MONTHS, _STRATEGIES) + f"SELECT strategy_id, win_rate, best, worst, n FROM ({_BASIC})")
def _(spark, d):
    return rounded(metrics.basic(strategies(spark, d)).select("strategy_id", "win_rate", "best", "worst", "n"))


_DRAWDOWN = """grown AS (SELECT strategy_id, date, product(1 + ret) OVER (PARTITION BY strategy_id ORDER BY date
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM strategies),
topped AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY date) AS k, max(c)
  OVER (PARTITION BY strategy_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM grown),
low AS (SELECT strategy_id, min(c / top - 1) AS dd, arg_min(date, c / top - 1) AS trough, arg_min(k,
  c / top - 1) AS k_low FROM topped GROUP BY ALL),
draw AS (SELECT strategy_id, round(dd, 4) + 0.0 AS max_drawdown, max(date) AS peak, trough,
  max(k_low) - max(k) AS periods FROM topped JOIN low USING (strategy_id) WHERE c = top AND date <= trough
  GROUP BY strategy_id, dd, trough)"""


@query(
    "max_drawdown",
    with_(S.PRICES, _MONTHS, _STRATEGIES, _DRAWDOWN)
    + "SELECT strategy_id, max_drawdown, peak, trough, periods FROM draw"
)
def _(spark, d):
    return rounded(metrics.max_drawdown(strategies(spark, d)).withColumn("periods", F.col("periods").cast("long")))


def _ic_sql(keys: str, source: str) -> str:
    k = f"{keys}, " if keys else ""
    p = f"PARTITION BY {keys} " if keys else ""
    using = f"USING ({k}signal_date)"
    return f"""spans AS (SELECT * FROM (SELECT {k}signal_date, lead(signal_date) OVER ({p}ORDER BY signal_date) AS next
    FROM (SELECT DISTINCT {k}signal_date FROM {source})) WHERE next IS NOT NULL),
forward AS (SELECT {k}signal_date, ticker, composite_score, product(1 + ret) - 1 AS forward FROM {source}
  JOIN spans {using} JOIN monthly USING (ticker) WHERE date > signal_date AND date <= next AND ret IS NOT NULL
  GROUP BY ALL),
ranked AS (SELECT {k}signal_date, rank() OVER (PARTITION BY {k}signal_date ORDER BY composite_score) + (count(*)
  OVER (PARTITION BY {k}signal_date, composite_score) - 1) / 2 AS x,
  rank() OVER (PARTITION BY {k}signal_date ORDER BY forward) + (count(*) OVER (PARTITION BY {k}signal_date,
  forward) - 1) / 2 AS y FROM forward),
ics AS (SELECT {k}signal_date, count(*) AS n, corr(x, y) AS ic FROM ranked
  GROUP BY ALL HAVING count(*) >= 5 AND min(x) < max(x) AND min(y) < max(y))"""


@query(
    "information_coefficient",
    with_(S.PRICES, _MONTHS, S.SCORES, _ic_sql("", "scores"))
    + "SELECT signal_date, n, round(ic, 4) + 0.0 AS ic FROM ics"
)
def _(spark, d):
    return rounded(metrics.information_coefficients(S.scores(spark, d), monthly(spark, d)).select("signal_date", "n", "ic"))


_NAMED = "named AS (SELECT *, CAST(CAST(substr(ticker, 2) AS INT) % 3 AS VARCHAR) AS signal_name FROM scores)"
_SUMMARY = (
    "round(avg(ic), 4) + 0.0 AS mean_ic, round(stddev_samp(ic), 4) AS std_ic, "
    "round(avg(ic) / stddev_samp(ic) * sqrt(count(*)), 3) + 0.0 AS t_stat, round(avg(ic) / stddev_samp(ic), "
    "3) + 0.0 AS icir, count(*) AS n_dates FROM ics"
)


def _summary(df):
    return df.withColumns({c: F.round(c, n) + 0.0 for c, n in (("mean_ic", 4), ("std_ic", 4), ("t_stat", 3), ("icir", 3))})


@query("ic_summary", with_(S.PRICES, _MONTHS, S.SCORES, _ic_sql("", "scores")) + f"SELECT {_SUMMARY}")
def _(spark, d):
    return _summary(metrics.ic_summary(metrics.information_coefficients(S.scores(spark, d), monthly(spark, d))))


@query(
    "ic_by_signal",
    with_(S.PRICES, _MONTHS, S.SCORES, _NAMED, _ic_sql("signal_name", "named"))
    + f"SELECT signal_name, {_SUMMARY} GROUP BY signal_name"
)
def _(spark, d):
    named = S.scores(spark, d).withColumn("signal_name", (F.substring("ticker", 2, 9).cast("int") % 3).cast("string"))
    return _summary(metrics.ic_summary(metrics.information_coefficients(named, monthly(spark, d), ("signal_name",)), ("signal_name",)))


def factors(spark, d):
    """Monthly changes of mean order price by priority, as factors."""
    order = {"1-URGENT": "Mkt-RF", "2-HIGH": "SMB", "3-MEDIUM": "HML"}
    o = S.read(spark, d, "orders").groupBy(F.last_day("o_orderdate").alias("date")).agg(
        *[F.avg(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))).alias(f) for p, f in order.items()]
    )
    from pyspark.sql import Window as W

    w = W.orderBy("date")  # one row per month
    return o.select(
        "date", *[(F.try_divide(F.col(f"`{f}`"), F.lag(f"`{f}`").over(w)) - 1).alias(f) for f in order.values()]
    ).withColumn("RF", F.lit(0.001))


_FACTORS = """fm AS (SELECT last_day(o_orderdate) AS date, avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS a,
  avg(o_totalprice) FILTER (o_orderpriority = '2-HIGH') AS b, avg(o_totalprice)
  FILTER (o_orderpriority = '3-MEDIUM') AS c FROM orders GROUP BY ALL),
factors AS (SELECT date, a / lag(a) OVER w - 1 AS a, b / lag(b) OVER w - 1 AS b, c / lag(c) OVER w - 1 AS c
  FROM fm WINDOW w AS (ORDER BY date)),
aligned AS (SELECT strategy_id, date, ret, a, b, c FROM strategies JOIN factors USING (date)
  WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)"""


@query(
    "align_factors",
    with_(S.PRICES, _MONTHS, _STRATEGIES, _FACTORS)
    + "SELECT strategy_id, count(*) AS n, round(sum(ret * a), 4) + 0.0 AS s FROM aligned GROUP BY ALL"
)
def _(spark, d):
    a = metrics.align_factors(strategies(spark, d), factors(spark, d))
    return rounded(a.groupBy("strategy_id").agg(F.count("*").alias("n"), F.sum(F.col("ret") * F.col("`Mkt-RF`")).alias("s")))


# Loadings by taking the columns apart one after the other; the constant comes last, so it gives alpha and its error.
_REGRESSION = """base AS (SELECT strategy_id, ret - 0.001 AS y, a, b, c, 1.0 AS k FROM aligned),
s1 AS (SELECT strategy_id, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(a) AS ak,
  sum(y) AS sy, sum(y * y) AS yy FROM base GROUP BY ALL HAVING count(*) >= 12),
b1 AS (SELECT *, b - ab / aa * a AS q2, c - ac / aa * a AS c1, k - ak / aa * a AS k1 FROM base JOIN s1 USING (strategy_id)),
s2 AS (SELECT strategy_id, sum(q2 * q2) AS bb, sum(q2 * c1) AS bc, sum(q2 * k1) AS bk FROM b1 GROUP BY ALL),
b2 AS (SELECT *, c1 - bc / bb * q2 AS q3, k1 - bk / bb * q2 AS k2 FROM b1 JOIN s2 USING (strategy_id)),
s3 AS (SELECT strategy_id, sum(q3 * q3) AS cc, sum(q3 * k2) AS ck FROM b2 GROUP BY ALL),
b3 AS (SELECT *, k2 - ck / cc * q3 AS q4 FROM b2 JOIN s3 USING (strategy_id)),
s4 AS (SELECT strategy_id, any_value(n) AS n, any_value(yy) - any_value(sy) * any_value(sy) / any_value(n) AS tss,
  any_value(yy) AS yy, sum(y * a) / any_value(aa) AS g1, sum(y * q2) / any_value(bb) AS g2,
  sum(y * q3) / any_value(cc) AS g3, sum(y * q4) / sum(q4 * q4) AS alpha,
  sum(q4 * q4) AS kk, any_value(aa) AS aa, any_value(ab) AS ab, any_value(ac) AS ac, any_value(ak) AS ak,
  any_value(bb) AS bb, any_value(bc) AS bc, any_value(bk) AS bk, any_value(cc) AS cc, any_value(ck) AS ck FROM b3
  GROUP BY ALL),
s5 AS (SELECT *, g3 - alpha * ck / cc AS lc, yy - g1 * g1 * aa - g2 * g2 * bb - g3 * g3 * cc - alpha * alpha * kk AS rss FROM s4),
s6 AS (SELECT *, g2 - lc * bc / bb - alpha * bk / bb AS lb FROM s5), fitted AS (SELECT *,
  g1 - lb * ab / aa - lc * ac / aa - alpha * ak / aa AS la FROM s6)"""
_FITTED = "round(alpha, 4) + 0.0 AS alpha, round(alpha / sqrt(rss / (n - 4) / kk), 3) + 0.0 AS alpha_t"


@query(
    "factor_regression",
    with_(S.PRICES, _MONTHS, _STRATEGIES, _FACTORS, _REGRESSION)
    + f"SELECT strategy_id, n, {_FITTED}, round(la, 3) + 0.0 AS la, round(lb, 3) + 0.0 AS lb, round(lc, "
      f"3) + 0.0 AS lc, round(1 - rss / tss, 4) AS r2, round(sqrt(rss / (n - 1)), 4) AS residual_std FROM fitted"
)
def _(spark, d):
    f = metrics.factor_regression(metrics.align_factors(strategies(spark, d), factors(spark, d)))
    shown = {"alpha": 4, "alpha_t": 3, "r2": 4, "residual_std": 4}
    return f.select(
        "strategy_id", "n", *[(F.round(c, n) + 0.0).alias(c) for c, n in shown.items()],
        *[(F.round(F.col("loadings")[i], 3) + 0.0).alias(c) for i, c in enumerate(("la", "lb", "lc"))]
    )


_ONE_IC = (
    "one AS (SELECT round(avg(ic), 4) + 0.0 AS information_coefficient, "
    "round(avg(ic) / stddev_samp(ic) * sqrt(count(*)), 3) + 0.0 AS ic_t_stat, round(avg(ic) / stddev_samp(ic), "
    "3) + 0.0 AS information_ratio FROM ics)"
)


@query("compute_all", with_(S.PRICES, _MONTHS, _STRATEGIES, _DRAWDOWN, S.SCORES, _ic_sql("", "scores"), _ONE_IC, _FACTORS, _REGRESSION) + f"""SELECT m.*, max_drawdown, peak, trough, periods, total_return, one.*, alpha, alpha_t FROM ({_BASIC}) m LEFT JOIN draw USING (strategy_id)
  JOIN (SELECT strategy_id, round(product(1 + ret) - 1, 4) + 0.0 AS total_return FROM strategies
  GROUP BY ALL) USING (strategy_id) CROSS JOIN one LEFT JOIN (SELECT strategy_id, {_FITTED}
  FROM fitted) USING (strategy_id)""")
def _(spark, d):
    ics = metrics.ic_summary(metrics.information_coefficients(S.scores(spark, d), monthly(spark, d)))
    out = metrics.compute_all(
        strategies(spark, d), ics=ics, factors=factors(spark, d)
    ).drop("loadings").withColumn("periods", F.col("periods").cast("long"))
    return rounded(out.withColumns({c: F.round(c, 3) for c in ("ic_t_stat", "information_ratio", "alpha_t")}))


SWEEP = [
    portfolio.Strategy("wide", 3, 1, 3, 5.0), portfolio.Strategy("long", 5, 1, None, 10.0),
    portfolio.Strategy("both", 5, 1, 5, 10.0), portfolio.Strategy("low", 5, 5, None, 20.0)
]


def _sweep_sql() -> list[str]:
    sets = ", ".join(f"('{s.strategy_id}', {s.quantiles}, {s.long_quantile}, {s.short_quantile or 'NULL'}, {s.cost_bps})" for s in SWEEP)
    return [f"""sets(strategy_id, quantiles, lq, sq, bps) AS (VALUES {sets})""", """known AS (SELECT * FROM latest SEMI JOIN members USING (rebalance_date, ticker)),
edges AS (SELECT rebalance_date, quantile_cont(composite_score, [0, 1 / 3, 2 / 3, 1]) AS e, 3 AS quantiles,
  count(*) AS n FROM known GROUP BY rebalance_date
  UNION ALL SELECT rebalance_date, quantile_cont(composite_score, [0, 0.2, 0.4, 0.6, 0.8, 1]), 5, count(*) FROM known
  GROUP BY rebalance_date),
cells AS (SELECT k.*, quantiles, quantiles - greatest(len(list_filter(e, lambda x: x < composite_score)),
  1) + 1 AS quantile FROM known k JOIN edges USING (rebalance_date)
  WHERE n >= quantiles AND len(list_distinct(e)) = quantiles + 1),
swept AS (SELECT strategy_id, bps, rebalance_date, ticker, CASE WHEN quantile = lq THEN 1.0 ELSE -1.0 END / count(*)
  OVER (PARTITION BY strategy_id, rebalance_date, quantile) AS weight FROM cells JOIN sets USING (quantiles)
  WHERE quantile = lq OR quantile = sq),
sdays AS (SELECT strategy_id, rebalance_date, row_number() OVER (PARTITION BY strategy_id ORDER BY rebalance_date) AS k
  FROM (SELECT DISTINCT strategy_id, rebalance_date FROM swept)),
spk AS (SELECT strategy_id, bps, k, ticker, weight FROM swept JOIN sdays USING (strategy_id, rebalance_date)),
schange AS (SELECT strategy_id, k, abs(coalesce(x.weight, 0) - coalesce(y.weight, 0)) AS change FROM spk x FULL
  JOIN (SELECT strategy_id, k + 1 AS k, ticker, weight FROM spk) y USING (strategy_id, k, ticker)),
sturn AS (SELECT strategy_id, rebalance_date, CASE WHEN k = 1 THEN 1.0 ELSE sum(change) / 2 END AS turnover FROM schange
  JOIN sdays USING (strategy_id, k) GROUP BY strategy_id, k, rebalance_date),
held AS (SELECT ticker, period_start, period_end, product(1 + ret) - 1 AS ret FROM monthly
  JOIN periods ON date > period_start AND date <= period_end WHERE ret IS NOT NULL GROUP BY ALL),
sgross AS (SELECT strategy_id, any_value(bps) AS bps, rebalance_date, sum(weight * coalesce(ret, 0)) AS gross FROM swept
  LEFT JOIN held ON held.ticker = swept.ticker AND period_start = rebalance_date
  GROUP BY strategy_id, rebalance_date)"""]


@query(
    "strategy_sweep",
    with_(S.PRICES, _MONTHS, *_TO_DAYS, _MEMBERS, _LATEST, *_sweep_sql())
    + "SELECT strategy_id, rebalance_date AS period_start, round(turnover, 6) AS turnover, "
      "round(gross - turnover * bps / 10000, 4) + 0.0 AS net FROM sgross "
      "JOIN sturn USING (strategy_id, rebalance_date)"
)
def _(spark, d):
    r = stored(monthly(spark, d), "monthly")
    scores = stored(S.scores(spark, d), "scores")
    out = portfolio.run_sweep(scores, S.universe(spark, d), r, market(daily(spark, d)), START, END, SWEEP)
    return out["period_returns"].select(
        "strategy_id", "period_start", F.round("turnover", 6).alias("turnover"),
        (F.round("net", 4) + 0.0).alias("net")
    )
