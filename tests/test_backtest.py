import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from filingmill.operators import metrics, portfolio, returns
from filingmill.plans import standin
from filingmill.sources.store import stored

D = date


def prices(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, price double")


def test_returns(spark):
    p = prices(
        spark,
        [
            ("A", D(2024, 1, 2), 100.0), ("A", D(2024, 1, 31), 105.0), ("A", D(2024, 2, 29), 110.0),
            ("A", D(2024, 4, 30), 121.0)
        ]
    )
    daily = returns.daily_returns(p).orderBy("date").collect()
    assert daily[0].ret is None and daily[1].ret == pytest.approx(0.05)
    month = {r.date: r.ret for r in returns.monthly_returns(p).collect()}
    assert month[D(2024, 3, 31)] == 0 and month[D(2024, 4, 30)] == pytest.approx(0.10)
    whole = returns.compound_to_monthly(returns.daily_returns(p, "2024-01-03")).orderBy("date").first()
    assert whole.ret == pytest.approx(0.05)


def test_rebalance_dates(spark):
    got = [r[0] for r in portfolio.rebalance_dates(spark, "2024-01-01", "2024-12-31").orderBy("rebalance_date").collect()]
    assert got == [D(2024, 3, 29), D(2024, 6, 28), D(2024, 9, 30), D(2024, 12, 31)]
    assert portfolio.rebalance_dates(spark, "2024-01-01", "2024-12-31", "monthly").count() == 12


def scores(spark, values, day=D(2024, 3, 29)):
    return spark.createDataFrame(
        [(day, f"T{i}", v) for i, v in enumerate(values)],
        "rebalance_date date, ticker string, composite_score double"
    )


def test_quantiles_and_legs(spark):
    got = {r.ticker: r.quantile for r in portfolio.quantile_buckets(scores(spark, [float(i) for i in range(10)])).collect()}
    assert [got[f"T{i}"] for i in range(10)] == [5, 5, 4, 4, 3, 3, 2, 2, 1, 1]
    assert portfolio.quantile_buckets(scores(spark, [1.0, 2.0, 3.0])).count() == 0
    assert portfolio.quantile_buckets(scores(spark, [1.0] * 10)).count() == 0
    legs = portfolio.leg_weights(portfolio.quantile_buckets(scores(spark, [float(i) for i in range(10)])), 1, 5)
    sums = {r.quantile: r.w for r in legs.groupBy("quantile").agg(F.sum("weight").alias("w")).collect()}
    assert sums == {1: 1.0, 5: -1.0}


def test_turnover(spark):
    rows = [(D(2024, m, 28), t, 0.5) for m in (3, 6) for t in ("A", "B")] + [(D(2024, 9, 28), "C", 1.0)]
    got = [
        r.turnover
        for r in portfolio.turnover(
            spark.createDataFrame(rows, "rebalance_date date, ticker string, weight double")
        ).orderBy("rebalance_date").collect()
    ]
    assert got == [1.0, 0.0, 1.0]


def test_curve_stays_flat(spark):
    held = spark.createDataFrame([(D(2024, 3, 29), "A", 1.0)], "rebalance_date date, ticker string, weight double")
    periods = spark.createDataFrame([(D(2024, 3, 29), D(2024, 6, 28))], "period_start date, period_end date")
    r = spark.createDataFrame([("A", D(2024, 4, i), 0.0) for i in range(1, 6)], "ticker string, date date, ret double")
    curve = portfolio.equity_curve(held, periods, r, r.select("date", "ret")).collect()
    assert {(x.portfolio_value, x.spy_value, x.ew_value) for x in curve} == {(10000.0, 10000.0, 10000.0)} and len(curve) == 5


def series(spark, values, key="s"):
    return spark.createDataFrame(
        [(key, D(2020 + i // 12, i % 12 + 1, 28), v) for i, v in enumerate(values)],
        "strategy_id string, date date, ret double"
    )


def test_metrics(spark):
    assert metrics.max_drawdown(series(spark, [0.10, -0.20, 0.05])).first().max_drawdown == pytest.approx(-0.2)
    assert metrics.max_drawdown(series(spark, [-0.10])).first().max_drawdown == 0
    flat = metrics.basic(series(spark, [0.01] * 5)).first()
    assert flat.sharpe == 0 and math.isinf(flat.sortino) and flat.win_rate == 1
    assert math.isnan(metrics.basic(series(spark, [0.01, -0.01, 0.02])).first().sortino)
    assert metrics.basic(series(spark, [0.02])).first().volatility == 0


def test_regression(spark):
    rows = [
        ("s", D(2020 + i // 12, i % 12 + 1, 28), 0.01 + 2 * x - y, x, y, 0.0) for i in range(24)
        for x, y in [((i * 7 % 11) / 100, (i * 5 % 13) / 100)]
    ]
    df = spark.createDataFrame(rows, "strategy_id string, date date, ret double, `Mkt-RF` double, SMB double, RF double")
    got = metrics.factor_regression(df).first()
    assert got.alpha == pytest.approx(0.01) and got.loadings == pytest.approx([2, -1]) and got.r2 == pytest.approx(1)
    assert metrics.factor_regression(df.limit(6)).count() == 0


def test_ic(spark):
    s = spark.createDataFrame(
        [(f"T{i}", d, float(i)) for i in range(6) for d in (D(2024, 1, 31), D(2024, 2, 29))],
        "ticker string, signal_date date, composite_score double"
    )
    r = spark.createDataFrame([(f"T{i}", D(2024, 2, 15), i / 100) for i in range(6)], "ticker string, date date, ret double")
    ics = metrics.information_coefficients(s, r).collect()
    assert len(ics) == 1 and ics[0].ic == pytest.approx(1)


def test_params():
    with pytest.raises(ValueError, match="before"):
        portfolio.check_params("2024-01-01", "2023-01-01", ["A"], 5, 1, None)
    with pytest.raises(ValueError, match="quantile"):
        portfolio.check_params("2023-01-01", "2024-01-01", ["A"], 5, 6, None)


def test_drawdown_counts_periods(spark):
    row = metrics.max_drawdown(series(spark, [0.10, -0.05, 0.01, -0.20, 0.30])).first()
    assert (row.peak, row.trough, row.periods) == (D(2020, 1, 28), D(2020, 4, 28), 3)


def test_market_is_null_without_data(spark):
    held = spark.createDataFrame([(D(2024, 3, 29), "A", 1.0)], "rebalance_date date, ticker string, weight double")
    periods = spark.createDataFrame([(D(2024, 3, 29), D(2024, 6, 28))], "period_start date, period_end date")
    r = spark.createDataFrame([("A", D(2024, 4, i), 0.1) for i in range(1, 5)], "ticker string, date date, ret double")
    market = spark.createDataFrame([(D(2024, 4, 1), 0.5), (D(2024, 4, 2), None), (D(2024, 4, 4), 0.5)], "date date, ret double")
    curve = [x.spy_value for x in portfolio.equity_curve(held, periods, r, market).orderBy("date").collect()]
    assert curve == [15000.0, None, None, 22500.0]


def test_backtest_and_sweep_agree(spark):
    days = [D(2023, m, 1) for m in (1, 4, 7, 10)]
    composites = spark.createDataFrame(
        [(f"T{i}", d, float(i * 7 % 10 + k)) for i in range(10) for k, d in enumerate(days)],
        "ticker string, signal_date date, composite_score double"
    )
    universe = spark.createDataFrame([(f"T{i}", D(2020, 1, 1), None) for i in range(10)], "ticker string, start_date date, end_date date")
    r = spark.createDataFrame(
        [(f"T{i}", D(2023, m, 28), (i - 4 + m % 3) / 100) for i in range(10) for m in range(1, 13)],
        "ticker string, date date, ret double"
    )
    market = r.groupBy("date").agg(F.avg("ret").alias("ret"))
    args = (composites, universe, r, market, "2023-01-01", "2023-12-31")
    one = portfolio.run_backtest(*args, short_quantile=5, cost_bps=20.0)
    sweep = portfolio.run_sweep(*args, [portfolio.Strategy("a", 5, 1, 5, 20.0), portfolio.Strategy("b", 2, 1)])
    pick = lambda rows, *c: sorted(tuple(x) for x in rows.select(*c).collect())
    assert pick(one["period_returns"], "period_start", "net", "turnover") == pick(
        sweep["period_returns"].where("strategy_id = 'a'"), "period_start", "net", "turnover"
    )
    assert pick(one["equity_curve"], "date", "portfolio_value") == pick(
        sweep["equity_curve"].where("strategy_id = 'a'"), "date", "portfolio_value"
    )
    m = one["metrics"].first()
    costs = [x.cost for x in one["period_returns"].collect()]
    assert m.total_cost == pytest.approx(sum(costs)) and m.average_turnover == pytest.approx(sum(costs) / len(costs) / 0.002)
    valued = one["position_values"].where("rebalance_date = '2023-03-31'").collect()
    assert {(x.leg, x.dollar_value) for x in valued} == {("long", 5000.0), ("short", 5000.0)}
    with pytest.raises(ValueError, match="no rebalance date"):
        portfolio.run_backtest(composites.where("false"), *args[1:])
    with pytest.raises(ValueError, match="names"):
        portfolio.sweep_positions(one["positions"], [])


def test_values_are_rounded_once(spark):
    """62.4976 dollars are 62 to no digits; by way of cents, 62.50, they were 63."""
    day = date(2023, 3, 31)
    held = spark.createDataFrame([(day, "A", 0.00625), (day, "B", -0.00625)], "rebalance_date date, ticker string, weight double")
    before = spark.createDataFrame([(day, 9999.616)], "period_start date, value_before double")
    values = lambda *digits: {x.dollar_value for x in portfolio.position_values(before, held, *digits).collect()}
    assert values(0) == {62.0} and values() == {62.5}
    rows = spark.createDataFrame(
        [(date(2022, 12, 30), -0.000005004, 1.0, 0.0), (day, 0.0, 0.0, 0.0)], "period_start date, net double, turnover double, cost double"
    )
    to_one = portfolio.portfolio_history(rows, held, digits=1).first()
    assert to_one.value_before == 9999.9


def test_drawdown_ties(spark):
    """A month without a move after the top moves the peak on; one after the bottom leaves the trough."""
    m = metrics.max_drawdown(series(spark, [0.1, 0.0, -0.5, 0.0, 0.3])).first()
    assert (m.peak.month, m.trough.month, m.periods) == (2, 3, 1)


def test_metrics_with_factors_and_ic(spark):
    s = series(spark, [0.01 * (i % 5) for i in range(24)])
    f = s.select("date", (F.col("ret") * 2).alias("Mkt-RF"))
    ics = spark.createDataFrame([(0.1, 2.0, 0.5)], "mean_ic double, t_stat double, icir double")
    full = metrics.compute_all(s, ics=ics, factors=f).first()
    assert full.information_coefficient == 0.1 and full.loadings == pytest.approx([0.5])
    bare = metrics.compute_all(s).first()
    assert bare.alpha is None and bare.information_ratio is None


def test_prices_meet_their_ticker_once(spark):
    """Days, months and the windows over a ticker follow one exchange; the months between prices need no other copy of them."""
    gaps = returns.price_gaps(standin.prices(spark, "/root/testdata/sf0.001"))
    assert gaps._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    days = [("a", "2020-01-31", 1.0), ("a", "2020-01-05", 9.0), ("a", "2020-04-02", 2.0), ("a", "2020-04-29", None), ("a", "2021-01-01", 3.0), ("b", "2020-02-29", 5.0), ("c", "2020-02-29", None)]
    own = spark.createDataFrame(days, "ticker string, date string, price double").withColumn("date", F.to_date("date"))
    found = {(r.ticker, str(r.date)): r.price for r in returns.price_gaps(own).collect()}
    ends = ["2020-01-31", "2020-02-29", "2020-03-31", "2020-04-30", "2020-05-31", "2020-06-30", "2020-07-31", "2020-08-31", "2020-09-30", "2020-10-31", "2020-11-30", "2020-12-31", "2021-01-31"]
    assert found == {("a", e): 1.0 if e < "2020-04" else 2.0 if e < "2021" else 3.0 for e in ends} | {("b", "2020-02-29"): 5.0}


def test_backtest_queries_read_lines_once_for_days_and_once_for_scores(spark, monkeypatch):
    from filingmill.plans import backtests

    kept = []
    monkeypatch.setattr(backtests, "stored", lambda df, name: kept.append(name) or stored(df, name))
    queries()["run_backtest"](spark, "/root/testdata/sf0.001")
    assert kept == ["monthly", "scores"]
    kept.clear()
    queries()["equity_curve"](spark, "/root/testdata/sf0.001")
    assert kept == ["daily", "positions"]
