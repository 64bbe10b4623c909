import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filingmill.operators import metrics, portfolio, ranks, signals, validate
from filingmill.operators.calendars import Dates
from filingmill.sources import sinks

D0 = date(2020, 1, 1)
pytestmark = pytest.mark.usefixtures("many_ranges")


def hot(spark, n=4000):
    """One group holds nearly all rows; values tie, some are null."""
    value = F.when(F.col("id") % 50 == 7, None).otherwise(F.col("id") * 7919 % 600 / 10.0)
    return spark.range(n).select("id", F.when(F.col("id") % 40 == 0, F.col("id") % 3).otherwise(9).alias("g"), value.alias("v"))


def test_ranks_are_those_of_windows(spark):
    rows = hot(spark)
    lines = ranks.ordered(rows, "t", F.asc("g"), F.desc("v"), F.asc("id"))
    assert lines.where("g = 9").select("part").distinct().count() > 1
    w = W.partitionBy("g").orderBy(F.desc("v"), "id")
    expected = rows.select("id", F.row_number().over(w).alias("k"), F.coalesce(F.sum("id").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    got = ranks.ranked(lines, "g").select("id", "k").join(ranks.running(lines, "id", "g").select("id", "before"), "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    whole = ranks.ranked(ranks.ordered(rows, "t", F.asc("id"))).select("id", "k").collect()
    assert all(r.k == r.id + 1 for r in whole)


def test_average_ranks_and_percentiles(spark):
    rows = hot(spark)
    known = rows.where("v is not null")
    ties = F.count("*").over(W.partitionBy("g", "v"))
    expected = known.select("id", (F.rank().over(W.partitionBy("g").orderBy("v")) + (ties - 1) / 2).alias("r"))
    got = ranks.average_ranks(rows, "v", "r", "g").select("id", "r")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    steps = [0, 0.1, 1 / 3, 0.5, 0.9, 1]
    lines = ranks.ordered(known, "t", F.asc("g"), F.asc("v"), F.asc("id"))
    edges = {r.g: (r.n, r.edges) for r in ranks.percentiles(lines, "v", steps, "g").collect()}
    exact = known.groupBy("g").agg(F.count("*").alias("n"), F.percentile("v", F.array(*map(F.lit, steps))).alias("edges")).collect()
    assert edges == {r.g: (r.n, r.edges) for r in exact}
    assert ranks.percentiles(lines.where("false"), "v", steps, "g").count() == 0


def test_a_date_of_any_size_is_dealt_over_tasks(spark):
    rows = spark.range(3000).select(F.lit(D0).alias("rebalance_date"), F.concat(F.lit("T"), "id").alias("ticker"), (F.col("id") % 700 / 7.0).alias("composite_score"))
    cut = portfolio.quantile_buckets(rows, 7)
    plan = cut._jdf.queryExecution().toString()
    assert "percentile(" not in plan and cut.groupBy("quantile").count().count() == 7
    ranked = signals.composite_rank(rows.withColumnRenamed("rebalance_date", "signal_date"))
    first = ranked.where("rank <= 2").orderBy("rank").collect()
    assert [r.ticker for r in first] == ["T1399", "T2099"] and ranked.agg(F.max("rank")).first()[0] == 3000


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_percentiles_of_many_dates_against_loops(spark, n):
    r = random.Random(n)
    days = sorted({D0 + timedelta(days=r.randrange(3 * n + 5)) for _ in range(n)})
    rows = [(f"T{i}", f"f{i}", r.choice("ab"), D0 + timedelta(days=r.randrange(-3, 3 * n + 9)), r.choice([0.0, 1.0, r.random()])) for i in range(40)]
    frame = spark.createDataFrame(rows, "ticker string, filing_id string, signal_name string, signal_date date, raw_value double")
    got = {(x.as_of, x.filing_id): (x.percentile, x.z_score) for x in signals.build_signals(frame, signals.dates(spark, days)).collect()}
    expected = {}
    for t in days if n < 1000 else days[::37]:
        for name in "ab":
            group = [x for x in rows if x[2] == name and x[3] <= t]
            for x in group:
                less, ties = sum(y[4] < x[4] for y in group), sum(y[4] == x[4] for y in group)
                p = None if len(group) < 3 else 50.0 if ties == len(group) else 100 * (2 * less + ties + 1) / (2 * len(group))
                expected[t, x[1]] = p
    assert len(got) == sum(x[3] <= t for t in days for x in rows)
    for key, p in expected.items():
        assert got[key][0] == (None if p is None else pytest.approx(p, abs=0.0051)), key


def test_as_of_joins_of_any_number_of_dates(spark):
    r = random.Random(3)
    days = [D0 + timedelta(days=2 * i) for i in range(12_000)]
    table = signals.dates(spark, days, "rebalance_date")
    assert Dates.of(table, "rebalance_date").n == 12_000
    some = [(f"T{i % 5}", D0 + timedelta(days=r.randrange(-20, 25_000)), float(i)) for i in range(60)] + [("T0", None, 1.0)]
    frame = spark.createDataFrame(some, "ticker string, signal_date date, composite_score double")
    got = {(x.rebalance_date, x.ticker): (x.signal_date, x.composite_score) for x in portfolio.latest_signal_as_of(table, frame).collect()}
    count = 0
    for t in days:
        for k in range(5):
            before = [(s, c) for ticker, s, c in some if ticker == f"T{k}" and s is not None and s <= t]
            if before:
                count += 1
                if days.index(t) % 301 == 0 if len(days) < 500 else t.day == 1:
                    assert got[t, f"T{k}"] == max(before)
    assert len(got) == count
    universe = [("A", days[3], days[5]), ("A", days[5], None), ("B", D0 - timedelta(days=9), D0), ("C", days[-1] + timedelta(days=1), None), ("D", D0 + timedelta(days=1), D0 + timedelta(days=1)), ("E", None, None)]
    members = portfolio.universe_on_date(table, spark.createDataFrame(universe, "ticker string, start_date date, end_date date")).collect()
    assert sum(m.ticker == "A" for m in members) == len(days) - 3 and [(m.ticker, m.rebalance_date) for m in members if m.ticker != "A"] == [("B", D0)]
    assert portfolio.latest_signal_as_of(table.where("false"), frame).count() == 0


def test_new_only_whatever_the_filter_says(spark):
    done = spark.range(0, 60_000, 2).select(F.col("id").alias("k"), F.lit("x").alias("s")).unionByName(spark.createDataFrame([(None, "x")], "k long, s string"))
    rows = spark.range(50_000).select(F.col("id").alias("k"), F.lit("x").alias("s"), F.lit(1).alias("text")).unionByName(
        spark.createDataFrame([(None, "x", 1), (2, "y", 1), (2, None, 1)], "k long, s string, text int")
    )
    expected = sorted(map(repr, rows.join(done, ["k", "s"], "left_anti").select("k", "s", "text").collect()))
    for bits in (1, 16):  # one bit a key: most places are taken, by other keys too
        got = sinks.new_only(rows, done, ["k", "s"], bits)
        assert got.columns == rows.columns and sorted(map(repr, got.collect())) == expected
    assert sinks.new_only(rows, done.where("false"), ["k", "s"]).count() == rows.count()


def test_quarantine_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(100).select("id", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 4 > 0).alias("valid")).mapInArrow(count, "id long, valid boolean")
    import tempfile

    made = validate.quarantine(rows, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/q")
    assert (made.n_valid, made.n_bad) == (made.valid.count(), made.bad.count()) == (70, 30) and seen.value == 100
    assert made.valid.columns == ["id"] and {r.id for r in made.bad.collect()} == {i for i in range(100) if i % 10 == 0 or i % 4 == 0}


def test_falls_and_all_metrics_in_one_pass(spark):
    r = random.Random(2)
    series = {f"s{k}": [r.choice([0.0, 0.1, -0.1, r.uniform(-0.3, 0.3), None]) for _ in range(60)] for k in range(6)}
    series |= {"none": [None], "one": [-0.1]}
    rows = [(k, D0 + timedelta(days=i), x) for k, xs in series.items() for i, x in enumerate(xs)]
    frame = spark.createDataFrame(rows, "strategy_id string, date date, ret double").repartition(5)
    got = {x.strategy_id: x for x in metrics.compute_all(frame).collect()}
    for k, xs in series.items():
        c, top, worst = 1.0, None, None
        n = 0
        for i, x in enumerate(xs):
            if x is None:
                continue
            c, n = c * (1 + x), n + 1
            if top is None or c >= top[0]:
                top = (c, i, n)
            if worst is None or c / top[0] - 1 < worst[0]:
                worst = (c / top[0] - 1, D0 + timedelta(days=top[1]), D0 + timedelta(days=i), n - top[2])
        x = got[k]
        assert (x.max_drawdown, x.peak, x.trough, x.periods) == (worst or (0.0, None, None, None))
    plan = metrics.compute_all(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD[strategy_id") == 1 and "Window" not in plan


def test_reports_of_a_sweep_are_one_row_each(spark):
    periods = spark.createDataFrame([("a", D0, 0.1), ("b", D0, 0.2), ("b", D0 + timedelta(days=9), 0.3)], "strategy_id string, period_start date, net double")
    numbers = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "strategy_id string, sharpe double")
    counts = spark.createDataFrame([(D0, 5)], "signal_date date, n long")
    got = {r.strategy_id: r.report for r in sinks.backtest_report(periods, numbers, counts).collect()}
    assert got["b"] == '{"periods":[{"period_start":"2020-01-01","net":0.2},{"period_start":"2020-01-10","net":0.3}],"metrics":[{"strategy_id":"b","sharpe":2.0}],"signals":[{"signal_date":"2020-01-01","n":5}]}'
    assert set(got) == {"a", "b"}
