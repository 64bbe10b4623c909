"""Risk and skill metrics, per ``strategy_id``, so that thousands of strategies are one job."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filingmill.sources.store import stored

from .ranks import average_ranks
from .returns import compound

KEY = "strategy_id"
LEAST_TICKERS, LEAST_ROWS = 5, 12
FACTORS = ("Mkt-RF", "SMB", "HML", "RMW", "CMA", "UMD")


def _moments(risk_free_period: float) -> list[Column]:
    """Aggregates that ``_numbers`` reads; Spark merges their partial states."""
    r, x = F.col("ret"), F.col("ret") - risk_free_period
    return [
        F.count("ret").alias("n"), F.avg(x).alias("mean"), F.stddev_samp("ret").alias("std"),
        (F.min("ret") == F.max("ret")).alias("flat"), F.stddev_samp(F.when(x < 0, x)).alias("down"),
        F.count_if(x < 0).alias("n_down"), (F.min(F.when(x < 0, x)) == F.max(F.when(x < 0, x))).alias("flat_down"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.max("ret").alias("best"),
        F.min("ret").alias("worst"),
    ]


def _numbers(per_year: int) -> list[Column]:
    year = F.sqrt(F.lit(float(per_year)))
    enough = F.col("n") >= 2
    sharpe = F.when(enough & ~F.col("flat"), F.col("mean") / F.nullif(F.col("std"), F.lit(0.0)) * year).otherwise(0.0)
    endless = F.when(F.col("mean") > 0, F.lit(float("inf"))).otherwise(0.0)
    sortino = (
        F.when(~enough, 0.0).when(F.col("n_down") == 0, endless).when(F.col("n_down") == 1, F.lit(float("nan")))
        .when(F.col("flat_down"), endless).otherwise(F.col("mean") / F.nullif(F.col("down"), F.lit(0.0)) * year)
    )
    return [
        sharpe.alias("sharpe"), sortino.alias("sortino"), F.when(enough, F.col("std") * year).otherwise(0.0).alias("volatility"),
        F.col("win_rate"), F.col("best"), F.col("worst"), F.col("n"),
    ]


def _per_period(risk_free: float, per_year: int) -> float:
    return (1 + risk_free) ** (1 / per_year) - 1


def basic(returns: DataFrame, per_year: int = 12, risk_free: float = 0.0) -> DataFrame:
    """(strategy_id, sharpe, sortino, volatility, win_rate, best, worst, n) of (strategy_id, date, ret)."""
    return returns.groupBy(KEY).agg(*_moments(_per_period(risk_free, per_year))).select(KEY, *_numbers(per_year))


def _series() -> Column:
    """A strategy's known returns in order: one entry per date, so as many as a calendar has at most."""
    return F.array_sort(F.collect_list(F.when(F.col("ret").isNotNull(), F.struct("date", "ret"))))


_FALL = "struct<c:double,k:int,top:double,top_date:date,top_k:int,dd:double,peak:date,trough:date,periods:int>"


def _fall(series: Column) -> Column:
    """The deepest fall of a series from its running maximum, in one pass over its entries; null of an empty one."""

    def step(s: Column, x: Column) -> Column:
        c, k = s["c"] * (1 + x["ret"]), s["k"] + 1
        up = s["top"].isNull() | (c >= s["top"])  # the last place at the maximum so far is the peak
        top, top_date, top_k = (F.when(up, now).otherwise(s[name]) for name, now in (("top", c), ("top_date", x["date"]), ("top_k", k)))
        dd = c / top - 1
        lower = s["dd"].isNull() | (dd < s["dd"])
        low = {"dd": dd, "peak": top_date, "trough": x["date"], "periods": k - top_k}
        now = [c.alias("c"), k.alias("k"), top.alias("top"), top_date.alias("top_date"), top_k.alias("top_k")]
        return F.struct(*now, *[F.when(lower, v).otherwise(s[name]).alias(name) for name, v in low.items()]).cast(_FALL)

    names = [f.split(":")[0] for f in _FALL.removeprefix("struct<").removesuffix(">").split(",")]
    start = F.struct(*[F.lit({"c": 1.0, "k": 0, "top_k": 0}.get(name)).alias(name) for name in names]).cast(_FALL)
    return F.aggregate(series, start, step)


def max_drawdown(returns: DataFrame) -> DataFrame:
    """(strategy_id, max_drawdown, peak, trough, periods): the running maximum starts at the first value, not at 1;
    ``periods`` counts the rows from peak to trough."""
    falls = returns.where("ret is not null").groupBy(KEY).agg(_series().alias("series")).select(KEY, _fall(F.col("series")).alias("fall"))
    return falls.select(KEY, F.col("fall.dd").alias("max_drawdown"), "fall.peak", "fall.trough", "fall.periods")


def information_coefficients(signals: DataFrame, returns: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, signal_date, ic, n): rank correlation of scores with the return up to the next signal date.

    ``signals`` (keys, ticker, signal_date, composite_score), ``returns`` (ticker, date, ret). A date belongs to one
    span of a key, so dates are put to spans first and returns meet signals by equal keys, each once."""
    keys = list(keys)
    days = signals.select(*keys, "signal_date").distinct()
    w = W.partitionBy(*keys).orderBy("signal_date")  # one row per date
    spans = days.withColumn("next", F.lead("signal_date").over(w)).where("next is not null")
    known = returns.where("ret is not null")
    inside = (F.col("date") > F.col("signal_date")) & (F.col("date") <= F.col("next"))
    dated = known.select("date").distinct().join(spans, inside).select(*keys, "signal_date", "date")
    joined = known.join(dated, "date").join(
        signals.select(*keys, "signal_date", "ticker", "composite_score"), [*keys, "signal_date", "ticker"]
    )
    forward = joined.groupBy(*keys, "signal_date", "ticker", "composite_score").agg(compound(F.col("ret")).alias("forward"))
    group = [*keys, "signal_date"]

    # Equal values are counted, and the counts summed over ranges: a date of any size is ranked by all tasks.
    forward = stored(forward, "forward")
    ranked = average_ranks(average_ranks(forward, "composite_score", "x", *group), "forward", "y", *group)
    ranked = ranked.select(*group, "x", "y")
    some = ranked.groupBy(*group).agg(
        F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
        F.max("y").alias("y1")
    )
    some = some.where((F.col("n") >= LEAST_TICKERS) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))).select(*group, "n")
    return ranked.join(some, group).groupBy(*group, "n").agg(F.corr("x", "y").alias("ic"))


def ic_summary(ics: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, mean_ic, std_ic, t_stat, icir, n_dates)."""
    a = ics.groupBy(*keys).agg(
        F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.count("*").alias("n_dates")
    ).where("n_dates > 0")
    ratio = F.coalesce(F.try_divide(F.col("mean_ic"), F.col("std_ic")), F.lit(0.0))
    return a.select(
        *keys, "mean_ic", F.coalesce("std_ic", F.lit(0.0)).alias("std_ic"),
        (ratio * F.sqrt("n_dates")).alias("t_stat"), ratio.alias("icir"), "n_dates"
    )


def align_factors(returns: DataFrame, factors: DataFrame, by_month: bool = False) -> DataFrame:
    """Returns with the factors of their date (or month), rows with any null dropped."""
    if by_month:
        factors = factors.withColumn("month", F.trunc("date", "month")).drop("date")
        return returns.withColumn("month", F.trunc("date", "month")).join(factors, "month").drop("month").dropna()
    return returns.join(factors, "date").dropna()


def factor_regression(aligned: DataFrame) -> DataFrame:
    """Per strategy: alpha, its t value, loadings, R², residual std, of at least LEAST_ROWS rows.

    Spark sums the cross products, so a strategy reaches Python as one row however long its series."""
    names = [f for f in FACTORS if f in aligned.columns]
    y = F.col("ret") - (F.col("RF") if "RF" in aligned.columns else F.lit(0.0))
    terms = [F.lit(1.0), *[F.col(f"`{f}`") for f in names], y]
    k = len(terms)
    sums = [F.sum(terms[i] * terms[j]) for i in range(k) for j in range(i, k)]
    rows = aligned.groupBy(KEY).agg(F.count("*").alias("n"), F.array(*sums).alias("m")).where(F.col("n") >= LEAST_ROWS)
    schema = "alpha double, alpha_t double, loadings array<double>, r2 double, residual_std double"

    @F.pandas_udf(schema)
    def solve(n: pd.Series, m: pd.Series) -> pd.DataFrame:
        out = []
        for count, flat in zip(n, m, strict=True):
            a = np.zeros((k, k))
            a[np.triu_indices(k)] = flat
            a = a + np.triu(a, 1).T
            xx, xy, yy = a[:-1, :-1], a[:-1, -1], a[-1, -1]
            inverse = np.linalg.pinv(xx)
            beta = inverse @ xy
            rss = max(yy - beta @ xy, 0.0)
            tss = yy - a[0, -1] ** 2 / count
            free = count - (k - 1)
            error = np.sqrt(rss / free * inverse[0, 0]) if free > 0 else 0.0
            out.append(
                (
                    beta[0], beta[0] / error if error else 0.0, list(beta[1:]), 1 - rss / tss if tss else 0.0,
                    np.sqrt(rss / (count - 1))
                )
            )
        return pd.DataFrame(out, columns=["alpha", "alpha_t", "loadings", "r2", "residual_std"])

    return rows.select(KEY, "n", solve("n", "m").alias("f")).select(KEY, "n", "f.*")


def compute_all(
    returns: DataFrame, per_year: int = 12, risk_free: float = 0.0, ics: DataFrame | None = None,
    factors: DataFrame | None = None
) -> DataFrame:
    """All metrics of a series in one row per strategy.

    ``ics`` is one row of ``ic_summary`` (or one per strategy), ``factors`` (date, factors); what is not given, or cannot be computed, is null."""
    # One pass: moments, product and series of a strategy come out of the same aggregation.
    summed = returns.groupBy(KEY).agg(
        *_moments(_per_period(risk_free, per_year)), compound(F.col("ret")).alias("total_return"), _series().alias("series")
    )
    out = summed.withColumn("fall", _fall(F.col("series"))).select(
        KEY, *_numbers(per_year), F.coalesce("fall.dd", F.lit(0.0)).alias("max_drawdown"), "fall.peak", "fall.trough", "fall.periods", "total_return"
    )
    if ics is None:
        ics = returns.sparkSession.createDataFrame([], "mean_ic double, t_stat double, icir double")
    key = [KEY] if KEY in ics.columns else []
    ics = ics.select(
        *key, F.col("mean_ic").alias("information_coefficient"), F.col("t_stat").alias("ic_t_stat"),
        F.col("icir").alias("information_ratio")
    )
    out = out.join(ics, KEY, "left") if key else out.join(ics, F.lit(True), "left")  # one row at most
    if factors is None:
        none = F.lit(None).cast("double")
        return out.select("*", none.alias("alpha"), none.alias("alpha_t"), F.lit(None).cast("array<double>").alias("loadings"))
    fitted = factor_regression(align_factors(returns, factors)).select(KEY, "alpha", "alpha_t", "loadings")
    return out.join(fitted, KEY, "left")
