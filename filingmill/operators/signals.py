"""Raw signals, cross-section normalisation as of any dates, decay and composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .calendars import Dates
from .ranks import ordered, ranked, running

BUFFER_DAYS, HALF_LIFE = 2, 90
LEAST = 3


def dates(spark, days: list, name: str = "as_of") -> DataFrame:
    """A table of parameter dates."""
    return spark.createDataFrame([(d,) for d in sorted(set(days))], f"{name} date")


def attach_filing_dates(results: DataFrame, filings: DataFrame) -> DataFrame:
    """Results of known filings that have a ticker, with ticker and filed_date."""
    return results.join(filings.where("ticker is not null").select("filing_id", "ticker", "filed_date"), "filing_id")


def raw_signals(sentiment: DataFrame, similarity: DataFrame, filings: DataFrame, buffer_days: int = BUFFER_DAYS) -> DataFrame:
    """(ticker, filing_id, signal_name, signal_date, raw_value): scores and changes, dated some days after filing."""
    a = sentiment.select(
        "filing_id", F.concat_ws("_", "analyzer_name", "section_name").alias("signal_name"),
        F.col("sentiment_score").alias("raw_value")
    )
    b = similarity.select(
        "filing_id", F.concat_ws("_", F.lit("similarity"), "section_name").alias("signal_name"),
        F.col("change_score").alias("raw_value")
    )
    dated = attach_filing_dates(a.unionByName(b), filings)
    return dated.select("ticker", "filing_id", "signal_name", F.date_add("filed_date", buffer_days).alias("signal_date"), "raw_value")


def signals_as_of(signals: DataFrame, as_of: DataFrame) -> DataFrame:
    """Every signal once per as-of date on or after its own. ``as_of`` is a parameter table (see ``dates``)."""
    known = Dates.of(as_of, "as_of")
    return known.named(_expanded(signals, known), "place", "as_of")


def _expanded(signals: DataFrame, known: Dates) -> DataFrame:
    placed = known.first_from(signals, F.col("signal_date"), "__from")
    return known.expanded(placed, F.col("__from"), F.lit(known.n)).drop("__from")


def cross_section(signals: DataFrame, as_of: DataFrame) -> DataFrame:
    """Per (as_of, signal_name): n, mean, std, least, most over all signals so far.

    Each signal is aggregated once, into the first as-of date it counts for; the sums then run on over dates.
    So history is read once, not once per date."""
    known = Dates.of(as_of, "as_of")
    return known.named(_statistics(signals, known), "place", "as_of")


def _statistics(signals: DataFrame, known: Dates) -> DataFrame:
    part = known.first_from(signals, F.col("signal_date"), "place").where(F.col("place") <= known.n).groupBy("place", "signal_name").agg(
        F.count("raw_value").alias("n"), F.avg("raw_value").alias("m"),
        F.coalesce(F.var_pop("raw_value"), F.lit(0.0)).alias("v"), F.min("raw_value").alias("low"),
        F.max("raw_value").alias("high")
    )
    names = part.select("signal_name").distinct()
    grid = known.expanded(names, F.lit(1), F.lit(known.n)).join(part, ["place", "signal_name"], "left")
    w = W.partitionBy("signal_name").orderBy("place").rowsBetween(W.unboundedPreceding, 0)  # one row per date
    run = grid.select(
        "place", "signal_name", F.sum("n").over(w).alias("n"), F.sum(F.col("n") * F.col("m")).over(w).alias("s"),
        F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))).over(w).alias("q"),
        F.min("low").over(w).alias("low"), F.max("high").over(w).alias("high"),
    ).where("n > 0")
    mean = F.col("s") / F.col("n")
    spread = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("n") * mean * mean)) / (F.col("n") - 1)))
    return run.select("place", "signal_name", "n", mean.alias("mean"), spread.alias("std"), "low", "high")


def _standardised() -> Column:
    z = F.when(F.col("n") < LEAST, None).when(F.col("low") == F.col("high"), 0.0).otherwise(
        F.round((F.col("raw_value") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)), 6)
    )
    return F.coalesce(z, F.when(F.col("n") >= LEAST, 0.0))


def zscore(signals: DataFrame, as_of: DataFrame) -> DataFrame:
    """Signals as of each date with z_score: null in groups under three, 0 where all values are equal."""
    known = Dates.of(as_of, "as_of")
    met = _expanded(signals, known).join(_statistics(signals, known), ["place", "signal_name"])
    return known.named(met.withColumn("z_score", _standardised()).drop("n", "mean", "std", "low", "high"), "place", "as_of")


def percentile_rank(signals: DataFrame, as_of: DataFrame) -> DataFrame:
    """Signals as of each date with percentile: average rank of ties over n, 50 where all values are equal.

    History is counted once, per distinct value and first date; these counts, never more than the result, are put to the
    later dates and summed in order of value over ranges, so no task holds a date or a signal (see ``ranks``)."""
    known = Dates.of(as_of, "as_of")
    return known.named(_percentiles(signals, known), "place", "as_of")


def _percentiles(signals: DataFrame, known: Dates) -> DataFrame:
    keys = ["place", "signal_name"]
    first = known.first_from(signals, F.col("signal_date"), "first")
    counts = first.where("raw_value is not null").groupBy("first", "signal_name", "raw_value").agg(F.count("*").alias("n"))
    ties = known.expanded(counts, F.col("first"), F.lit(known.n)).groupBy(*keys, "raw_value").agg(F.sum("n").alias("ties"))
    lines = ordered(ties, "percentiles", *[F.asc(c) for c in (*keys, "raw_value")])
    sizes = lines.groupBy(*keys).agg(F.sum("ties").alias("n"))
    p = F.when(F.col("n") < LEAST, None).when(F.col("ties") == F.col("n"), 50.0).otherwise(
        F.round(100 * (2 * F.col("before") + F.col("ties") + 1) / (2 * F.col("n")), 2)
    )
    by_value = running(lines, "ties", *keys).join(sizes, keys).select(*keys, "raw_value", p.alias("percentile"))
    # A value that many signals share is one row on the right, so a skewed join is split on the left.
    return _expanded(signals, known).join(by_value, [*keys, "raw_value"])


def decay_weight(as_of: Column, signal_date: Column, half_life: int = HALF_LIFE) -> Column:
    """Halves every ``half_life`` days; 1 up to day 0, 0 after ten half-lives."""
    if half_life < 1:
        raise ValueError("half_life must be at least 1")
    age = F.datediff(as_of, signal_date)
    return F.when(age <= 0, 1.0).when(age > 10 * half_life, 0.0).otherwise(F.round(F.pow(F.lit(2.0), -age / half_life), 6))


def build_signals(signals: DataFrame, as_of: DataFrame, half_life: int = HALF_LIFE) -> DataFrame:
    """Signals as of each date with z_score, percentile and decay_weight."""
    known = Dates.of(as_of, "as_of")
    ranked_signals = _percentiles(signals, known).join(_statistics(signals, known), ["place", "signal_name"])
    return known.named(ranked_signals, "place", "as_of").select(
        "as_of", "ticker", "filing_id", "signal_name", "signal_date", "raw_value", _standardised().alias("z_score"), "percentile",
        decay_weight(F.col("as_of"), F.col("signal_date"), half_life).alias("decay_weight"),
    )


def active(signals: DataFrame) -> DataFrame:
    return signals.where("decay_weight > 0")


def weights_equal(signals: DataFrame) -> DataFrame:
    """(as_of, ticker, signal_name, weight): the ticker's active names alike."""
    names = active(signals).select("as_of", "ticker", "signal_name").distinct()
    return names.withColumn("weight", F.round(1 / F.count("*").over(W.partitionBy("as_of", "ticker")), 6))


def _given(signals: DataFrame, given: DataFrame) -> DataFrame:
    """(signal_name, weight) put to each ticker's active names; names not given weigh 0. ``given`` is a parameter."""
    names = active(signals).select("as_of", "ticker", "signal_name").distinct()
    return names.join(given, "signal_name", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def weights_ic(signals: DataFrame, ics: DataFrame) -> DataFrame:
    """|IC| of each name, to sum 1 per ticker; without any, equal."""
    w = W.partitionBy("as_of", "ticker")
    named = _given(signals, ics.select("signal_name", F.abs("ic").alias("weight")))
    total = F.sum("weight").over(w)
    return named.withColumn("weight", F.round(F.when(total > 0, F.col("weight") / total).otherwise(1 / F.count("*").over(w)), 6))


def weights_custom(signals: DataFrame, given: dict[str, float]) -> DataFrame:
    """Given weights over their absolute sum, signs kept; all zero gives equal ones."""
    if not given:
        raise ValueError("custom weights are empty")
    total = sum(map(abs, given.values()))
    if not total:
        return weights_equal(signals)
    rows = [(k, round(v / total, 6)) for k, v in given.items()]
    return _given(signals, signals.sparkSession.createDataFrame(rows, "signal_name string, weight double"))


def composite(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """(ticker, signal_date = as_of, composite_score, components, rank)."""
    keys = ["as_of", "ticker", "signal_name"]
    value = F.coalesce("z_score", "raw_value")
    oldest = F.min_by("decay_weight", F.struct("signal_date", "filing_id"))
    part = active(signals).groupBy(*keys).agg(
        F.sum(value * F.col("decay_weight")).alias("vd"), F.sum("decay_weight").alias("d"), oldest.alias("own")
    )
    weighed = part.join(weights, keys).where("weight <> 0")
    scored = weighed.groupBy("as_of", "ticker").agg(
        F.sum(F.col("weight") * F.col("vd")).alias("top"), F.sum(F.abs("weight") * F.col("d")).alias("bottom"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("signal_name", F.round(F.col("weight") * F.col("own"), 6))))
        ).alias("components"),
    ).where("bottom <> 0")
    score = F.round(F.col("top") / F.col("bottom"), 6).alias("composite_score")
    return composite_rank(scored.select("ticker", F.col("as_of").alias("signal_date"), score, "components"))


def composite_rank(composites: DataFrame) -> DataFrame:
    """``rank`` within each signal_date, 1 for the highest score, equal scores by ticker. A date of any size is ranked by
    all tasks (see ``ranks``)."""
    lines = ordered(composites, "composites", F.asc("signal_date"), F.desc("composite_score"), F.asc("ticker"))
    return ranked(lines, "signal_date").withColumn("k", F.col("k").cast("int")).withColumnRenamed("k", "rank")


def signal_counts_by_date(composites: DataFrame) -> DataFrame:
    return composites.groupBy("signal_date").agg(F.count("*").alias("n"))
