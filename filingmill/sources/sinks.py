"""Upserts and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import last_of_key


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Old rows whose key is not in ``new``, and the last new row of each key, as one table. ``tables.KeyedTable`` merges into
    a stored table, by partition."""
    rows = last_of_key(new, key, order)
    return old.join(rows.select(*key), key, "left_anti").unionByName(rows)


def replace_sections(old: DataFrame, saved: DataFrame, new: DataFrame) -> DataFrame:
    """Sections after saving the filings of ``saved`` (filing_id): theirs go, also where ``new`` has none."""
    return old.join(saved.select("filing_id").distinct(), "filing_id", "left_anti").unionByName(new)


#: Bits of a key's place in the filter, and the filter's bytes at most; beyond them all rows meet the stored keys.
BITS_PER_KEY, FILTER_BYTES = 16, 64 << 20
#: Bits of one bitmap of the filter: what ``bitmap_construct_agg`` makes.
BITMAP = 32_768


def new_only(rows: DataFrame, done: DataFrame, key: list[str], bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """Rows whose key is not among the done ones; a key with a null is new.

    A bitmap of hashed done keys, sized by their count and broadcast, tells most new rows at once: these skip the exchange.
    Only rows whose bit is set meet the done keys in an exact anti join, so the result does not depend on the bitmap."""
    keys = done.select(*key)
    bits = -(-max(keys.count() * bits_per_key, 1) // BITMAP) * BITMAP
    if bits > FILTER_BYTES * 8:
        return rows.join(keys, key, "left_anti")
    place = F.pmod(F.xxhash64(*key), F.lit(bits))
    bitmaps = keys.select(place.alias("p")).groupBy((F.col("p") / BITMAP).cast("int").alias("__bucket")).agg(
        F.bitmap_construct_agg(F.pmod("p", F.lit(BITMAP))).alias("__bits")
    )
    met = rows.withColumn("__p", place).join(F.broadcast(bitmaps), (F.col("__p") / BITMAP).cast("int") == F.col("__bucket"), "left")
    at = F.pmod("__p", F.lit(BITMAP))
    byte = F.conv(F.hex(F.substr("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    known = F.coalesce(F.getbit(byte.cast("long"), (at % 8).cast("int")) == 1, F.lit(False))
    marked = met.withColumn("__known", known)
    surely = marked.where(~F.col("__known")).select(rows.columns)
    perhaps = marked.where("__known").select(rows.columns)
    return surely.unionByName(perhaps.join(keys, key, "left_anti"))


#: Component names are as many as analyzers times sections; a file of more columns than this raises an error.
MAX_COLUMNS = 10_000


def signals_wide(composites: DataFrame) -> DataFrame:
    """Composites with one column per component name."""
    names = [
        r[0]
        for r in composites.select(
            F.explode(F.map_keys("components")).alias("k")
        ).distinct().orderBy("k").limit(MAX_COLUMNS + 1).collect()
    ]
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"over {MAX_COLUMNS} component names")
    return composites.select("ticker", "signal_date", "composite_score", "rank", *[F.col("components")[n].alias(n) for n in names])


def write_signals_csv(composites: DataFrame, path: str) -> None:
    signals_wide(composites).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def write_signals_json(composites: DataFrame, path: str) -> None:
    composites.write.mode("overwrite").json(path)


def backtest_report(period_returns: DataFrame, metrics: DataFrame, counts: DataFrame) -> DataFrame:
    """JSON rows (``report``): period rows, metrics, and composites per date. Of a sweep, where periods and metrics have
    ``strategy_id``, one row per strategy with what is its own; so no row holds more than a calendar's dates."""
    key = [c for c in ("strategy_id",) if c in period_returns.columns and c in metrics.columns]
    order = ["period_start", *[c for c in period_returns.columns if c not in ("period_start", *key)]]
    periods = period_returns.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("periods"))
    measured = metrics.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*metrics.columns))).alias("metrics"))
    dates = counts.agg(F.array_sort(F.collect_list(F.struct("signal_date", "n"))).alias("signals"))  # one row
    met = periods.join(measured, key) if key else periods.join(measured)
    return met.join(F.broadcast(dates)).select(*key, F.to_json(F.struct("periods", "metrics", "signals")).alias("report"))


def write_backtest_json(report: DataFrame, path: str) -> None:
    report.select("report").write.mode("overwrite").text(path)
