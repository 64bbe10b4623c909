"""Validation as expressions: rows get ``valid``; callers split by it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from filingmill.functions.text import dashed_accession, pad_cik, word_count
from filingmill.schemas import FORM_TYPES


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine)."""
    return checked.where("valid").drop("valid"), checked.where(~F.col("valid"))


class Quarantine(NamedTuple):
    """Rows by validity, read back from where one pass wrote them, and how many there are of each."""

    valid: DataFrame
    bad: DataFrame
    n_valid: int
    n_bad: int


def quarantine(checked: DataFrame, path: str) -> Quarantine:
    """Writes checked rows once, by ``valid``, and counts them on the way: the input is read a single time, whatever is done
    with the two parts afterwards. Rows whose validity is null are bad."""
    seen = Observation()
    good = F.coalesce(F.col("valid"), F.lit(False))
    counts = (F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(name) for name, c in (("n_valid", good), ("n_bad", ~good)))
    rows = checked.withColumn("valid", good)
    rows.observe(seen, *counts).withColumn("kept", F.when(F.col("valid"), "valid").otherwise("bad")).write.partitionBy("kept").parquet(path)
    back = checked.sparkSession.read.schema(rows.withColumn("kept", F.lit("")).schema).parquet(path)
    parts = (back.where(F.col("kept") == name).drop("kept") for name in ("valid", "bad"))
    valid, bad = parts
    return Quarantine(valid.drop("valid"), bad, seen.get["n_valid"], seen.get["n_bad"])


def _all(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def validate_filings(rows: DataFrame) -> DataFrame:
    accession = dashed_accession(F.col("accession_number"))
    good = _all(
        F.col("cik").rlike("^[0-9]+$"), accession.isNotNull(), F.col("url").startswith("https://"),
        F.col("form_type").isin(*FORM_TYPES)
    )
    return rows.withColumns({"valid": good, "cik": pad_cik(F.col("cik")), "accession_number": F.coalesce(accession, "accession_number")})


_BOUNDS = {
    "sentiment_score": (-1, 1), "confidence": (0, 1), "similarity_score": (0, 1), "percentile": (0, 100), "decay_weight": (0, 1),
}


def validate_scores(rows: DataFrame) -> DataFrame:
    """Bounds of the score columns that ``rows`` has; percentiles may be null, ranks start at 1, change is 1 - similarity."""
    conditions = []
    for c, (low, high) in _BOUNDS.items():
        if c in rows.columns:
            inside = F.col(c).between(low, high)
            conditions.append(inside | F.col(c).isNull() if c == "percentile" else inside)
    if {"similarity_score", "change_score"} <= set(rows.columns):
        conditions.append(F.abs(F.col("change_score") - (1 - F.col("similarity_score"))) <= 1e-5)
    if "rank" in rows.columns:
        conditions.append(F.col("rank").isNull() | (F.col("rank") >= 1))
    rounded = {c: F.round(c, 6) for c in ("sentiment_score", "confidence", "similarity_score", "change_score") if c in rows.columns}
    return rows.withColumn("valid", _all(*conditions)).withColumns(rounded)


def validate_bars(bars: DataFrame) -> DataFrame:
    good = _all(F.col("volume") >= 0, F.col("high") >= F.col("low"))
    return bars.withColumns({"valid": good, "adjusted_close": F.coalesce("adj_close", "close")})


def word_count_drift(sections: DataFrame) -> DataFrame:
    """Adds counted words and whether the stored count is more than a tenth off."""
    n = word_count(F.col("raw_text"))
    return sections.withColumn("counted", n).withColumn(
        "drifted", (F.col("counted") > 0) & (F.abs(F.col("word_count") - F.col("counted")) > 0.1 * F.col("counted"))
    )
