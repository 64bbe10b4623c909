"""Labelled rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documented bound of the fitting sample, in labelled rows; all other work covers all rows.
SAMPLE = 12_000


def fold(doc_id: Column, mod: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod))


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y): at most ``bound`` labelled documents, those of least hash, so the choice does not
    depend on order or on the labels. A document with several labels has the largest, an id with several texts the
    last by code point, so rows are bounded too. The ids are broadcast: their number is bounded."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")
    )
    chosen = known.where(usable).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text")).select("doc_id", "text", "y")
