"""Helpers that several corpus operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingmill.operators.ranks import ordered, ranked
from filingmill.sources.store import cut, delete, scratch, small_batches, stored, written

__all__ = ["components", "cut", "ordered", "ranked", "replaced", "scratch", "small_batches", "stored", "table", "union_all"]
#: Parts into which the edges of one node are dealt in joins.
SALTS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def replaced(df: DataFrame, name: str, before: str | None) -> tuple[DataFrame, str]:
    """The rows stored, and where; the table ``before``, from which they were made, goes."""
    spark = df.sparkSession
    path = written(df, name)
    if before:
        delete(spark, before)
    return spark.read.schema(df.schema).parquet(path), path


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (id, component) per node of an edge, component = its smallest id.

    Large-star / small-star contraction. A hub's minimum is combined before it is shuffled, and its edges meet that
    minimum under SALTS salts; the lineage is cut after every round.
    """
    spread = lambda rows: rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    copied = lambda rows: rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges)
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of u moves to the smallest of u's neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = spread(both).join(copied(least), ["u", "salt"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u's smaller neighbours and u itself move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = spread(large).join(copied(least), ["u", "salt"])
        edges = cut(
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
