"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

The mix is to hold ``share`` of all words. Sources in code point order take the weights in turn; a target stops at ``cap``
times its source's size, and what is over is shared again by weight until none is above. Within a source every document
expects target / size copies. Documents stand in order of size, longest first; expected copies are summed along them, one
random offset per source is added, and a document is emitted once per integer that its stretch of the sum crosses. In
order of size the words taken differ from the target by less than the longest document.

On Spark: the sums run over places, and a place is a rank within the source: rows are ordered by range, counted per source
and range, and those counts (at most one per source and range) give the rank of every row, so a source of any size, or any
number of equal rows, is dealt over all tasks. The shared excess is a few aggregates over sources. Sums are exact
(decimals), and the offset is a digest of seed and source, so reruns agree.

Defined results: null texts have size 0, and a source without words has target and copies 0; the null source is one source,
the last; null doc_ids come last in their size; equal rows are documents of their own; texts are read whole; an empty table
gives no rows; columns named as new ones are replaced, other columns stay in ``mix`` and are ignored in ``report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ordered, ranked, stored

WEIGHTS = (5, 2, 1)
#: Words of the mix over all words, as a fraction; copies of a source at most.
SHARE, CAP = (3, 2), 2
SEED = 13
WORD = "[^\\x20\\x09-\\x0D]+"
NEW = ("size", "source_size", "target", "copies")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: tuple = SHARE, cap: int = CAP) -> DataFrame:
    """From (source, source_size): those, target, and copies of a document as a fraction (num, den)."""
    lines = ordered(sizes.select("source", "source_size"), "sources", F.asc_nulls_last("source"))
    weight = F.array(*[F.lit(w) for w in weights])[((F.col("k") - 1) % len(weights)).cast("int")]
    weighed = stored(ranked(lines).select("source", "source_size", weight.cast("long").alias("w")), "weighed")
    exact = lambda c: F.lit(c).cast("decimal(38,0)") if isinstance(c, int) else c.cast("decimal(38,0)")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    held, left, before = 0, weighed.agg(F.sum("w")).first()[0] or 1, None
    while (held, left) != before:  # words of sources that reached their stop, weight of the others
        before = held, left
        # target = w * (share * total - cap * held) / left, above cap * source_size
        rest = share[0] * total - share[1] * cap * held
        above = exact(F.col("w")) * exact(rest) > exact(F.col("source_size")) * exact(share[1] * cap * left)
        held, left = weighed.agg(
            F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(left))
        ).first()
    some = F.col("source_size") > 0
    num = F.when(above, exact(cap)).when(some, exact(F.col("w")) * exact(rest)).otherwise(exact(0))
    den = F.when(above | ~some, exact(1)).otherwise(exact(F.col("source_size")) * exact(share[1] * left))
    free = (exact(F.col("w")) * exact(rest)).cast("double") / F.lit(float(share[1] * left))
    return weighed.select(
        "source", "source_size", F.when(above, F.col("source_size") * cap).otherwise(free).cast("double").alias("target"),
        num.alias("num"), den.alias("den"),
    )


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: tuple = SHARE, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """From (doc_id, source, size and any columns): those columns with source_size, target (their source's) and copies."""
    carried = [c for c in docs.columns if c not in NEW]
    row = F.struct(*[F.col(f"`{c}`") for c in carried])
    rows = docs.select(
        row.alias("row"), F.col("source").cast("string").alias("source"), F.col("size").cast("long").alias("size"),
        F.col("doc_id").cast("string").alias("id"), F.xxhash64(row).alias("mark"), F.monotonically_increasing_id().alias("tie"),
    )
    order = (F.asc_nulls_last("source"), F.desc("size"), F.asc_nulls_last(F.col("id").try_cast("long")), F.asc("id"), F.asc("mark"), F.asc("tie"))
    lines = ordered(rows, "documents", *order).drop("id", "mark", "tie")
    share_of = targets(lines.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    # A digest's 32 bits over 2^32 are the offset.
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8), 16, 10)
    share_of = stored(share_of.withColumn("h", h.cast("decimal(38,0)")), "targets").toDF("of", "source_size", "target", "num", "den", "h")
    placed = ranked(lines, "source").join(share_of, F.col("source").eqNullSafe(F.col("of")))
    upto = lambda k: f"(h * den + cast({k} AS decimal(38,0)) * num * 4294967296) div (den * 4294967296)"
    return placed.select("row.*", "size", "source_size", "target", F.expr(f"{upto('k')} - {upto('k - 1')}").cast("long").alias("copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it has copies, numbered from 1 by ``copy``."""
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return mixed.where("copies > 0").select(*[f"`{c}`" for c in mixed.columns if c not in ("copies", "copy")], copies)


def report(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes of the document), per document."""
    sized = stored(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("text")), "sizes"
    )
    return mix(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS s FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, sum(s) OVER () AS total FROM s),
o AS (SELECT *, row_number() OVER r AS i, sum(s) OVER r - s AS held, sum(w) OVER () - sum(w) OVER r + w AS free FROM w WINDOW r AS (ORDER BY s * 10 // w, source)),
f AS (SELECT i, held, free, total FROM o WHERE NOT w * (3 * total - 4 * held) > 4 * s * free ORDER BY i LIMIT 1),
t AS (SELECT source, s AS source_size, CASE WHEN o.i < f.i THEN CAST(2 * s AS DOUBLE) ELSE CAST(w * (3 * f.total - 4 * f.held) AS DOUBLE) / CAST(2 * f.free AS DOUBLE) END AS target,
  CASE WHEN o.i < f.i THEN CAST(2 AS HUGEINT) WHEN s = 0 THEN CAST(0 AS HUGEINT) ELSE CAST(w * (3 * f.total - 4 * f.held) AS HUGEINT) END AS num,
  CASE WHEN o.i < f.i OR s = 0 THEN CAST(1 AS HUGEINT) ELSE CAST(2 * f.free * s AS HUGEINT) END AS den,
  CAST('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 8) AS HUGEINT) AS h FROM o, f),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id NULLS LAST) AS HUGEINT) AS k FROM d)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * ((h * den + k * num * 4294967296) // (den * 4294967296) - (h * den + (k - 1) * num * 4294967296) // (den * 4294967296)) AS BIGINT) AS taken
FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
"""
