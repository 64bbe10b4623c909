"""Near-duplicate vectors by p-stable hashing.

Equal vectors of one label become one class with a weight (counted with partial aggregation, so a vector that
a third of all rows hold is one row afterwards). Unit vectors are hashed by quantised Gaussian projections:
``K`` of them make a key, ``TABLES`` keys make the tables. Rows of one key meet in a task, which reads them as
a sorted stream and computes exact cosines block by block; a pair that meets in several tables is counted in
the first only, so no pair is ever a row: each task returns, per vector, a number of links and the smallest
vector it is joined to. Keys with more than ``BLOCK`` rows are split into blocks, each pair of blocks its own
key, so a hot key spreads over tasks and no link is lost.

With WIDTH 2, K 10 and TABLES 24, a pair of cosine exactly 0.93 shares a key in some table with probability
0.995, one of 0.97 with 0.99998.

Defined results: null, zero and non-finite vectors and null labels link with nothing; vectors of different
lengths never link; repeated rows count as other vectors; a vec_id should name one vector: different vectors whose
smallest vec_id is the same are one node, with the sum of their links and one component; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored

COSINE = 0.93
WIDTH, K, TABLES, SEED = 2.0, 10, 24, 7
BLOCK = 2000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one length as unit vectors in double precision; lengths before, up to the power of two that keeps
    squares of very large or small components finite."""
    x = np.array(rows, np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    norm = np.sqrt((x * x).sum(axis=1))
    return x / norm[:, None], norm


def hash_keys(x: np.ndarray) -> np.ndarray:
    """One 64-bit key per unit vector and table."""
    rng = np.random.default_rng([SEED, x.shape[1]])
    a = rng.standard_normal((x.shape[1], K * TABLES))
    b = rng.uniform(0, WIDTH, K * TABLES)
    cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(x), TABLES, K)
    key = np.zeros((len(x), TABLES), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(K):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k].astype(np.uint64))
    return key.view(np.int64)


def _hash(vectors: pa.Array) -> pa.Array:
    out: list = [None] * len(vectors)
    by_length: dict[int, list[int]] = {}
    rows = vectors.to_pylist()
    for i, v in enumerate(rows):
        by_length.setdefault(len(v), []).append(i)
    for at in by_length.values():
        for i, key in zip(at, hash_keys(unit([rows[i] for i in at])[0]), strict=True):
            out[i] = key
    return pa.array(out, pa.list_(pa.int64()))


def _group(ids, weights, sides, keys, vectors, t, cosine):
    """Links of one bucket, of pairs that meet in no earlier table: per row a weighted count and the smallest id it is joined to."""
    n = len(ids)
    first, second = [], []
    for at in range(0, n, 512):
        i, j = np.nonzero(vectors[at : at + 512] @ vectors.T >= cosine)
        i += at
        keep = (i < j) & ((sides[i] != sides[j]) if sides.any() else True)
        i, j = i[keep], j[keep]
        fresh = ~(keys[i, :t] == keys[j, :t]).any(axis=1)
        first.append(i[fresh])
        second.append(j[fresh])
    i, j = np.concatenate(first), np.concatenate(second)
    counts = np.zeros(n, np.int64)
    np.add.at(counts, i, weights[j])
    np.add.at(counts, j, weights[i])
    to = ids.copy()
    while i.size:
        least = np.minimum(to[i], to[j])
        if (least == to[i]).all() and (least == to[j]).all():
            break
        np.minimum.at(to, i, least)
        np.minimum.at(to, j, least)
    return counts, to


def _links(cosine: float):
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])
    number = lambda c: c.to_numpy(zero_copy_only=False)

    def groups(rows: pa.RecordBatch, final: bool):
        """Results of all whole buckets of ``rows``, and the rows of the last, which may go on."""
        by = np.column_stack([number(rows[c]) for c in ("label", "t", "key", "block", "dims")])
        starts = np.flatnonzero(np.r_[True, (by[1:] != by[:-1]).any(axis=1)]) if len(by) else np.array([], int)
        ends = np.r_[starts[1:], len(by)]
        if not final:
            rest, starts, ends = rows.slice(starts[-1]), starts[:-1], ends[:-1]
        ids, weights, sides, dims = (number(rows[c]) for c in ("rep", "weight", "side", "dims"))
        keys = number(rows["keys"].flatten()).reshape(-1, TABLES)
        flat, at = number(rows["embedding"].flatten()), np.r_[0, np.cumsum(dims)]
        found = []
        for a, b in zip(starts, ends, strict=True):
            if b - a > 1:
                x = unit(flat[at[a] : at[b]].reshape(b - a, -1))[0]
                counts, to = _group(ids[a:b], weights[a:b], sides[a:b], keys[a:b], x, int(by[a, 1]), cosine)
                some = np.flatnonzero((counts > 0) | (to != ids[a:b]))
                found.append((ids[a:b][some], counts[some], to[some]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.array([], np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema), None if final else rest

    def run(batches):
        rest = None
        for batch in batches:
            if batch.num_rows:
                both = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
                made, rest = groups(both, final=False)
                yield made
        if rest is not None:
            yield groups(rest, final=True)[0]

    return run


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label")
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & some, F.lit(False))
    mark = F.when(usable, F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.reverse("embedding"), F.lit(1)).alias("b")))  # 128 bits of the vector
    marked = stored(rows.select("vec_id", "label", "embedding", mark.alias("mark")), "vectors")
    good = marked.where("mark is not null")
    classes = good.groupBy("label", "mark").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")
    )
    hashed = F.arrow_udf(_hash, "array<bigint>").asNondeterministic()
    classes = stored(
        classes.select(
            "label", "mark", "rep", "weight", F.col("embedding").cast("array<float>").alias("short"), "embedding",
            hashed("embedding").alias("keys")
        ),
        "classes"
    )
    # Floats are what tables hold; doubles are carried only where a float would change the value.
    exact = F.transform("short", lambda x: x.cast("double")) == F.col("embedding")
    keyed = classes.select(
        "label", "rep", "weight", F.when(exact, F.col("short")).alias("short"), F.when(~exact, F.col("embedding")).alias("long"), "keys",
        F.size("embedding").alias("dims"), F.posexplode("keys").alias("t", "key"),
    )
    hot = classes.select(
        "label", F.size("embedding").alias("dims"), F.posexplode("keys").alias("t", "key")
    ).groupBy("label", "dims", "t", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    hot = stored(hot.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "hot")
    on = ["label", "dims", "t", "key"]
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    spread = keyed.join(hot.select(*on, "blocks"), on, "left")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, mine).alias("x"), F.greatest(o, mine).alias("y"))
    )
    spread = spread.withColumn(
        "b",
        F.explode(
            F.when(F.col("blocks") > 1, pairs).otherwise(F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))))
        )
    )
    spread = spread.select(
        *on, (F.col("b.x") * 100_000_000 + F.col("b.y")).cast("long").alias("block"),
        F.when(F.col("b.x") == F.col("b.y"), F.lit(0)).otherwise(mine).alias("side"),
        "rep", "weight", "keys", F.coalesce(F.col("long"), F.transform("short", lambda x: x.cast("double"))).alias("embedding"),
    )
    by = ["label", "t", "key", "block", "dims"]
    spark = embeddings.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = spread.repartition(n, *by).sortWithinPartitions(*by).mapInArrow(_links(cosine), "rep bigint, links bigint, to bigint")
    met = stored(met, "links")
    linked = met.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(met.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    per_class = (
        classes.select("label", "mark", "rep", "weight").join(linked, "rep", "left").join(
            joined.withColumnRenamed("id", "rep"), "rep", "left"
        )
        .select(
            "label", "mark", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id")
        )
    )
    result = marked.select("vec_id", "label", "mark").join(per_class, ["label", "mark"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return result.withColumn("kept", F.col("vec_id") == F.col("component_id"))


# DuckDB on the small tables: exact cosines of all pairs of a label, components by recursion.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a AS id, b AS c FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT id, least(id, min(c)) AS c FROM r GROUP BY id), n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN m ON m.id = vec_id LEFT JOIN n ON n.id = vec_id
"""
