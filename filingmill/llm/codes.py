"""Vector code compression: one byte per part of a vector, by active-entry Lloyd.

Vectors become integers and are cut into PARTS equal parts; each part position has a codebook of ENTRIES entries. A row
keeps, per part, its entry and the exact squared distance to it. In a round, a part whose entry stayed where it was is
compared only with the entries that moved; another part looks at all of them. Both take the lower index among equals, so
each round gives what a full search would.

On Spark: a round is one pass over a stored table, without a shuffle, that writes the rows with their new state and one
row per task with the sums and counts of every entry (a fixed number of integers, added up by Spark). Integer sums do not
depend on order, so lost tasks are simply run again. The table before is deleted once the next is written; the driver
holds the codebooks alone.

Defined results: vectors that are null or hold null or non-finite components are dropped; shorter vectors, and lengths
that PARTS does not divide, are filled up with zeros to the longest; integers stop at 2^24 on either side (components of
4096), so that distances of up to 8,192 components stay below 2^63; fewer than ENTRIES vectors make smaller codebooks;
a null vec_id sorts last; equal vec_ids sort by vector; repeated rows each have a code; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import replaced

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMIT = 2**24
#: Rows that a task compares at a time.
ROWS = 4096


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lower of equals) and squared distance, for rows of one part."""
    distances = np.stack([((x - entry) ** 2).sum(axis=1) for entry in book], axis=1)
    entries = distances.argmin(axis=1)
    return entries, distances[np.arange(len(x)), entries]


def active(x: np.ndarray, book: np.ndarray, moved: np.ndarray, entries: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``nearest``, given the entry and distance of each row before the entries ``moved``."""
    entries, distances = entries.copy(), distances.copy()
    lost = moved[entries]
    stay = np.flatnonzero(~lost)
    if stay.size:
        there, best, mine = x[stay], distances[stay], entries[stay]
        for j in np.flatnonzero(moved):
            d = ((there - book[j]) ** 2).sum(axis=1)
            nearer = (d < best) | ((d == best) & (j < mine))
            best, mine = np.where(nearer, d, best), np.where(nearer, j, mine)
        entries[stay], distances[stay] = mine, best
    if lost.any():
        entries[lost], distances[lost] = nearest(x[lost], book)
    return entries, distances


def _round(books: np.ndarray, moved: np.ndarray, schema: pa.Schema, width: int):
    """One pass: rows with their entries and distances, and at last the task's sums and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS, books.shape[1], width + 1), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n, column = batch.num_rows, batch["ints"]
                sizes = np.diff(column.offsets.to_numpy())
                x = np.zeros((n, PARTS * width), np.int64)
                x[np.arange(PARTS * width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
                x = x.reshape(n, PARTS, width)
                known = batch["entries"].null_count == 0
                old = [batch[c].flatten().to_numpy(zero_copy_only=False).reshape(n, PARTS).astype(np.int64) for c in ("entries", "distances")] if known else None
                entries, distances = np.empty((n, PARTS), np.int64), np.empty((n, PARTS), np.int64)
                for p in range(PARTS):
                    part = x[:, p]
                    if old is None:
                        entries[:, p], distances[:, p] = nearest(part, books[p])
                    else:
                        entries[:, p], distances[:, p] = active(part, books[p], moved[p], old[0][:, p], old[1][:, p])
                    np.add.at(sums[p, :, :width], entries[:, p], part)
                    sums[p, :, width] += np.bincount(entries[:, p], minlength=books.shape[1])
                lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, n * PARTS + 1, PARTS), pa.int32()), pa.array(a.ravel(), kind))
                made = {
                    "vec_id": batch["vec_id"], "label": batch["label"], "ints": column, "entries": lists(entries, pa.int8()),
                    "distances": lists(distances, pa.int64()), "sums": pa.nulls(n, pa.list_(pa.int64()))
                }
                yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) for f in schema], schema=schema)
        last = {"sums": pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))}
        yield pa.RecordBatch.from_arrays([last.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)

    return run


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label, entries, distances) of all kept vectors, and the codebooks (part, entry, component)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = embeddings.sparkSession
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int")
    rows = embeddings.where(vector.isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(vector, whole).alias("ints")
    )
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    blank = rows.select("*", none("entries", "array<tinyint>"), none("distances", "array<bigint>"), none("sums", "array<bigint>"))
    state, path = replaced(blank, "vectors", None)
    longest = state.agg(F.max(F.size("ints"))).first()[0]
    width = max(1, -(-(longest or 0) // PARTS))
    seeds = state.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(ENTRIES).select("ints").collect()
    books = np.zeros((PARTS, len(seeds), width), np.int64)
    for j, (ints,) in enumerate(seeds):
        flat = np.zeros(PARTS * width, np.int64)
        flat[: len(ints)] = ints
        books[:, j] = flat.reshape(PARTS, width)
    if not seeds:
        return state.select("vec_id", "label", "entries", "distances"), books

    moved, schema = np.ones(books.shape[:2], bool), to_arrow_schema(state.schema)
    for k in range(rounds + 1):
        made = state.where("sums is null").mapInArrow(_round(books, moved, schema, width), state.schema)
        state, path = replaced(made, "codes", path)
        if k < rounds:
            added = state.where("sums is not null").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
            totals = np.zeros(PARTS * len(seeds) * (width + 1), np.int64)
            for pos, n in added:
                totals[pos] = n
            totals = totals.reshape(PARTS, len(seeds), width + 1)
            counts = totals[:, :, width:]
            after = np.where(counts > 0, totals[:, :, :width] // np.maximum(counts, 1), books)
            books, moved = after, (after != books).any(axis=2)
    return state.where("sums is null").select("vec_id", "label", "entries", "distances"), books


def decoded(entries: list[int], books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([books[p, e] for p, e in enumerate(entries)]) / SCALE


def report(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and the digest of the codebooks, per kept vector."""
    rows, books = compress(embeddings)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = rows.select(
        "vec_id", "label", F.array_join(F.transform("entries", lambda e: F.lpad(F.lower(F.hex(e.cast("int"))), 2, "0")), "").alias("code"),
        F.aggregate("distances", F.lit(0).cast("long"), lambda a, d: a + d).alias("error"),
    )
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """DuckDB: every round compares everything."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT id, part, min({{'d': CAST(list_sum(list_transform(x, lambda v, i: (v - c[i]) * (v - c[i]))) AS BIGINT), 'j': j}}) AS best "
            f"FROM p JOIN b{r} USING (part) GROUP BY id, part)"
        )
        if r < ROUNDS:
            steps.append(
                f"m{r} AS (SELECT part, j, list(v ORDER BY k) AS c FROM (SELECT part, j, k, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS v "
                f"FROM (SELECT p.part, best.j AS j, unnest(x) AS v, unnest(range(len(x))) AS k FROM p JOIN a{r} ON a{r}.id = p.id AND a{r}.part = p.part) GROUP BY part, j, k) GROUP BY part, j)"
            )
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b{r}.part, b{r}.j, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} ON m{r}.part = b{r}.part AND m{r}.j = b{r}.j)")
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS id, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT id, part, list_transform(e[part * len(e) // {PARTS} + 1 : (part + 1) * len(e) // {PARTS}], lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS x
  FROM k, (SELECT unnest(range({PARTS})) AS part)),
b0 AS MATERIALIZED (SELECT part, id AS j, x AS c FROM p WHERE id < {ENTRIES}),
{(", " + chr(10)).join(steps)},
f AS (SELECT id, string_agg(printf('%02x', best.j), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY id),
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, j)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN f USING (id), s
"""


SQL = _sql()
