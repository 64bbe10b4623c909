"""Near-duplicate documents by Order MinHash.

A document is its words' five-word shingles, each labelled with its occurrence number, so that repeated
shingles are different. In each of TABLES tables a random order picks the L smallest labelled shingles, which
are kept in text order: two texts agree only if they share those shingles and have them in the same order,
which follows edit similarity. A pair of documents of similarity 0.8 agrees in a table with probability of
about 0.64; it agrees in none of the ten, and is missed, with 4e-5.

Texts of equal words are one class (partial aggregation on a 128-bit digest). Class members meet in buckets
(table, key), and every bucket is compared whole: a task reads it as a sorted stream and tries each pair that
agrees in no earlier table and that its links have not joined yet, so a group of copies takes about one
comparison a row and pairs are never rows. Buckets whose rows all share an earlier key are left out, as all their
pairs are tried there.

A hot bucket, of more than BLOCK rows or WORDS shingles, goes in blocks and three steps. Each block is compared by
itself, which sends a text once. Then one row of each class found so far stands for it, and these are compared, which
joins what copies the blocks share. What is still apart is compared row by row: all rows outside a bucket's largest
class among themselves and with the largest class, in pairs of blocks; so a row of the largest class is sent once per
block of the others, and only where there are any. No pair of rows of different classes is left out.

A pair is a link if banded alignment finds it similar: labelled shingles are aligned in order (longest
increasing chain) within a band around the diagonal; similarity is aligned / (all - aligned), at least 0.8.
Any pair that similar lies inside the band. Classes are the components of links, named by the smallest doc_id.

Defined results: null and word-free texts are each their own class and never link; texts of fewer than five
words are one shingle; repeated rows share a class; very long texts are compared whole, their shingles in one task at a
time; an empty table gives an empty result; extra columns pass through ``deduplicate`` and are ignored otherwise.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, small_batches, stored
from .decontamination import words_of

SHINGLE, SIMILARITY = 5, 0.8
TABLES, L = 10, 2
#: Rows and shingles of a bucket that one task compares; larger buckets go in pairs of blocks.
BLOCK, WORDS = 2000, 4_000_000
CACHE = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_known: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_known) > CACHE:
        _known.clear()
    codes = list(map(_known.get, words))
    if None in codes:
        for i, c in enumerate(codes):
            if c is None:
                codes[i] = _known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    return np.array(codes, np.uint64)


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles, in text order."""
    h = word_hashes(words)
    n = max(1, len(h) - SHINGLE + 1)
    s = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        s = mix(s * _ODD + h[k : k + n])
    order = np.argsort(s, kind="stable")
    run = s[order]
    new = np.r_[True, run[1:] != run[:-1]]
    if not new.all():
        at = np.flatnonzero(new)
        label = np.empty(n, np.uint64)
        label[order] = (np.arange(n) - np.repeat(at, np.diff(np.r_[at, n]))).astype(np.uint64)
        s = np.where(label > 0, mix(s + label * _ODD), s)
    return s


def sketch(s: np.ndarray) -> list[int]:
    """For each table the key of its L smallest shingles in text order."""
    out = []
    for t in range(TABLES):
        x = mix(s ^ mix(np.uint64(t + 1) * _ODD))
        near = np.argpartition(x, L - 1)[:L] if x.size > L else np.arange(x.size)
        key = np.uint64(t)
        for i in sorted(near):
            key = mix(key * _ODD + x[i])
        out.append(int(key))
    return out


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned labelled shingles / all, or 0 where it cannot reach ``least``."""
    if min(a.size, b.size) < least * max(a.size, b.size):
        return 0.0
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    total = a.size + b.size
    if both.size < least * (total - both.size):
        return 0.0
    band = total - 2 * int(np.ceil(least * total / (1 + least) - 1e-9))  # a chain that long cannot leave it
    inside = np.abs(i - j) <= band
    i, j = i[inside], j[inside]
    j = j[np.argsort(i, kind="stable")]
    if (np.diff(j) > 0).all():
        chain = j.size
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        chain = len(tails)
    return chain / (total - chain) if total > chain else 1.0


SKETCH = "struct<digest:binary,size:int,keys:array<bigint>>"


def digest_of(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _sketches(texts: pa.Array) -> pa.Array:
    out = []
    with np.errstate(over="ignore"):
        for data in texts.cast(pa.binary()).to_pylist():
            words = words_of(data)
            if not words:
                out.append(None)
                continue
            s = shingles(words)
            out.append({"digest": digest_of(words), "size": s.size, "keys": np.array(sketch(s), np.uint64).view(np.int64)})
    return pa.array(out, pa.struct([("digest", pa.binary()), ("size", pa.int32()), ("keys", pa.list_(pa.int64()))]))


def links_of(
    texts: list[np.ndarray], keys: np.ndarray, sides: np.ndarray, t: int, least: float = SIMILARITY, classes: list | None = None
) -> list[tuple[int, int]]:
    """Links that join all similar pairs of one bucket of table ``t``; of two blocks, pairs across them only. Rows of one of
    ``classes`` are joined already."""
    n, sizes, found = len(texts), np.array([x.size for x in texts]), []
    across = sides.any()
    part = np.arange(n) if classes is None else np.unique(np.array(classes), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    codes = np.unique(np.concatenate(texts), return_inverse=True)[1] if n > 8 else None
    marks = np.zeros(0 if codes is None else int(codes.max()) + 1, np.int64)
    for i in range(1, n):
        tried = ~(keys[:i, :t] == keys[i, :t]).any(axis=1)
        tried &= np.minimum(sizes[:i], sizes[i]) >= least * np.maximum(sizes[:i], sizes[i])
        if across:
            tried &= sides[:i] != sides[i]
        at = np.flatnonzero(tried & (part[:i] != part[i]))
        if codes is not None and at.size:  # shared shingles of all rows at once; too few cannot be similar
            own = codes[ends[i - 1] : ends[i]]
            marks[own] = 1
            both = np.add.reduceat(marks[codes[: ends[i - 1]]], np.r_[0, ends[: i - 1]])[at]
            marks[own] = 0
            order = np.argsort(-both, kind="stable")
            at = at[order][(both >= least * (sizes[at] + sizes[i] - both))[order]]
        for j in at.tolist():
            if part[j] != part[i] and similarity(texts[i], texts[j], least) >= least:
                found.append((j, i))
                part[part == part[i]] = part[j]
    return found


def _links(least: float):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        bucket, rows = None, {}
        found: list[tuple[bytes, bytes]] = []

        def close():
            if len(rows) > 1:
                ids, (keys, sides, classes, texts) = list(rows), zip(*rows.values(), strict=True)
                pairs = links_of(list(texts), np.array(keys, np.int64), np.array(sides), bucket[0], least, list(classes))
                found.extend((ids[i], ids[j]) for i, j in pairs)

        with np.errstate(over="ignore"):
            for batch in batches:
                columns = (batch[c].to_pylist() for c in ("t", "key", "block", "side", "digest", "keys", "class"))
                for k, (t, key, block, side, digest, keys, joined) in enumerate(zip(*columns, strict=True)):
                    if (t, key, block) != bucket:
                        close()
                        bucket, rows = (t, key, block), {}
                    if digest not in rows:
                        words = words_of(batch["text"][k].cast(pa.binary()).as_py())
                        if digest_of(words) == digest:  # another text can have the same document id
                            rows[digest] = (keys, side, joined, shingles(words))
                a, b = zip(*found, strict=True) if found else ((), ())
                found.clear()
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)
            close()
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)

    return run


def bucketed(classes: DataFrame) -> DataFrame:
    """Rows (t, key, blocks, digest, rep, keys, size) of all buckets in which some pair meets for the first time; ``blocks`` is
    how many a bucket takes."""
    met = classes.select("size", F.posexplode("keys").alias("t", "key")).groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    inside = classes.select("digest", F.posexplode("keys").alias("t", "key")).join(met.drop("n"), ["t", "key"])
    shared = stored(inside.join(classes, "digest"), "shared")
    least, most = (
        [f(F.element_at("keys", j + 1)).alias(f"{name}{j}") for j in range(TABLES - 1)]
        for f, name in ((F.min, "least"), (F.max, "most"))
    )
    stats = shared.groupBy("t", "key").agg(F.count("*").alias("n"), F.sum("size").alias("words"), *least, *most)
    earlier = [(F.lit(j) < F.col("t")) & (F.col(f"least{j}") == F.col(f"most{j}")) for j in range(TABLES - 1)]
    stats = stored(stats.where(~reduce(or_, earlier)).select("t", "key", _blocks().alias("blocks")), "buckets")
    return shared.join(stats, ["t", "key"]).select("t", "key", "blocks", "digest", "rep", "keys", "size")


def _blocks(n: str = "n", words: str = "words") -> Column:
    return F.ceil(F.greatest(F.col(n) / BLOCK, F.col(words) / WORDS)).cast("int")


def _in_pairs(rows: DataFrame, largest: Column) -> DataFrame:
    """Rows of hot buckets once per pair of blocks in which they meet: those that are not of the ``largest`` class are dealt
    into blocks that meet each other and all blocks of the largest, whose blocks do not meet each other."""
    sizes = rows.groupBy("t", "key").agg(*[
        f(F.when(largest == side, c)).alias(f"{name}{int(side)}") for side in (True, False) for f, c, name in ((F.count, F.lit(1), "n"), (F.sum, F.col("size"), "words"))
    ])
    counts = [F.coalesce(_blocks(f"n{side}", f"words{side}"), F.lit(0)).alias(f"blocks{side}") for side in (0, 1)]
    spread = rows.join(sizes.select("t", "key", *counts), ["t", "key"])
    mine = F.when(largest, F.col("blocks0") + F.pmod(F.xxhash64("digest"), F.col("blocks1"))).otherwise(F.pmod(F.xxhash64("digest"), F.col("blocks0"))).cast("int")
    # Blocks of the others come first; one of the largest class meets those only.
    others = F.when(F.col("mine") < F.col("blocks0"), F.col("blocks0") + F.col("blocks1")).otherwise(F.col("blocks0"))
    meets = F.when(others > 0, F.sequence(F.lit(0), others - 1)).otherwise(F.array().cast("array<int>"))
    spread = spread.withColumn("mine", mine).withColumn("other", F.explode(meets))
    x, y = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when((x < y) & (F.col("mine") == y), 1).otherwise(0)
    return spread.select("t", "key", (x.cast("long") * F.lit(1 << 32) + y).alias("block"), side.alias("side"), "digest", "rep", "keys", "class")


def _compared(rows: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    by = ["t", "key", "block"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.join(texts.hint("merge"), "rep").drop("rep").repartition(n, *by).sortWithinPartitions(*by)
    return stored(met.mapInArrow(_links(least), "a binary, b binary"), "links")


def links(classes: DataFrame, source: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between digests, whose components are those of all similar pairs. ``source``: rep, text."""
    rows = stored(bucketed(classes), "bucketed")
    # Merge joins whatever the sizes: moving the texts costs the same share of any input.
    texts = source.join(rows.select("rep").distinct().hint("merge"), "rep", "left_semi")
    texts = texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["rep", "h"]).drop("h")
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("long")
    alone = rows.select("t", "key", block.alias("block"), F.lit(0).alias("side"), "digest", "rep", "keys", F.col("digest").alias("class"))
    found = _compared(alone, texts, least)
    hot = rows.where("blocks > 1")
    if hot.isEmpty():
        return found
    hot = stored(hot, "hot")

    def classed(known: DataFrame) -> DataFrame:
        parts = components(known).select(F.col("id").alias("digest"), F.col("component").alias("class"))
        return stored(hot.join(parts, "digest", "left").withColumn("class", F.coalesce("class", "digest")), "classed")

    of_class = classed(found).groupBy("t", "key", "class").agg(F.min_by(F.struct("digest", "rep", "keys", "size"), "digest").alias("r"))
    found = found.unionByName(_compared(_in_pairs(of_class.select("t", "key", "class", "r.*"), F.lit(False)), texts, least))
    now = classed(found)
    counts = now.groupBy("t", "key", "class").agg(F.count("*").alias("n"))
    largest = counts.groupBy("t", "key").agg(F.max(F.struct("n", "class"))["class"].alias("largest"), F.count("*").alias("classes"))
    apart = now.join(largest.where("classes > 1").drop("classes"), ["t", "key"])
    return found.unionByName(_compared(_in_pairs(apart, F.col("class") == F.col("largest")), texts, least))


def _classed(docs: DataFrame, least: float) -> DataFrame:
    """doc_id, h (hash of the text), component (null without words), class_id, kept for every document."""
    small_batches(docs.sparkSession)
    sketched = F.arrow_udf(_sketches, SKETCH).asNondeterministic()
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), sketched(F.col("text")).alias("s"))
    marked = stored(marked.select("doc_id", "h", "s.*"), "sketches")
    classes = marked.where("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("keys").alias("keys")
    )
    classes = stored(classes, "classes")
    parts = components(links(classes, docs.select(F.col("doc_id").cast("long").alias("rep"), "text"), least))
    classed = classes.select("digest", "rep").join(
        parts.withColumnRenamed("id", "digest"), "digest", "left"
    ).withColumn("component", F.coalesce("component", "digest"))
    named = classed.groupBy("component").agg(F.min("rep").alias("class_id"))
    classed = classed.join(named, "component").select("digest", "component", "class_id")
    result = marked.select("doc_id", "h", "digest").join(classed, "digest", "left").select(
        "doc_id", "h", "component", F.coalesce("class_id", "doc_id").alias("class_id")
    )
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, kept for every document."""
    return _classed(docs, least).select("doc_id", "class_id", "kept")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each class, with its own columns: rows of one id but different classes all stay, repeated rows once."""
    marked = _classed(docs.select("doc_id", "text"), SIMILARITY).where("kept and doc_id is not null")
    worded = marked.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("m")).select("m.*")
    kept = worded.unionByName(marked.where("component is null").select("doc_id", "h")).distinct()
    kept = kept.select(F.col("doc_id").alias("__kept"), F.col("h").alias("__h"))
    lone = docs.where("doc_id is null")
    same = (F.col("doc_id").cast("long") == F.col("__kept")) & (F.xxhash64("text") == F.col("__h"))
    first = docs.join(kept, same, "left_semi").withColumn("__h", F.xxhash64("text")).dropDuplicates(["doc_id", "__h"]).drop("__h")
    return first.unionByName(lone)
