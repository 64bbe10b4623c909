"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Symbols are words, not bytes: a block is two words, the shift table says how far the scan may jump after
a block, blocks with shift 0 lead to a bucket of test windows by their last block and then by their first, and a
direct comparison confirms each occurrence. Windows are searched in length classes so that a short item does not
shorten the shifts of the others.

Documents are only mapped (no shuffle, no join), so copies and hot sources cost nothing extra. A test set of at most
``shard_bytes`` is broadcast, checked by its size. A larger one is taken in shards, one after the other: each pass
holds one shard in the driver and in the workers, stores the rows it found something for, and gives the shard up;
what all passes found is then joined to the documents by row. So memory is bounded by one shard, and time grows
with the product of corpus and test set.

Defined results: a null or empty text has no words (0, 0, no items, not contaminated); items with null id or no
words are ignored; repeated items count once per id; repeated documents give equal rows; an empty table gives an
empty result, and an empty test set contaminates nothing; very long texts are read whole; extra columns of either
table are not looked at and pass through ``decontaminate``.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, union_all

WINDOW = 13
BLOCK = 2
#: A window is put in the class with the largest floor that is not over its length.
FLOORS = (13, 8, 5, 3, 2)
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
HITS = "struct<n_words:bigint,hits:array<bigint>,items:array<bigint>>"


def words_of(data: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and all non-ASCII characters."""
    return data.translate(_WORDS).split() if data else []


Window = tuple[list[bytes], int, int, int]  # an item's words, where the window begins, its length, item id


class WuManber:
    """Tables for one shard of items [(item_id, text bytes)]. Windows are places in their item's words, not copies."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        self.single: dict[bytes, set[int]] = defaultdict(set)
        classes: dict[int, list[Window]] = defaultdict(list)
        for item, text in items:
            words = words_of(text)
            if len(words) == 1:
                self.single[words[0]].add(item)
            elif words:
                size = min(window, len(words))
                floor = max(f for f in (*FLOORS, window) if f <= size)
                classes[floor] += [(words, at, size, item) for at in range(len(words) - size + 1)]
        self.classes = []
        for m, windows in sorted(classes.items()):
            shift: dict[tuple[bytes, bytes], int] = {}
            bucket: dict[tuple, dict[tuple, list[Window]]] = defaultdict(lambda: defaultdict(list))
            for w in windows:
                words, at, *_ = w
                for end in range(BLOCK, m + 1):
                    block = (words[at + end - 2], words[at + end - 1])
                    shift[block] = min(shift.get(block, m), m - end)
                bucket[(words[at + m - 2], words[at + m - 1])][(words[at], words[at + 1])].append(w)
            self.classes.append((m, shift, {last: dict(by_first) for last, by_first in bucket.items()}))

    def search(self, w: list[bytes]) -> tuple[set[int], set[int]]:
        """Positions of hit words, ids of items found."""
        hit: set[int] = set()
        items: set[int] = set()
        n = len(w)
        for m, shift, bucket in self.classes:
            get, far, i = shift.get, m - BLOCK + 1, m - 1
            while i < n:
                step = get((w[i - 1], w[i]), far)
                if step:
                    i += step
                    continue
                start = i - m + 1
                for words, at, size, item in bucket[(w[i - 1], w[i])].get((w[start], w[start + 1]), ()):
                    if w[start : start + size] == words[at : at + size]:
                        hit.update(range(start, start + size))
                        items.add(item)
                i += 1
        if self.single and not self.single.keys().isdisjoint(w):
            for i, x in enumerate(w):
                if x in self.single:
                    hit.add(i)
                    items |= self.single[x]
        return hit, items


def _searcher(shard):
    """``shard``: a broadcast of one shard's items; tables are built once per task."""
    built: list[WuManber] = []

    def search(texts: pa.Array) -> pa.Array:
        if not built:
            built.append(WuManber(*shard.value))
        out = []
        for data in texts.cast(pa.binary()).to_pylist():
            w = words_of(data)
            hit, items = built[0].search(w)
            out.append({"n_words": len(w), "hits": sorted(hit), "items": sorted(items)})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))]))

    return search


def matches(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, shard_bytes: int = 4 << 20
) -> tuple[DataFrame, Column]:
    """``docs`` with a scratch column, and the column of HITS to read from it."""
    spark = docs.sparkSession
    small_batches(spark)
    bench = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")
    )
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = 1 + total // shard_bytes
    name, row = "__hits", "__row"
    while {name, row} & set(docs.columns):
        name, row = f"{name}_", f"{row}_"

    def search(part: DataFrame):
        shard = spark.sparkContext.broadcast(([(r.item_id, bytes(r.text)) for r in part.toLocalIterator()], window))
        return shard, F.arrow_udf(_searcher(shard), HITS).asNondeterministic()(F.col(text)).alias(name)

    if shards == 1:
        return docs.select("*", search(bench)[1]), F.col(name)
    base = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")  # ids are fixed once stored
    passes = []
    for k in range(shards):
        shard, found = search(bench.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k))
        hits = base.select(row, found)
        # The first pass keeps every row, for its number of words.
        passes.append(stored(hits if k == 0 else hits.where(F.size(f"{name}.items") > 0), "hits"))
        shard.destroy()
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{name}.{c}")))).alias(c)  # noqa: E731  one text's
    merged = union_all(passes).groupBy(row).agg(F.max(f"{name}.n_words").alias("n_words"), every("hits"), every("items"))
    return base.join(merged.select(row, F.struct("n_words", "hits", "items").alias(name)), row).drop(row), F.col(name)


def is_contaminated(hits: Column) -> Column:
    n = F.size(hits["hits"])
    return (n > 0) & (20 * n >= hits["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    found, hits = matches(docs, benchmark, **kw)
    return found.where(~is_contaminated(hits)).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: word count, hit words, items found."""
    found, hits = matches(docs.select("doc_id", "text"), benchmark)
    ids = F.array_sort(F.transform(hits["items"], lambda x: x.cast("string")))
    return found.select(
        "doc_id", hits["n_words"].alias("n_words"), F.size(hits["hits"]).cast("long").alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), is_contaminated(hits).alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[int, str]], window: int = WINDOW) -> tuple[int, int, list[str], bool]:
    """The same by plain comparison at every place; for tests."""
    w = words_of(text.encode() if text else None)
    hit, ids = set(), set()
    for item, t in items:
        v = words_of(t.encode() if t else None)
        for i in range(max(1, len(v) - window + 1) if v else 0):
            p = v[i : i + window]
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    hit.update(range(j, j + len(p)))
                    ids.add(str(item))
    return len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
