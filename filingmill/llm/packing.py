"""Packing of tokenised documents into sequences by bin completion.

Tokenising is a map over documents. Pieces then differ, for packing, only in their length, so the whole
corpus is described by one count per length: at most ``capacity`` numbers whatever the corpus size. Bin
completion runs on those counts by depth-first branch and bound: around the largest remaining length it enumerates
undominated fillings of the rest of the bin, uses each as often as the counts allow, and goes back to the last level
that has another filling whenever the waste bound (bins so far plus volume left) cannot beat the incumbent, which is
the best-fit-decreasing solution at first. The number of nodes is bounded by ``NODES`` and by the number of lengths;
when they are spent the incumbent stands. Patterns become rank ranges per length, and every piece finds its sequence from its rank among the
pieces of its length; ranks come from salted counts, so a length that a third of all pieces share is spread.

Defined results: null and empty texts are one piece (the end id alone); only documents of more than
``capacity`` ids are cut; repeated rows are separate documents; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, stored

CAPACITY = 2048
END_ID = 0
SALTS = 64
#: Nodes of the search besides two for every distinct length.
NODES = 4000
#: Entries of a worker's cache of encoded words, about 200 bytes each.
CACHE = 800_000
_LETTERS = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
#: Letters that neither normalising nor lower-casing can join or split, then marks that form one run for the
#: tokenizer; apostrophes and < begin other rules of it.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#%&$|\"()-]*)").fullmatch
_PIECE = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint{}>>"


class Encoder:
    """Ids of whole texts. The tokenizer drops white space and never joins across it, so each distinct
    space-separated word is encoded once per worker and texts are joined from the cached ids.

    A word of plain letters with marks behind it, the bulk, goes straight to the tokenizer's model, in the
    letters of its byte alphabet; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {ord(c): alphabet.pre_tokenize_str(c)[0][0] for c in _LETTERS}
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}

    def _one(self, word: str) -> bytes:
        """Learns the ids of a word that is not known yet."""
        if match := _PLAIN(word):
            base, tail = match.groups()
            low = base.lower()
            code = self.plain.get(low)
            if code is None:
                mapped = low if low.isascii() else low.translate(self.alphabet)
                code = self.plain[low] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            if tail:
                code += self.known.get(tail) or self._one(tail)
        else:
            code = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        self.known[word] = code
        return code

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) + len(self.plain) > CACHE:
            self.known.clear()
            self.plain.clear()
        get, one, out = self.known.get, self._one, []
        for text in texts:
            words = text.replace("\n", " ").split(" ")
            codes = list(map(get, words))
            if None in codes:
                codes = [one(w) if c is None else c for w, c in zip(words, codes, strict=True)]
            out.append(b"".join(codes))
        return out


def _cutter(path: str, capacity: int, with_ids: bool):
    encoder: list[Encoder] = []
    fields = [
        ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())
    ] + [("ids", pa.list_(pa.int32()))] * with_ids
    kind = pa.list_(pa.struct(fields))

    def cut(texts: pa.Array) -> pa.Array:
        if not encoder:
            encoder.append(Encoder(path))
        ends, rows, ids = [0], [], []
        for code in encoder[0].encode([t or "" for t in texts.to_pylist()]):
            code += END_ID.to_bytes(4, "little")
            for k, at in enumerate(range(0, len(code), 4 * capacity)):
                part = code[at : at + 4 * capacity]
                rows.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
                if with_ids:
                    ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            ends.append(len(rows))
        columns = [
            pa.array(c, f[1]) for c, f in zip(zip(*rows, strict=True), fields, strict=False)
        ] if rows else [pa.array([], f[1]) for f in fields[:4]]
        if with_ids:
            columns.append(pa.array(ids, fields[4][1]))
        return pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=[f[0] for f in fields])
        ).cast(kind)

    return cut


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    small_batches(docs.sparkSession)
    kind = _PIECE.format(",ids:array<int>" * with_ids)
    udf = F.arrow_udf(_cutter(tokenizer_path, capacity, with_ids), kind).asNondeterministic()
    return docs.select("doc_id", udf(F.col("text")).alias("p")).select("doc_id", F.inline("p"))


# ---------------------------------------------------------------- the search, on counts per length


Pattern = tuple[tuple[int, ...], int]  # lengths in one bin, number of bins


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, with bins of equal content kept as one group."""
    groups: dict[int, list[list]] = defaultdict(list)  # room left -> [content, bins]
    rooms: set[int] = set()
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                each = capacity // length
                for n, bins in ((each, left // each), (left % each, 1)):
                    if n and bins:
                        groups[capacity - n * length].append([(length,) * n, bins])
                        rooms.add(capacity - n * length)
                break
            content, bins = groups[room].pop()
            if not groups[room]:
                rooms.discard(room)
            n = min(room // length, -(-left // bins))  # per bin
            used = min(bins, left // n)
            if used < bins:
                groups[room].append([content, bins - used])
                rooms.add(room)
            if used:
                groups[room - n * length].append([content + (length,) * n, used])
                rooms.add(room - n * length)
                left -= n * used
            elif left < n:
                groups[room - left * length].append([content + (length,) * left, 1])
                rooms.add(room - left * length)
                groups[room][-1][1] -= 1
                if not groups[room][-1][1]:
                    groups[room].pop()
                if not groups[room]:
                    rooms.discard(room)
                left = 0
    return [(tuple(c), n) for g in groups.values() for c, n in g]


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of ``b`` fit, some together, into places of the pieces of ``a``: then ``a`` is at least as good."""
    rooms = sorted(a)
    for x in sorted(b, reverse=True):
        k = bisect_left(rooms, x)
        if k == len(rooms):
            return False
        insort(rooms, rooms.pop(k) - x)
    return True


def fillings(lengths: list[int], counts: dict[int, int], room: int, width: int, nodes: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, least waste first; at most ``width`` of them, from at most ``nodes`` tried."""
    best: dict[int, tuple[int, ...]] = {}  # sum -> its first filling, that of the largest pieces
    spent = 0

    def go(left: int, at: int, chosen: tuple[int, ...]) -> None:
        nonlocal spent
        spent += 1
        best.setdefault(room - left, chosen)
        k, tried = min(at, bisect_right(lengths, left) - 1), 0
        while k >= 0 and tried < width and spent < nodes and room not in best:
            x = lengths[k]
            if chosen.count(x) < counts[x]:
                tried += 1
                go(left - x, k, (*chosen, x))
            k -= 1

    go(room, len(lengths) - 1, ())
    found: list[tuple[int, ...]] = []
    for total in sorted(best, reverse=True):
        if len(found) < width and not any(dominates(f, best[total]) for f in found):
            found.append(best[total])
    return found


def complete(
    counts: dict[int, int], capacity: int = CAPACITY, width: int = 4, nodes: int | None = None, depth_nodes: int = 160
) -> list[Pattern]:
    """Bin completion by branch and bound; ``nodes`` bounds the search, never the result's completeness."""
    left = {k: v for k, v in counts.items() if v}
    incumbent = best_fit(left, capacity)
    best = sum(n for _, n in incumbent)
    volume = sum(k * v for k, v in left.items())
    floor = -(-volume // capacity)
    budget = nodes if nodes is not None else NODES + 2 * len(left)
    lengths, bins, spent = sorted(left), 0, 0
    levels: list[list] = []  # [fillings around the largest piece, number of the next, (content, times) in use or None]

    def put(content: tuple[int, ...], times: int) -> None:
        nonlocal bins, volume
        for x in content:
            before = left.get(x, 0)
            left[x] = before - times
            if not left[x]:
                del left[x]
                lengths.pop(bisect_left(lengths, x))
            elif not before:
                insort(lengths, x)
        bins += times
        volume -= times * sum(content)

    down = True
    while best > floor:
        if down:
            if not left:
                incumbent, best = [level[2] for level in levels], bins
                down = False
            elif bins + -(-volume // capacity) >= best:
                down = False
            elif spent >= budget:
                break
            else:
                spent += 1
                top = lengths[-1]
                left[top] -= 1
                options = fillings(lengths, left, capacity - top, width, depth_nodes)
                left[top] += 1
                levels.append([[(top, *f) for f in options], 0, None])
        if not levels:
            break
        level = levels[-1]
        if level[2] is not None and not down:
            put(level[2][0], -level[2][1])
            level[2] = None
        if level[1] < len(level[0]):
            content = level[0][level[1]]
            level[1] += 1
            times = min(left[x] // content.count(x) for x in set(content))
            level[2] = (content, times)
            put(content, times)
            down = True
        else:
            levels.pop()
            down = False
    return incumbent


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted by length and rank."""
    ranks: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for content, n in patterns:
        offset = 0
        for x in content:
            rows.append((x, ranks[x], base, offset))
            ranks[x] += n
            offset += x
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (read twice, so pass a stored table)."""
    spark = cut.sparkSession
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)))
    cells = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))  # at most capacity * SALTS rows
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    cells = stored(cells.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).repartition(1), "cells")
    counts = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(slots(complete(counts, capacity)))

    def seat(length: pa.Array, rank: pa.Array) -> pa.Array:
        table = plan.value
        x, r = length.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.searchsorted((table[:, 0] << 48) + table[:, 1], (x << 48) + r, "right") - 1
        return pa.StructArray.from_arrays(
            [pa.array(table[at, 2] + r - table[at, 1]), pa.array(table[at, 3])], names=["sequence_id", "offset"]
        )

    udf = F.arrow_udf(seat, "struct<sequence_id:bigint,offset:bigint>").asNondeterministic()
    within = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("k", F.row_number().over(within)).join(
        F.broadcast(cells.select("length", "salt", "first")), ["length", "salt"]
    )
    seated = ranked.withColumn("seat", udf(F.col("length"), F.col("first") + F.col("k") - 1))
    return seated.select(*cut.columns, F.col("seat.sequence_id").alias("sequence_id"), F.col("seat.offset").alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece with its place: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    return place(stored(pieces(docs, tokenizer_path, capacity, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from ``pack(..., with_ids=True)``: sequence_id, ids (at most capacity), doc_ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))  # a sequence holds at most capacity ids
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids")
    )
