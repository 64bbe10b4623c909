"""Conversation structure repair: the cheapest edits that make the roles of a conversation read ``(s?(ua)+)?``.

Four-Russians: a row is one of nine symbols (first letter of its role, truncated or not; or: must go). For what comes after
a row, four costs to go (one per state of the role automaton) are all that matters, and less their last they take few
values, found by closing the end's costs under all symbols. So for every block of BLOCK symbols and every such vector one
table has the vector before the block and what was added to it. Blocks are looked up from the last to the first; to trace,
each block is expanded backward from the vector on its right, and the edits are read off forward, the least letter first
among those that are still cheapest, so ties need no second look.

On Spark: equal rows of a turn are one row with a count; rows are ordered by range, so a conversation of any length is
dealt over tasks as pieces. A piece that is not a whole conversation is a function from the vector on its right to the
vector on its left, and from its first state to its last; these are composed for the few conversations that cross a range
(at most one per border), and then every piece is traced by itself. What a conversation's rows hold meets in one task only
in ``report``, as a sorted stream of constant memory, since a digest of one text has to read it in order.

Defined results: null roles and texts are one space; a role without a letter cannot be kept; equal turns are ordered by
role, then text; null conv_id is one conversation; repeated rows are duplicates; texts are read whole, however long; the
audit of a conversation is one value, so it is bounded by what a string may hold (2^31); an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ordered, stored

#: Symbols of a block; 9 ** BLOCK rows of the tables.
BLOCK = 4
# Costs and letters of the contract: fixed values.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
GONE = 8
INITIALS = "sua"
# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. What may follow, and what an insertion adds.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = "uuau"
NAMES = {"u": "user", "a": "assistant"}
BLANK = "[^\\x20\\x09-\\x0D]"


def _close(costs: list) -> tuple:
    """Costs to go when insertions may come first."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[NEXT[q, WANTED[q]]]) for q, c in enumerate(costs)]
    return tuple(costs)


def _choices(symbol: int, q: int) -> Iterator[tuple[str, int, str, int]]:
    """(letter, cost, initial that stays, next state) of the edits of a row, by letter; insertions apart."""
    yield "D", DELETE, "", q
    if symbol != GONE:
        extra = TRUNCATED * (symbol % 2)
        own = INITIALS[symbol // 2 : symbol // 2 + 1]
        if (q, own) in NEXT:
            yield "K", KEEP + extra, own, NEXT[q, own]
        yield "R", REROLE + extra, WANTED[q], NEXT[q, WANTED[q]]


class Tables:
    """Cost vectors (less their last), their transitions by symbol and by block, and the edits of one row."""

    def __init__(self, block: int = BLOCK):
        end = _close([0, 10**6, 10**6, 0])
        self.vectors, self.block = [self._less(end)[0]], block
        number = {self.vectors[0]: 0}
        before: list[list[tuple[int, int]]] = []
        for f in self.vectors:  # grows while new vectors turn up
            row = []
            for symbol in range(9):
                costs = _close([min(c + f[to] for _, c, _, to in _choices(symbol, q)) for q in range(4)])
                g, added = self._less(costs)
                if g not in number:
                    number[g] = len(self.vectors)
                    self.vectors.append(g)
                row.append((number[g], added))
            before.append(row)
        one = np.array(before).transpose(1, 0, 2)  # by symbol, vector
        self.before, self.added = one[:, :, 0].astype(np.int32), one[:, :, 1].astype(np.int64)
        self.edits = [[[self._edit(symbol, v, q) for q in range(4)] for v in range(len(self.vectors))] for symbol in range(9)]
        self.after = np.array([[[e[2] for e in by_state] for by_state in by_vector] for by_vector in self.edits])
        n = len(self.vectors)
        self.block_before, self.block_added = np.arange(n)[None, :], np.zeros((1, n), np.int64)
        self.block_after = np.tile(np.arange(4), (1, n, 1))
        for _ in range(block):
            rest, added, after = self.block_before, self.block_added, self.block_after
            self.block_before = self.before[:, rest].reshape(-1, n)
            self.block_added = (added[None] + self.added[:, rest]).reshape(-1, n)
            first = self.after[:, rest]  # symbol, rest, vector, state
            self.block_after = after[np.arange(len(rest))[None, :, None, None], np.arange(n)[None, None, :, None], first].reshape(-1, n, 4)

    @staticmethod
    def _less(costs: tuple) -> tuple[tuple, int]:
        return tuple(c - costs[3] for c in costs), costs[3]

    def _edit(self, symbol: int, v: int, q: int) -> tuple[str, str, int]:
        """Letters and initials of a row met in state q, with costs ``v`` after it, and the state then: of the cheapest, the
        least by letter."""
        f, letters, kept = self.vectors[v], "", ""
        costs = _close([min(c + f[to] for _, c, _, to in _choices(symbol, p)) for p in range(4)])
        while True:
            best = next((x for x in _choices(symbol, q) if x[1] + f[x[3]] == costs[q]), None)
            to = NEXT[q, WANTED[q]]
            if INSERT + costs[to] == costs[q] and (best is None or best[0] > "I"):
                letters, kept, q = letters + "I", kept + WANTED[q], to
            else:
                return letters + best[0], kept + best[2], best[3]

    def blocks(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the whole blocks at the right end, and the symbols left over before them."""
        odd = len(symbols) % self.block
        return symbols[odd:].astype(np.int64).reshape(-1, self.block) @ (9 ** np.arange(self.block - 1, -1, -1)), symbols[:odd]

    def transfer(self, symbols: np.ndarray) -> list[int]:
        """For every vector on the right of a piece: the vector on its left; for every vector and first state: its last."""
        v, after = np.arange(len(self.vectors)), np.tile(np.arange(4), (len(self.vectors), 1))
        blocks, odd = self.blocks(symbols)
        each = np.arange(len(v))[:, None]
        for b in blocks[::-1]:
            after, v = after[each, self.block_after[b, v]], self.block_before[b, v]
        for s in odd[::-1]:
            after, v = after[each, self.after[s, v]], self.before[s, v]
        return [*v.tolist(), *after.ravel().tolist()]

    def trace(self, symbols: np.ndarray, right: int, q: int, last: bool) -> tuple[list[str], list[str], str]:
        """Letters and initials of each row of a piece, and the initials that are inserted after it."""
        blocks, odd = self.blocks(symbols)
        borders = [right]
        for b in blocks[::-1]:
            borders.append(int(self.block_before[b, borders[-1]]))
        places = [(0, len(odd))] + [(i, i + self.block) for i in range(len(odd), len(symbols), self.block)]
        letters, kept = [], []
        for (at, to), v in zip(places, borders[::-1], strict=True):
            beside = []
            for s in symbols[at:to][::-1]:  # the block, expanded backward: the costs on the right of each row
                beside.append(v)
                v = self.before[s, v]
            for s, v in zip(symbols[at:to], beside[::-1], strict=True):
                edit, initials, q = self.edits[s][v][q]
                letters.append(edit)
                kept.append(initials)
        tail = ""
        while last and q in (1, 2):
            tail, q = tail + WANTED[q], NEXT[q, WANTED[q]]
        return letters, kept, tail


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def _transfer(symbols: pa.Array) -> pa.Array:
    return pa.array([tables().transfer(np.array(s, np.int64)) for s in symbols.to_pylist()], pa.list_(pa.int32()))


TRACED = "struct<edits:array<string>,initials:array<string>,tail:string>"


def _trace(symbols: pa.Array, right: pa.Array, state: pa.Array, last: pa.Array) -> pa.Array:
    made = [
        tables().trace(np.array(s, np.int64), r, q, is_last)
        for s, r, q, is_last in zip(symbols.to_pylist(), right.to_pylist(), state.to_pylist(), last.to_pylist(), strict=True)
    ]
    strings = pa.list_(pa.string())
    columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((strings, strings, pa.string()))]
    return pa.StructArray.from_arrays(columns, ["edits", "initials", "tail"])


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a conversation in order: the vector on the right and the first state of each."""
    n = len(tables().vectors)
    held: list[tuple] = []

    def solved():
        rights, q, out = [0], 0, []
        for _, _, f in held[:0:-1]:
            rights.append(f[rights[-1]])
        for k, ((_, piece, f), right) in enumerate(zip(held, rights[::-1], strict=True)):
            out.append((piece, right, q, k == len(held) - 1))
            q = f[n + 4 * right + q]
        return out

    def made(rows):
        kinds = (("piece", pa.int64()), ("right", pa.int32()), ("state", pa.int32()), ("last", pa.bool_()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [name for name, _ in kinds])

    for batch in batches:
        out = []
        for row in zip(*(batch[c].to_pylist() for c in ("conv_id", "piece", "transfer")), strict=True):
            if held and held[-1][0] != row[0]:
                out += solved()
                held.clear()
            held.append(row)
        yield made(out)
    yield made(solved() if held else [])


def repair(rows: DataFrame) -> DataFrame:
    """From (conv_id, turn, role, text): one row per conversation, turn, role and text, in order of ``at``, with ``copies``,
    ``fault`` (blank, duplicate, truncated or null) of the first copy, ``edits`` (letters up to and with its own),
    ``initials`` (of the turns that these leave) and ``tail`` (initials inserted after the conversation's last row).
    Further copies are deleted. ``repaired`` has the turns that are left."""
    spaced = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = spaced.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    lines = ordered(counted, "turns", F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"))

    end = F.regexp_extract("text", f"({BLANK})[\\x20\\x09-\\x0D]*\\z", 1)
    said = lambda seed: F.xxhash64(F.lit(seed), "text", "role", "conv_id")
    told = lines.select(
        "conv_id", "part", "at", "copies", (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("open"),
        F.substring("role", 1, 1).alias("initial"), said(1).alias("a"), said(2).alias("b"),
    )
    first = told.groupBy("a", "b").agg(F.min("at").alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(F.col("open"), "truncated")
    letter = F.instr(F.lit(INITIALS), F.col("initial"))
    kind = F.when((letter > 0) & (F.col("initial") != ""), letter - 1).otherwise(len(INITIALS))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(kind * 2 + F.when(F.col("fault") == "truncated", 1).otherwise(0))
    faulty = told.join(first, ["a", "b"]).withColumn("fault", fault).select("conv_id", "part", "at", "fault", symbol.cast("tinyint").alias("symbol"))
    # A piece is what one range holds of one conversation, so no piece is larger than a task's share of all rows.
    piece = faulty.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("at", "symbol", "fault"))).alias("rows"))
    pieces = stored(piece.withColumn("piece", F.col("rows")[0]["at"]), "pieces")

    crossing = pieces.groupBy("conv_id").agg(F.min("piece").alias("piece"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"))
    symbols = F.transform("rows", lambda r: r["symbol"].cast("int"))
    of_crossing = pieces.join(crossing, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "piece", F.arrow_udf(_transfer, "array<int>")(symbols).alias("transfer")
    )
    bounds = of_crossing.repartition(n, "conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(
        _compose, "piece bigint, right int, state int, last boolean"
    )
    met = pieces.join(bounds, "piece", "left")
    traced = met.select(
        "rows", F.arrow_udf(_trace, TRACED)(
            symbols, F.coalesce("right", F.lit(0)), F.coalesce("state", F.lit(0)), F.coalesce("last", F.lit(True))
        ).alias("t"),
    )
    each = traced.select(F.size("rows").alias("n"), "t.tail", F.posexplode(F.arrays_zip("rows", "t.edits", "t.initials")).alias("k", "r")).select(
        "r.rows.at", "r.rows.fault", "r.edits", "r.initials", F.when(F.col("k") == F.col("n") - 1, F.col("tail")).otherwise("").alias("tail")
    )
    return lines.drop("part").join(each, "at")


def repaired(log: DataFrame) -> DataFrame:
    """The turns that ``repair`` leaves: conv_id, at and k (their order), role, text."""
    own = F.when(F.right("edits", F.lit(1)) == "D", 0).otherwise(1)
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    k = F.posexplode(F.filter(F.split(F.concat("initials", "tail"), ""), lambda c: c != "")).alias("k", "initial")
    turns = log.withColumn("own", F.when(own == 1, F.length("initials") - 1).otherwise(-1)).select(
        "conv_id", "at", "own", "role", "text", F.endswith("edits", F.lit("K")).alias("kept"), k
    )
    mine = F.col("k") == F.col("own")
    return turns.select(
        "conv_id", "at", "k", F.when(mine & F.col("kept"), F.col("role")).otherwise(names[F.col("initial")]).alias("role"),
        F.when(mine, F.col("text")).otherwise("").alias("text"),
    )


SCHEMA = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired_sha256 string"
)
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Digest:
    """What ``report`` says of one conversation, row by row."""

    def __init__(self, conv_id):
        self.conv_id, self.n = conv_id, dict.fromkeys(FIELDS, 0)
        self.audit, self.sha, self.empty = [], hashlib.sha256(), True
        self.low = self.high = self.before = None
        self.turns = 0

    def say(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def add(self, turn, role, text, copies, fault, edits, initials, tail) -> None:
        n, letter = self.n, role[:1]
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if fault:
            n[fault] += copies if fault == "blank" else 1
        if fault != "blank":
            n["duplicate"] += copies - 1
        n["illegal"] += copies - 1 + (self.before is not None and self.before + letter not in ("su", "ua", "au"))
        self.before = letter
        self.audit.append(edits + "D" * (copies - 1) + "I" * len(tail))
        n["cost"] += INSERT * (len(edits) - 1 + len(tail)) + DELETE * (copies - 1)
        n["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE}[edits[-1]] + (TRUNCATED if fault == "truncated" and edits[-1] != "D" else 0)
        own = initials[-1:] if edits[-1] != "D" else ""
        for i in initials[: len(initials) - len(own)]:
            self.say(NAMES[i], "")
        if own:
            self.say(role if edits[-1] == "K" else NAMES[own], text)
        for i in tail:
            self.say(NAMES[i], "")

    def row(self) -> tuple:
        if self.turns:
            self.n["gaps"] = min(self.high - self.low + 1 - self.turns, 2**63 - 1)
        return (self.conv_id, *self.n.values(), "".join(self.audit), self.sha.hexdigest())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    names = ["conv_id", *FIELDS, "audit", "repaired_sha256"]

    def made(found):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names)

    for batch in batches:
        found = []
        for conv_id, at, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    found.append(now.row())
                now = _Digest(conv_id)
            if at >= 0:
                now.add(*row)
        yield made(found)
    yield made([now.row()] if now is not None else [])


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's faults, by crc32 of ``conv_id:turn``."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("c"),
    ).where("c <> 0")
    text = F.when(F.col("c") == 1, "").when(F.col("c") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("c") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("c") == 3, 2).otherwise(1)))).drop("col")


def digest(log: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per conversation of ``ids`` (conv_id), those without rows too."""
    none: list[Column] = [F.lit(None).cast(t) for t in ("bigint", "string", "string", "bigint", "string", "string", "string", "string")]
    columns = ["conv_id", "at", "turn", "role", "text", "copies", "fault", "edits", "initials", "tail"]
    marks = ids.select(F.col("conv_id").cast("long")).distinct().select("conv_id", F.lit(-1).cast("long"), *none).toDF(*columns)
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return log.select(*columns).unionByName(marks).repartition(n, "conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_digests, SCHEMA)


def report(conversations: DataFrame) -> DataFrame:
    """Damages the conversations and repairs them: faults, cost, edits and the digest of what is left, per conversation."""
    return digest(repair(damage(conversations)), conversations)


# DuckDB: the same edits forward, one row of every conversation a step, the least (cost, letters) of each state kept.
SQL = """
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
k AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(unicode(x) AS BIGINT)) AS codes
  FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), codes), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) % 20 AS f FROM k, tab),
d AS (SELECT c, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE f <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
r AS MATERIALIZED (SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) || substr(role, 1, 1) AS pair,
  CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM n),
m(q, p, letters, said) AS (VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''),
  (0, 2, 'I', 'user:' || chr(10)), (1, 2, 'I', 'user:' || chr(10)), (2, 3, 'I', 'assistant:' || chr(10)), (3, 2, 'I', 'user:' || chr(10)),
  (0, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))),
e(p, letter, initial, z, price, name) AS (VALUES (0, 'D', '', 0, 2, ''), (1, 'D', '', 1, 2, ''), (2, 'D', '', 2, 2, ''), (3, 'D', '', 3, 2, ''),
  (0, 'K', 's', 1, 0, ''), (0, 'K', 'u', 2, 0, ''), (1, 'K', 'u', 2, 0, ''), (2, 'K', 'a', 3, 0, ''), (3, 'K', 'u', 2, 0, ''),
  (0, 'R', '', 2, 1, 'user'), (1, 'R', '', 2, 1, 'user'), (2, 'R', '', 3, 1, 'assistant'), (3, 'R', '', 2, 1, 'user')),
s AS (SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, 0 AS q, {'cost': CAST(0 AS BIGINT), 'audit': '', 'said': ''} AS best FROM r
  UNION ALL
  SELECT s.c, s.i + 1, e.z, min({'cost': CAST(s.best.cost + 5 * length(m.letters) + e.price + CASE WHEN e.letter <> 'D' AND r.fault = 'truncated' THEN 5 ELSE 0 END AS BIGINT),
    'audit': s.best.audit || m.letters || e.letter,
    'said': s.best.said || m.said || CASE e.letter WHEN 'D' THEN '' WHEN 'K' THEN r.role || ':' || r.text || chr(10) ELSE e.name || ':' || r.text || chr(10) END})
  FROM s JOIN r ON r.c = s.c AND r.i = s.i + 1 JOIN m ON m.q = s.q JOIN e ON e.p = m.p
  WHERE (e.letter = 'D' OR r.fault NOT IN ('blank', 'duplicate')) AND (e.letter <> 'K' OR e.initial = r.initial) GROUP BY s.c, s.i, e.z),
g AS (SELECT c, max(i) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c),
b AS (SELECT s.c, min({'cost': s.best.cost + 5 * length(m.letters), 'audit': s.best.audit || m.letters, 'said': s.best.said || m.said}) AS best
  FROM s JOIN g ON g.c = s.c AND g.n = s.i JOIN m ON m.q = s.q WHERE m.p IN (0, 3) GROUP BY s.c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(CASE WHEN best.said = '' THEN '' ELSE left(best.said, length(best.said) - 1) END, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM k) i LEFT JOIN g ON g.c = i.c LEFT JOIN b ON b.c = i.c
"""
