"""Secret scanning with one combined deterministic automaton.

All rules' expressions become one nondeterministic automaton, subset construction makes it deterministic over
byte classes, partition refinement minimises it, and the result is one flat transition array. One pass over the
bytes of a text gives every place where some rule's shortest match ends. From such a place the rule's reversed
automaton runs back to where the match starts, never beyond the rule's last span, and its own automaton runs on
to the longest end. Both runs stay inside one match, so a text is read in linear time whatever it holds, and
spans of a rule are leftmost and do not overlap. Texts are only mapped: no shuffle.

A rule's ``scan`` is its expression without an open end; none of its matches may lie strictly inside another
(``Rule``), as then places come in the order of starts.

Defined results: null and empty texts have no spans; repeated rows give equal rows; an empty table gives an empty
result; very long texts are scanned whole, in memory of their own size; extra columns pass through ``redact`` and
are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches


@dataclass(frozen=True)
class Rule:
    """``match``: what a span is. ``least``: bytes the span must have, or those after ``value``, the part before
    which is not counted. ``scan``: ``match`` up to where it first accepts, by default ``match``; no match of it
    lies strictly inside another."""

    kind: str
    match: str
    least: int = 0
    value: str = ""
    scan: str = ""


# Kinds, expressions and least lengths; (?i) is written out by the compiler for `fold` parts.
_KEY = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
_URL = r"(?i:https?|ftp|postgres|mysql|redis)://[A-Za-z0-9._-]"
RULES = (
    Rule("assign", _KEY + r"[A-Za-z0-9+/_.=-]+", 8, _KEY, scan=_KEY + r"[A-Za-z0-9+/_.=-]"),
    Rule("access", r"AKIA[A-Z0-9]+", 16, scan=r"AKIA[A-Z0-9]"),
    Rule("hex", r"[0-9a-f]+", 32, scan=r"[0-9a-f]{32}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", scan=r"-----BEGIN [A-Z ]"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40, scan=r"gh[pousr]_[A-Za-z0-9]"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15, scan=r"xox[abprs]-[A-Za-z0-9-]"),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39, scan=r"AIza[A-Za-z0-9_-]"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 24, scan=r"[rs]k_live_[A-Za-z0-9]"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", scan=r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]"),
    Rule("url", _URL + r"+:[A-Za-z0-9._~%!$&*+=-]+@[A-Za-z0-9.-]+", scan=_URL),
)
BASE = ("assign", "access", "hex")


# ---------------------------------------------------------------- expressions to automata


class _Nfa:
    """States hold byte-set edges and empty edges; built by recursive descent over a small expression language:
    literals, escapes (with \\xNN), classes, ``.``-free groups, (?i:...), |, ?, *, + and {m} or {m,n}."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, expression: str) -> tuple[int, int]:
        self.text, self.at, self.fold = expression, 0, False
        start, end = self._choice()
        if self.at != len(expression):
            raise ValueError(f"cannot read {expression!r} at {self.at}")
        return start, end

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _choice(self) -> tuple[int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b = self._sequence()
            self.empty[start].append(a)
            self.empty[b].append(end)
            if self._peek() != "|":
                return start, end
            self.at += 1

    def _sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self._peek() not in ("", "|", ")"):
            begin = self.at
            a, b = self._atom()
            after = self.at
            low, high = self._count()
            resume = self.at
            parts = []
            for _ in range(max(low, high or 0, 1)):
                self.at = begin
                parts.append(self._atom() if parts else (a, b))
            assert self.at == after or len(parts) == 1
            self.at = resume
            tail = self.state()
            for i, (x, y) in enumerate(parts):
                self.empty[end].append(x)
                if i >= low:
                    self.empty[end].append(tail)
                end = y
            if high is None:
                again = self.state()
                self.empty[end].append(again)
                self.empty[again] += [parts[-1][0], tail]
                if low == 0:
                    self.empty[parts[0][0]].append(tail)
            else:
                self.empty[end].append(tail)
            end = tail
        return start, end

    def _count(self) -> tuple[int, int | None]:
        c = self._peek()
        if c in ("?", "*", "+") and c:
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c == "{":
            close = self.text.index("}", self.at)
            low, _, high = self.text[self.at + 1 : close].partition(",")
            self.at = close + 1
            return int(low), int(high or low)
        return 1, 1

    def _atom(self) -> tuple[int, int]:
        c = self._peek()
        if c == "(":
            before = self.fold
            if self.text.startswith("(?i:", self.at):
                self.fold, self.at = True, self.at + 4
            else:
                self.at += 1
            a, b = self._choice()
            self.fold = before
            if self._peek() != ")":
                raise ValueError("missing )")
            self.at += 1
            return a, b
        if c == "[":
            self.at += 1
            found: set[int] = set()
            while self._peek() != "]":
                x = self._byte()
                if self._peek() == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    found.update(range(x, self._byte() + 1))
                else:
                    found.add(x)
            self.at += 1
        else:
            found = {self._byte()}
        if self.fold:
            found |= {x ^ 32 for x in found if 65 <= x & ~32 <= 90}
        a, b = self.state(), self.state()
        self.edges[a].append((frozenset(found), b))
        return a, b

    def _byte(self) -> int:
        c = self._peek()
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self._peek()
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def turn(self) -> None:
        """Every edge the other way round."""
        edges, empty = self.edges, self.empty
        self.edges, self.empty = [[] for _ in edges], [[] for _ in empty]
        for s, out in enumerate(edges):
            for x, t in out:
                self.edges[t].append((x, s))
        for s, out in enumerate(empty):
            for t in out:
                self.empty[t].append(s)

    def close(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


class Automaton:
    """A minimal deterministic automaton: ``classes`` maps bytes, ``table[state * width + class]`` is the next
    state times width, ``marks[state]`` the rules that end there as bits. Accepting states come last, from
    ``accept`` on (times width). Searching: the start stays alive after every byte. Anchored: ``dead`` is the
    state without a way on. Backwards: reads what the expressions match from its end."""

    def __init__(self, expressions: list[str], searching: bool, backwards: bool = False):
        nfa = _Nfa()
        ends, starts = {}, []
        for bit, e in enumerate(expressions):
            a, b = nfa.add(e)
            starts.append(b if backwards else a)
            ends[a if backwards else b] = 1 << bit
        if backwards:
            nfa.turn()
        sets = {x for edges in nfa.edges for x, _ in edges}
        of_byte: dict[tuple, int] = {}
        classes = bytes(of_byte.setdefault(tuple(b in x for x in sets), len(of_byte)) for b in range(256))
        width = len(of_byte)
        sample = [classes.index(k) for k in range(width)]
        first = nfa.close(starts)
        ids, rows, todo = {first: 0}, [], [first]
        while todo:
            now = todo.pop(0)
            row = []
            for b in sample:
                after = {t for s in now for x, t in nfa.edges[s] if b in x}
                after = nfa.close(after | set(starts) if searching else after)
                if after not in ids:
                    ids[after] = len(ids)
                    todo.append(after)
                row.append(ids[after])
            rows.append(row)
        table = np.array(rows, np.int64)
        marks = np.array([sum(bit for s, bit in ends.items() if s in now) for now in ids], np.int64)
        part = np.unique(marks, return_inverse=True)[1]  # minimise: refine until no class splits
        while True:
            finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == part.max():
                break
            part = finer
        some = np.unique(part, return_index=True)[1]
        small, small_marks = part[table[some]], marks[some]
        order = np.argsort(small_marks != 0, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(order.size)
        self.classes, self.width = classes, width
        self.table: list[int] = (place[small[order]] * width).ravel().tolist()
        self.marks: list[int] = small_marks[order].tolist()
        self.accept = int((small_marks == 0).sum()) * width
        self.start = int(place[part[0]]) * width
        dead = [s for s in range(order.size) if not self.marks[s] and all(self.table[s * width + k] == s * width for k in range(width))]
        self.dead = dead[0] * width if dead else -1

    def places(self, data: bytes) -> list[tuple[int, int]]:
        """(end, bits of the rules that end there), in one pass."""
        table, accept, width, marks, s, found = self.table, self.accept, self.width, self.marks, self.start, []
        for i, c in enumerate(data.translate(self.classes), 1):
            s = table[s + c]
            if s >= accept:
                found.append((i, marks[s // width]))
        return found

    def furthest(self, data: bytes, steps: range) -> int:
        """The last index of ``steps`` at which the bytes read so far match, or -1."""
        table, classes, accept, dead, s, found = self.table, self.classes, self.accept, self.dead, self.start, -1
        for i in steps:
            s = table[s + classes[data[i]]]
            if s == dead:
                break
            if s >= accept:
                found = i
        return found


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Automaton([r.scan or r.match for r in rules], searching=True)
        self.back = [Automaton([r.scan or r.match], searching=False, backwards=True) for r in rules]
        self.own = [Automaton([r.match], searching=False) for r in rules]
        self.values = [Automaton([r.value], searching=False) if r.value else None for r in rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, by start, then rule."""
        out, last, n = [], [0] * len(self.rules), len(data)
        for place, bits in self.all.places(data):
            while bits:
                k = (bits & -bits).bit_length() - 1
                bits &= bits - 1
                if place <= last[k]:
                    continue
                start = self.back[k].furthest(data, range(place - 1, last[k] - 1, -1))
                end = self.own[k].furthest(data, range(start, n)) + 1 if start >= 0 else 0
                if end <= 0:
                    continue
                # Greedy as the span is, its value starts at the longest key part.
                begin = self.values[k].furthest(data, range(start, end)) + 1 if self.values[k] else start
                if end - begin >= self.rules[k].least:
                    out.append((start, k, end))
                last[k] = end
        return sorted(out)


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def code_points(data: bytes, places: list[int]) -> list[int]:
    """Byte offsets, ascending, as code-point offsets."""
    out, at, n = [], 0, 0
    for p in places:
        n += len(data[at:p].decode())
        at = p
        out.append(n)
    return out


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def _marker(rules: tuple[Rule, ...]):
    made = scanner(rules)  # compiled once on the driver; its arrays, about a megabyte, go out with the function

    def mark(texts: pa.Array) -> pa.Array:
        out = []
        for data in texts.cast(pa.binary()).to_pylist():
            spans = made.spans(data) if data else []
            places = sorted({p for a, _, b in spans for p in (a, b)})
            point = dict(zip(places, code_points(data, places), strict=True)) if spans else {}
            out.append([{"kind": rules[k].kind, "start": point[a], "end": point[b]} for a, k, b in spans])
        return pa.array(out, _KIND)

    return mark


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans of all rules, by start, then as the rules are listed; code points, end exclusive."""
    return F.arrow_udf(_marker(rules), SPANS).asNondeterministic()(text)


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    small_batches(docs.sparkSession)
    spans = F.col("s")
    say = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    return docs.select("doc_id", secret_spans(F.col("text"), rules).alias("s")).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(say(F.filter(spans, lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"), say(spans).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "<secret>", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Documents with every span, overlapping ones as one, replaced by ``mark``; n_chars follows. Texts without a span stay as they are."""
    small_batches(docs.sparkSession)
    names, n = list(docs.columns), "__spans"
    while n in names:
        n += "_"
    step = lambda acc, x: F.struct(
        F.concat(
            acc["out"],
            F.when(
                x["start"] >= acc["at"],
                F.concat(
                    F.substr(F.col("text"), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")),
                    F.lit(mark)
                )
            ).otherwise("")
        ).alias("out"),
        F.greatest(acc["at"], x["end"]).alias("at"),
    )
    clean = F.aggregate(
        F.col(n), F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step,
        lambda acc: F.concat(acc["out"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"))),
    )
    found = docs.withColumn(n, secret_spans(F.col("text"), rules))
    found = found.withColumn("text", F.when(F.size(n) > 0, clean).otherwise(F.col("text")))
    if "n_chars" in names:
        found = found.withColumn(
            "n_chars",
            F.when(F.size(n) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        )
    return found.select(*[f"`{c}`" for c in names])
