"""Toxicity by a weighted finite-state grammar over clauses.

Words are mapped to symbols: insult (listed words, and a learned lexicon of words and word stems, with weights),
threat, threatening verb and its particle, target, negation, reported speech, clause end, other. Five transducers
read and rewrite symbols: phrases join a verb and a particle to a threat, negation and reported speech mark the
insults and threats they reach, target tells at the clause's end whether someone was addressed in it, before or
after. ``compose`` makes one transducer of two; the cascade of all becomes one transition table, and a clause is
one walk. A clause weighs what its insults and threats do, times the factor of its mode; a threat without a target,
negated or reported is no match. A document's score is logistic in its heaviest clause and in the log of their sum.
Words outside a match weigh nothing.

The factors are the modes' log odds of standing in a toxic text, counted over the fitting sample and backed off to
PRIOR_SHARE, over that of bare insults; a sample in which words stand at random must not turn the grammar round, so an
insult aimed at someone weighs at least MORE times a bare one, a negated or reported one at most LESS times, and a threat,
of which a sample may have none, as much as an aimed insult of middling weight. Labels here mark texts with bare insults
too, so these do count.

The lexicon comes from Spark counts of words and stems by label over the fitting sample (``SAMPLE`` rows), in which
near copies of a text count once, and holds at most LEXICON entries. A unit must stand in so many toxic texts that
chance would put less than ERROR units of the sample there; listed words need none, and their weights are backed off
to PRIOR toxic texts. A stem has at least five letters and joins at least FAMILY different words of toxic texts: what a
single word would explain stays that word. The logistic weights are fitted on the same rows.

Defined results: a null or empty text has no clauses and gets the score of a text without matches; repeated rows and
copies get equal scores; without any usable labels every score is the prior 0; an empty table gives an empty result;
very long texts are read whole; extra columns pass through ``remove_toxic`` and are never read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import small_batches, stored
from .labelled import fold, sample

LEXICON, SUPPORT, PURITY, FREQUENT, ERROR = 4000, 3, 0.9, 0.04, 0.5
#: Toxic texts that a listed insult is taken to have been seen in besides those of the sample.
PRIOR = 3
STEMS, FAMILY = (5, 6, 7, 8), 2
CACHE = 400_000
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")

# Words of each symbol, in the four languages.
WORDS = {
    "insult": "idiot idiots moron morons stupid dumb fool fools loser losers scum trash garbage worthless pathetic disgusting clown imbecile jerk bastard idioten trottel dummkopf blödmann dumm abschaum versager erbärmlich"
    " imbécile crétin stupide connard ordure minable débile abruti estúpido estúpida tonto imbécil basura escoria "
    "patético asqueroso inútil",
    "threat": "kill murder hurt destroy stab shoot strangle töten ermorden schlagen vernichten erschießen tuer frapper détruire poignarder matar golpear destruir apuñalar",
    "verb": "beat blow burn cut wipe mach bring",
    "particle": "up down out fertig um",
    "target": "you your yours he she they them him her du dich dir ihr euch sie tu te toi vous ils elle elles tú ti usted ustedes ellos",
    "negation": "not no never nor without don won nicht kein keine nie ohne ne pas jamais sans nunca sin tampoco",
    "report": "said says say wrote writes quoted called claims sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó",
    "end": ". ! ? ; : \n",
}
_LISTED = {w: symbol for symbol, words in WORDS.items() for w in words.split(" ")}
#: How many words a negation reaches, and a verb its particle.
REACH = 3
MODES = ("bare", "negated", "reported", "aimed", "threat")
#: Share of toxic texts among those with a clause of a mode, before any are seen, and as how many texts that counts.
PRIOR_SHARE = {"bare": 0.8, "negated": 0.3, "reported": 0.3, "aimed": 0.95, "threat": 0.95}
PRIOR_TEXTS, MORE, LESS = 5, 1.2, 0.9
#: Rules of a table at most.
RULES = 100_000

State = tuple | int
Transducer = tuple[State, Callable[[State, str], tuple[State, str]]]  # start; (state, symbol read) -> (state, symbol written)


def _phrases(left: int, x: str) -> tuple[int, str]:
    if x == "verb":
        return REACH, "other"
    if x == "particle":
        return 0, "threat" if left else "other"
    return (0 if x == "end" else max(left - 1, 0)), x


def _negation(left: int, x: str) -> tuple[int, str]:
    if x == "negation":
        return REACH, "other"
    if left and x in ("insult", "threat"):
        return left - 1, f"negated {x}"
    return (0 if x == "end" else max(left - 1, 0)), x


def _report(inside: int, x: str) -> tuple[int, str]:
    if x == "report":
        return 1, "other"
    if inside and x in ("insult", "threat"):
        return 1, f"reported {x}"
    return (0 if x == "end" else inside), x


def _target(seen: int, x: str) -> tuple[int, str]:
    if x == "target":
        return 1, "other"
    if x == "end":
        return 0, "aimed end" if seen else "end"
    return seen, x


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Reads what ``first`` reads, writes what ``second`` makes of what ``first`` writes."""

    def step(state, x):
        p, y = first[1](state[0], x)
        q, z = second[1](state[1], y)
        return (p, q), z

    return (first[0], second[0]), step


GRAMMAR = compose(compose(compose((0, _phrases), (0, _negation)), (0, _report)), (0, _target))
SYMBOLS = ("other", *WORDS)
WRITTEN = ("other", "insult", "threat", "negated insult", "negated threat", "reported insult", "reported threat", "end", "aimed end")


def tabulate(transducer: Transducer) -> tuple[list[list[int]], list[list[int]]]:
    """Next state and number of the symbol written, by state and symbol; the start is state 0."""
    start, step = transducer
    number, todo, to, out = {start: 0}, [start], [], []
    for state in todo:
        row, written = [], []
        for x in SYMBOLS:
            after, y = step(state, x)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
            written.append(WRITTEN.index(y))
        to.append(row)
        out.append(written)
    return to, out


_STEP, _WRITE = tabulate(GRAMMAR)
_OTHER, _END = SYMBOLS.index("other"), SYMBOLS.index("end")
_SEEDS = {SYMBOLS.index("insult"), SYMBOLS.index("threat"), SYMBOLS.index("particle")}
_ENDS = (WRITTEN.index("end"), WRITTEN.index("aimed end"))
_KEPT = {WRITTEN.index("insult"): 0, WRITTEN.index("negated insult"): 1, WRITTEN.index("reported insult"): 2, WRITTEN.index("threat"): 3}


@dataclass
class Model:
    lexicon: dict[str, float]  # a word, or a stem with * behind it
    factors: list[float] = field(default_factory=lambda: [PRIOR_SHARE[m] for m in MODES])
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0])
    bias: float = -20.0
    threat: float = 1.0
    listed: dict[str, str] = field(default_factory=lambda: _LISTED)
    _known: dict[str, tuple[int, float]] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_known": {}}

    def symbol_of(self, word: str) -> tuple[int, float]:
        if len(self._known) > CACHE:
            self._known.clear()
        listed = self.listed.get(word, "other")
        got = (SYMBOLS.index(listed), self.threat)
        if listed in ("other", "insult"):
            lexicon = self.lexicon
            weight = max(
                (
                    w for w in (lexicon.get(word), *(lexicon.get(f"{word[:k]}*") for k in STEMS if len(word) > k))
                    if w is not None
                ),
                default=0.0
            )
            got = (SYMBOLS.index("insult"), weight) if weight > 0 else (_OTHER, 0.0)
        self._known[word] = got
        return got

    def modes(self, text: str | None) -> list[float]:
        """Per mode the largest clause weight, then per mode the total."""
        top, total = [0.0] * len(MODES), [0.0] * len(MODES)
        words = TOKEN.findall((text or "").lower())
        codes = list(map(self._known.get, words))
        if None in codes:
            codes = [self.symbol_of(w) if c is None else c for w, c in zip(words, codes, strict=True)]
        if any(c[0] in _SEEDS for c in set(codes)):
            clause, s = [0.0] * 4, 0
            for c, w in (*codes, (_END, 0.0)):
                y = _WRITE[s][c]
                s = _STEP[s][c]
                if y in _ENDS:
                    if any(clause):
                        plain, negated, reported, threat = clause
                        aimed = y == _ENDS[1]
                        for k, x in enumerate(
                            (
                                0.0 if aimed else plain, negated, reported, plain if aimed else 0.0,
                                threat if aimed else 0.0
                            )
                        ):
                            top[k] = max(top[k], x)
                            total[k] += x
                        clause = [0.0] * 4
                elif y in _KEPT:
                    clause[_KEPT[y]] += w
        return top + total

    def features(self, modes: list[float]) -> list[float]:
        """The heaviest clause and the log of the sum, clauses weighed by their modes."""
        n = len(MODES)
        return [max(f * x for f, x in zip(self.factors, modes[:n], strict=True)), math.log1p(sum(f * x for f, x in zip(self.factors, modes[n:], strict=True)))]

    def score(self, text: str | None) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, self.features(self.modes(text)), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def mode_factors(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Factors of the modes from their totals (by text, mode) and the labels; see above."""
    odds = {}
    for k, mode in enumerate(MODES):
        there = x[:, k] > 0
        share = (y[there].sum() + PRIOR_TEXTS * PRIOR_SHARE[mode]) / (there.sum() + PRIOR_TEXTS)
        odds[mode] = max(math.log(share / (1 - share)), 0.0)
    bare = max(odds["bare"], 0.1)
    factor = {m: o / bare for m, o in odds.items()}
    factor["aimed"] = max(factor["aimed"], MORE)
    factor["threat"] = factor["aimed"] if not (x[:, MODES.index("threat")] > 0).any() else max(factor["threat"], MORE)
    return [min(factor[m], LESS) if m in ("negated", "reported") else factor[m] if m != "bare" else 1.0 for m in MODES]


def lexicon(rows: DataFrame, rules: dict[str, str] | None = None) -> dict[str, float]:
    """Words and stems that stand almost only in toxic texts, and listed insults, with their log odds.

    Words that toxic copies share by chance are pure too: texts of one least word hash count once, and a word stays
    if it is frequent, or if it is needed to explain toxic texts that the units before it, by count, leave over. A stem
    joins words, so it stays: other texts will have other words of it."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    stems = lambda k: F.transform(F.filter("w", lambda w: F.length(w) > k), lambda w: F.concat(F.substr(w, F.lit(1), F.lit(k)), F.lit("*")))
    least = F.array_min(F.transform("w", lambda w: F.xxhash64(w)))
    units = rows.select("doc_id", "y", words.alias("w")).select(
        "doc_id", "y", least.alias("text"), F.explode(F.array_distinct(F.concat("w", *map(stems, STEMS)))).alias("u")
    )
    # Stems of toxic texts by the number of different words they join.
    by_stem = [F.transform(F.filter("w", lambda w: F.length(w) > k), lambda w: F.struct(F.concat(F.substr(w, F.lit(1), F.lit(k)), F.lit("*")).alias("u"), w.alias("w"))) for k in STEMS]
    joined = rows.where("y = 1").select(words.alias("w")).select(F.inline(F.concat(*by_stem))).groupBy("u").agg(F.count_distinct("w").alias("family"))
    listed = sorted(w for w, symbol in (rules or _LISTED).items() if symbol == "insult")
    seen = Observation()
    counts = units.groupBy("u").agg(F.sum("y").alias("bad"), F.count("*").alias("n")).observe(seen, F.count("*").alias("units"))
    counts = counts.where(((F.col("bad") >= SUPPORT) & (F.col("bad") >= PURITY * F.col("n"))) | F.col("u").isin(listed))
    counts = counts.join(joined, "u", "left").where(~F.endswith("u", F.lit("*")) | (F.col("family") >= FAMILY)).select("u", "bad", "n")
    top = counts.orderBy(F.desc("bad"), F.length("u"), "u").limit(LEXICON).collect()
    chosen = rows.sparkSession.createDataFrame([(r.u,) for r in top], "u string")
    texts: dict[str, set[int]] = {r.u: set() for r in top}
    hashes: dict[str, set[int]] = {r.u: set() for r in top}
    toxic = units.where("y = 1").join(F.broadcast(chosen), "u").groupBy("doc_id").agg(
        F.first("text").alias("text"), F.collect_set("u").alias("us")
    )
    for r in toxic.collect():  # the sample's toxic rows
        for u in r.us:
            texts[u].add(r.doc_id)
            hashes[u].add(r.text)
    share = rows.agg(F.avg("y")).first()[0] or 0.0
    chance = math.log(1 / min(max(share, 1e-6), 0.5))
    enough = max(SUPPORT, math.ceil(math.log(max(seen.get["units"], 1) / ERROR) / chance))
    top = [r for r in top if r.u in listed or len(hashes[r.u]) >= enough]
    explained: set[int] = set()
    frequent = FREQUENT * len(set().union(*texts.values())) if texts else 0
    found = {w: math.log((PRIOR + 0.5) / 0.5) for w in listed}
    for r in top:
        if r.u in found:
            found[r.u] = math.log((r.bad + PRIOR + 0.5) / (r.n - r.bad + 0.5))
        elif r.u.endswith("*") or r.bad >= frequent or len(texts[r.u] - explained) >= SUPPORT:
            found[r.u] = math.log((r.bad + 0.5) / (r.n - r.bad + 0.5))
        else:
            continue
        explained |= texts[r.u]
    return found


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights of at least 0 and a bias, by projected Newton steps with classes weighted alike."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.where(np.arange(len(w)) < len(w) - 1, ridge, ridge / 10)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) / len(y) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + np.diag(ridge + 1e-6)
        w = w - np.linalg.solve(hessian, gradient)
        w[:-1] = np.maximum(w[:-1], 0)
    return w[:-1], float(w[-1])


def listed_in(rules: DataFrame | None) -> dict[str, str]:
    """Words and symbols of a rule table (word, symbol), a parameter of at most RULES rows; without one, WORDS."""
    if rules is None:
        return _LISTED
    rows = rules.where(F.col("symbol").isin(*WORDS)).select(F.lower("word"), "symbol").orderBy("word", "symbol").limit(RULES + 1).collect()
    if len(rows) > RULES:
        raise ValueError(f"over {RULES} rules")
    return {**{w: "end" for w in WORDS["end"].split(" ")}, **dict(map(tuple, rows))}


def train(docs: DataFrame, labels: DataFrame, rules: DataFrame | None = None) -> Model:
    """Fits on labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    rows = stored(
        sample(
            docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0
        ).repartition(docs.sparkSession.sparkContext.defaultParallelism),
        "sample"
    )
    known = listed_in(rules)
    units = lexicon(rows, known)
    seen = sorted(w for u, w in units.items() if known.get(u) == "insult")
    model = Model(units, threat=seen[len(seen) // 2] if seen else 1.0, listed=known)

    def describe(texts: pa.Array) -> pa.Array:
        return pa.array([model.modes(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    udf = F.arrow_udf(describe, "array<double>").asNondeterministic()
    got = rows.select("y", udf("text").alias("x")).collect()  # SAMPLE short rows at most
    if not got or len({r.y for r in got}) < 2:
        return model
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got], float)
    model.factors = mode_factors(x[:, len(MODES) :], y)
    w, b = logistic(np.array([model.features(r) for r in x.tolist()]), y)
    model.weights, model.bias = w.tolist(), b
    return model


def score(text: Column, model: Model) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for t in texts.to_pylist()], pa.float64())

    return F.arrow_udf(run, "double").asNondeterministic()(text)


def report(docs: DataFrame, labels: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    model = train(docs, labels, rules)
    scored = docs.select("doc_id", score(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def remove_toxic(docs: DataFrame, labels: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The documents that score under 0.5, with their own columns."""
    model = train(docs, labels, rules)
    return docs.where(score(F.col("text"), model) < 0.5)
