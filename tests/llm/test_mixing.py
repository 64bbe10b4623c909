import hashlib
from fractions import Fraction
from math import floor

import pytest
from pyspark.sql import functions as F

from filingmill.llm import mixing

pytestmark = pytest.mark.usefixtures("many_ranges")
SCHEMA = "doc_id long, text string, source string"


def shares(sizes, weights=(5, 2, 1)):
    """Targets by resharing the excess, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        target = {s: Fraction(2 * sizes[s]) for s in stopped} | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        stopped |= over


def brute(rows):
    size = [len((t or "").replace("\x0b", " ").translate({9: 32, 10: 32, 12: 32, 13: 32}).split(" ")) - (t or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ").count("") for _, t, _ in rows]
    by = {}
    for (i, _, s), n in zip(rows, size, strict=True):
        by.setdefault(s, []).append((-n, i is None, i or 0))
    sizes = {s: -sum(n for n, _, _ in docs) for s, docs in by.items()}
    target, out = shares(sizes), []
    for s, docs in by.items():
        u = Fraction(int(hashlib.md5(f"13:{s or ''}".encode()).hexdigest()[:8], 16), 2**32)
        rate = target[s] / sizes[s] if sizes[s] else Fraction(0)
        for k, (n, no_id, i) in enumerate(sorted(docs), 1):
            copies = floor(u + k * rate) - floor(u + (k - 1) * rate)
            out.append((repr(None if no_id else i), -n, sizes[s], float(target[s]), -n * copies))
    return sorted(out)


def text(n):
    return " ".join(["wörd"] * n)


def corpus():
    rows = [(i, text(1 + (i * 37) % 90 + (900 if i % 50 == 0 else 0)), f"s{i % 3 * (i % 7 == 0) * 4}") for i in range(700)]
    rows += [(1000 + i, text(5), "tiny") for i in range(3)] + [(2000, None, "tiny"), (2001, "", "Zero"), (2002, " \t\n", "Zero"), (None, text(8), "tiny")]
    return rows + [(3000, text(7), None)] * 5 + [(5, text(40), "é")] * 9 + [(6, "a b \x0b c", "é")]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", size int, part int, row int").repartition(5)
    got = sorted((repr(r.doc_id), r["size"], r.source_size, r.target, r.taken) for r in mixing.report(df).collect())
    assert got == brute(rows)
    assert all(taken in (0, size, 2 * size) for _, size, _, _, taken in got)


def test_words_taken_come_near_targets_and_reruns_agree(spark):
    rows = [(i, text(1 + i % 60), f"s{i % 3 if i % 2 else 0}") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    one, two = (sorted(map(tuple, mixing.report(df.repartition(n)).collect())) for n in (3, 8))
    assert one == two
    per = {}
    for _, _, source, target, taken in one:
        per.setdefault((source, target), []).append(taken)
    assert all(abs(sum(taken) - target) <= 60 for (_, target), taken in per.items())


def test_the_mix_itself(spark):
    df = spark.createDataFrame(corpus(), SCHEMA).withColumn("size", mixing.words(F.col("text")))
    mixed = mixing.mix(df, share=(1, 2)).cache()
    out = mixing.emitted(mixed)
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copy"]
    assert out.count() == mixed.agg(F.sum("copies")).first()[0] and mixed.count() == len(corpus())


def test_empty_and_wordless(spark):
    assert mixing.report(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.report(spark.createDataFrame([(1, None, "a"), (2, "", None)], SCHEMA)).collect()
    assert [(r["size"], r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2


def test_a_hot_source_and_no_python(spark):
    df = spark.range(20_000).select("id", F.lit("same words here").alias("text"), F.lit("hot").alias("source")).toDF("doc_id", "text", "source")
    made = mixing.report(df)
    taken = made.agg(F.sum("taken"), F.count("*")).first()
    assert abs(taken[0] - 90_000) <= 3 and taken[1] == 20_000
    plan = made._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
