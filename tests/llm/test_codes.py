import math

import numpy as np
import pytest

from filingmill.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, rounds=codes.ROUNDS):
    """Full searches in plain integers."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max((len(r[1]) for r in kept), default=0) // 8))
    limit = codes.LIMIT
    whole = [[max(-limit, min(limit, math.floor(max(-1e18, min(1e18, 4096 * x))))) for x in r[1]] + [0] * (8 * width - len(r[1])) for r in kept]
    parts = [[v[p * width : (p + 1) * width] for p in range(8)] for v in whole]
    books = [[parts[i][p] for i in range(min(16, len(kept)))] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, p: min((far(x, e), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(8):
            mine = [near(v[p], p)[1] for v in parts]
            for j in range(len(books[p])):
                its = [parts[i][p] for i, m in enumerate(mine) if m == j]
                if its:
                    books[p][j] = [sum(c) // len(its) for c in zip(*its, strict=True)]
    found = [[near(v[p], p) for p in range(8)] for v in parts]
    errors = {}
    for r, f in zip(kept, found, strict=True):
        errors[r[2]] = errors.get(r[2], 0) + sum(d for d, _ in f)
    return sorted((repr(r[0]), "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), errors[r[2]]) for r, f in zip(kept, found, strict=True)), books


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", [1]) for r in rows], SCHEMA + ", codes string, sums array<int>")
    got = codes.report(df).collect()
    expected, books = brute(rows)
    assert sorted((repr(r.vec_id), r.code, r.error, r.label_error) for r in got) == expected
    import hashlib

    assert {r.codebooks_sha256 for r in got} <= {hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()}
    return got


def vectors(n, dims, seed=1):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((5, dims))
    return [(i, [float(x) for x in np.round(centres[i % 5] + r.standard_normal(dims) * 0.2, 2)], [0, 1, None][i % 3]) for i in range(n)]


def test_against_full_searches(spark):
    check(spark, vectors(300, 16))


def test_nulls_ties_repeats_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(40, 16, 2) + [(7, [0.5] * 16, 1)] * 30 + [(3, [0.5] * 16, None), (None, [0.25] * 16, 2)]
    rows += [(100, None, 1), (101, [None, 1.0], 1), (102, [nan] * 16, 1), (103, [inf] * 16, 1), (104, [], 1), (105, [1.0, -2.0, 3.0], 4), (106, [1e300, -1e300] * 10, 4)]
    got = check(spark, rows)
    assert {100, 101, 102, 103}.isdisjoint(r.vec_id for r in got) and len(got) == len(rows) - 4


@pytest.mark.parametrize("n", [0, 1, 5, 16])
def test_few_vectors(spark, n):
    assert len(check(spark, vectors(n, 8, 3))) == n


def test_active_entries_give_what_a_full_search_gives():
    r = np.random.default_rng(4)
    x = r.integers(-3, 4, (500, 2))
    book = r.integers(-3, 4, (16, 2))
    entries, distances = codes.nearest(x, book)
    for _ in range(20):
        moved = r.random(16) < 0.2
        book = np.where(moved[:, None], r.integers(-3, 4, (16, 2)), book)
        full = codes.nearest(x, book)
        entries, distances = codes.active(x, book, moved, entries, distances)
        assert (entries == full[0]).all() and (distances == full[1]).all()


def test_decoded(spark):
    rows = vectors(64, 16, 5)
    coded, books = codes.compress(spark.createDataFrame(rows, SCHEMA))
    r = coded.where("vec_id = 9").first()
    away = np.floor(np.array(rows[9][1]) * 4096) - codes.decoded(list(r.entries), books) * 4096
    assert (away**2).sum() == sum(r.distances)
