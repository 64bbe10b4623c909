import random

import numpy as np

from filingmill.llm import embeddings


def brute(rows):
    good = [
        (i, np.array(v, float), label) for i, v, label in rows
        if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    links = {i: 0 for i, _, _ in rows}
    parent = {i: i for i, _, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a, la) in enumerate(good):
        for j, b, lb in good[:k]:
            if la == lb and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                links[i] += 1
                links[j] += 1
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], top(i)) for i in links}


def vectors(seed=2):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(40):
        base = r.standard_normal(16)
        for _ in range(random.Random(c).choice([1, 2, 5, 30 if c < 2 else 3])):
            v = base + r.standard_normal(16) * r.choice([0, 0.03, 0.05])
            rows.append((len(rows), [float(np.float32(x)) for x in v * r.choice([1, 2.5])], c % 3))
    n = len(rows)
    rows += [
        (n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [1.0] * 16, None),
        (n + 4, [1.0, None], 1), (n + 5, [1.0, 2.0], 1), (n + 6, [2.0, 4.0], 1)
    ]
    return rows


def check(spark, rows, got):
    expected = brute(rows)
    links = sum(n for n, _ in expected.values())
    assert sum(r.n_links for r in got) >= 0.99 * links and all(r.n_links <= expected[r.vec_id][0] for r in got)
    assert {r.vec_id: r.component_id for r in got} == {i: c for i, (_, c) in expected.items()}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and len(got) == len(rows)


def test_against_brute_force(spark):
    rows = vectors()
    check(spark, rows, embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())


def test_hot_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    rows = vectors(3)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, keys string")
    check(spark, rows, embeddings.near_duplicates(df).collect())


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (2, [0.0, 1.0], 0), (3, [0.0, 2.0], 0)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links) for r in got) == [(1, 2), (1, 2), (2, 3), (2, 3), (3, 1)]
    assert {r.component_id for r in got} == {1}
