import random

import numpy as np
from pyspark.sql import functions as F

from filingmill.llm import minhash
from filingmill.llm.decontamination import words_of


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        i = r.randrange(len(words))
        kind = r.randrange(3)
        if kind == 0:
            words[i] = f"w{r.randrange(10**6)}"
        elif kind == 1:
            words.insert(i, f"w{r.randrange(10**6)}")
        else:
            del words[i]
    return words


def brute(rows):
    np.seterr(over="ignore")
    shingled = {d: minhash.shingles(words_of(t.encode())) for d, t in rows if d is not None and t and words_of(t.encode())}
    parent = {d: d for d, _ in rows if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(shingled)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if minhash.similarity(shingled[a], shingled[b]) >= 0.8:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: top(d) for d in parent}


def corpus(seed=1):
    r = random.Random(seed)
    rows, n = [], 0
    for g in range(25):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([4, 5, 30, 120, 300]))]
        for _ in range(r.choice([1, 2, 3, 40 if g % 8 == 0 else 4])):
            rows.append((n, " ".join(edited(r, base, r.choice([0, 0, 1, 2, len(base) // 50])))))
            n += 1
    shared = " ".join(f"s{i}" for i in range(60))
    rows += [(n + i, shared + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(60))) for i in range(60)]
    return [*rows, (900, None), (901, ""), (902, "..."), (903, "One"), (904, "one!"), (3, rows[3][1])]


def test_classes_match_brute_force(spark):
    rows = corpus()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    expected = brute(rows)
    assert {r.doc_id: r.class_id for r in got} == expected
    assert expected[904] == 903 and expected[901] == 901
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_deduplicate_keeps_one_of_each(spark):
    rows = [(d, t, "x", d) for d, t in corpus(2)] + [(None, "no id", "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string, kept long")
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    expected = brute([(d, t) for d, t, _, _ in rows])
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(expected.values()))
    assert kept.where("doc_id is null").count() == 1


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similarity_is_that_of_plain_sets_for_replacements():
    np.seterr(over="ignore")
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    for n in range(8):
        other = edited(r, base, n)
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, other))
        plain = len(a & b) / len(a | b)
        got = minhash.similarity(*(minhash.shingles([x.encode() for x in w]) for w in (base, other)))
        assert abs(got - plain) < 1e-9 or plain < 0.8


def test_order_counts():
    np.seterr(over="ignore")
    w = [f"w{i}".encode() for i in range(100)]
    assert minhash.similarity(minhash.shingles(w), minhash.shingles(w[50:] + w[:50])) < 0.8


def test_large_bucket_of_varied_copies(spark):
    """Groups of loose copies in common buckets: a row's only links are often to rows far away in the sort."""
    r = random.Random(5)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range(60):
            words = list(base)
            for i in r.sample(range(120), 2):
                words[i] = f"x{r.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.class_id for x in got} == candidates_joined(rows)


def candidates_joined(rows):
    """Classes that comparing every pair that agrees in a table gives."""
    np.seterr(over="ignore")
    made = {d: minhash.shingles(words_of(t.encode())) for d, t in rows}
    keys = {d: np.array(minhash.sketch(s), object).reshape(minhash.TABLES, -1)[:, 0] for d, s in made.items()}
    part = {d: d for d, _ in rows}
    for a, x in made.items():
        for b, y in made.items():
            if a < b and part[a] != part[b] and (keys[a] == keys[b]).any() and minhash.similarity(x, y) >= 0.8:
                low, high = sorted((part[a], part[b]))
                part = {d: low if p == high else p for d, p in part.items()}
    return part


def test_blocks_lose_no_pair(spark, monkeypatch):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK", 7)
    assert {x.doc_id: x.class_id for x in minhash.near_duplicates(docs).collect()} == brute(rows)


def test_one_table_is_enough(spark):
    np.seterr(over="ignore")
    r = random.Random(9)
    rows = []
    while len(rows) < 6:
        base = [f"w{r.randrange(10**6)}" for _ in range(60)]
        pair = base, edited(r, base, 2)
        x, y = (minhash.shingles([w.encode() for w in words]) for words in pair)
        if minhash.similarity(x, y) >= 0.8 and sum(a == b for a, b in zip(minhash.sketch(x), minhash.sketch(y), strict=True)) == 1:
            rows += [(len(rows) + i, " ".join(words)) for i, words in enumerate(pair)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.class_id for x in got} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_no_link_is_left_between_classes(spark):
    """Components meet through any of their members, not through one that stands for all."""
    r = random.Random(6)
    rows = []
    for g in range(2):
        for _ in range(120):
            words = [f"g{g}w{i}" for i in range(120)]
            for i in r.sample(range(120), 2):
                words[i] = f"x{r.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
    part = {x.doc_id: x.class_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = candidates_joined(rows)
    assert len(set(part.values())) == len(set(expected.values()))
    assert part == expected


def test_deduplicate_keeps_different_texts_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, b), (5, a), (5, b), (7, b + " more"), (8, None), (8, "..."), (9, c), (9, c)]
    kept = minhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, str(x.text)) for x in kept) == sorted([(1, a), (5, b), (8, "None"), (8, "..."), (9, c)])


def test_texts_of_a_hot_bucket_are_not_sent_per_pair_of_blocks(spark, monkeypatch):
    r = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(600):
        words = list(base)
        words[r.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:60] + [f"y{i}z{k}" for k in range(90)])) for i in range(40)]
    monkeypatch.setattr(minhash, "BLOCK", 20)
    sent, compared = [], minhash._compared

    def watched(rows, texts, least):
        sent.append((rows.count(), rows.select("t", "key", "digest").distinct().count()))
        return compared(rows, texts, least)

    monkeypatch.setattr(minhash, "_compared", watched)
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(600)} | {1000 + i: 1000 + i for i in range(40)}
    assert len(sent) == 3 and sent[0][0] == sent[0][1] and sent[1][0] < sent[0][0] and sent[2][0] < sent[0][0]


def test_recall_of_ids_divisible_by_50(spark):
    """Links of these documents to all others, by exact similarity, are inside classes."""
    np.seterr(over="ignore")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    made = {d: minhash.shingles(w) for d, t in docs.collect() if (w := words_of((t or "").encode()))}
    linked = [(a, b) for a in made if a % 50 == 0 for b in made if a != b and minhash.similarity(made[a], made[b]) >= 0.8]
    part = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs).collect()}
    assert sum(part[a] == part[b] for a, b in linked) >= 0.9 * len(linked)


def test_very_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i % 5000}v{i // 5000}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "short one"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("digest", "key", "component", "class", "blocks")})
    assert {x.doc_id: x.class_id for x in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [1, 3, 4]
