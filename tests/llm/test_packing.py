import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filingmill.llm import packing
from filingmill.llm.queries import tokenizer_path

ODD = [
    "áb ́c", "x\x1cy z\x85q", "İstanbul ΣΑΣ Σ", "<|endoftext|>hi", "it's don't 12a_b--c", "a b　c \t\x0b d", "",
    "ﬁ Å ÅÅ", "a <|start of|> b's 's'", "😀 a"
]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_search_places_every_length(lengths):
    counts = Counter(lengths)
    for search in (packing.best_fit, packing.complete):
        got = Counter()
        for content, n in search(dict(counts), 30):
            assert sum(content) <= 30 and n > 0
            for x in content:
                got[x] += n
        assert got == counts


def test_search_reaches_the_bound():
    r = random.Random(4)
    counts = Counter(r.randint(1, 2048) for _ in range(3000))
    bins = sum(n for _, n in packing.complete(dict(counts)))
    floor = -(-sum(k * v for k, v in counts.items()) // 2048)
    assert bins <= sum(n for _, n in packing.best_fit(dict(counts), 2048))
    assert bins <= floor * 1.02 + 1


def fewest(pieces, capacity):
    """Fewest bins, over all subsets."""
    best = [(0, 0)] + [(len(pieces) + 1, 0)] * (2 ** len(pieces) - 1)  # bins, filled in the last
    for m in range(2 ** len(pieces)):
        bins, used = best[m]
        for i, x in enumerate(pieces):
            if not m >> i & 1:
                after = (bins, used + x) if bins and used + x <= capacity else (bins + 1, x)
                best[m | 1 << i] = min(best[m | 1 << i], after)
    return best[-1][0]


def test_search_beats_best_fit_and_reaches_the_optimum():
    r, beaten = random.Random(5), 0
    for _ in range(60):
        pieces = [r.randint(5, 59) for _ in range(r.randint(6, 10))]
        size = lambda found: sum(n for _, n in found)
        counts = dict(Counter(pieces))
        got = size(packing.complete(counts, 100))
        assert got == fewest(pieces, 100), pieces
        beaten += got < size(packing.best_fit(counts, 100))
    assert beaten


def test_dominated_fillings_go():
    assert packing.dominates((50, 30), (30, 20, 20)) and not packing.dominates((50,), (30, 21))
    assert packing.fillings([10, 20, 30], {10: 3, 20: 1, 30: 1}, 30, 4, 100) == [(30,)]


def test_encoder_is_exact():
    e = packing.Encoder(tokenizer_path())
    texts = [*ODD, " ".join(ODD), "The quick brown fox, jumps. Over!? größe élan Ünder"]
    direct = [np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e.encode(texts) == direct


def test_pack(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate([*ODD, "word " * 5000, "a b c", "a b c"])] + [(50, None, None, 2), (7, "again", "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string, piece long")
    got = packing.pack(docs, tokenizer_path(), with_ids=True).collect()
    e = packing.Encoder(tokenizer_path())
    expected = Counter()
    for doc_id, text, _, _ in rows:
        ids = [*e.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            expected[(doc_id, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == r.length
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    whole = packing.sequences(packing.pack(docs, tokenizer_path(), with_ids=True)).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in got)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


@pytest.mark.parametrize("capacity", [1, 7])
def test_small_capacity(spark, capacity):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one")], "doc_id long, text string")
    got = packing.pack(docs, tokenizer_path(), capacity).collect()
    assert max(r.length for r in got) <= capacity and sum(r.length for r in got) == 9
