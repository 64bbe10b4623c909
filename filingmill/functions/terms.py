"""Terms of texts by the batch: one definition for ``tfidf_terms`` and the TF-IDF cosine.

A batch of texts is lower-cased, decomposed and freed of its marks in Arrow; its words are found in the bytes of the whole
batch (two or more plain letters, nothing else of a word beside them) and become numbers of a dictionary, in which stop words
are looked up. From there on terms are integer arrays. A bigram of neighbours among what is left is a number too (first word times size of the dictionary plus
second), so counts, common terms and sums are sorts and segment reductions over the batch, exact, without a loop over texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from filingmill.sources.store import small_batches

#: Inverse document frequency of a term that one of two texts has; one that both have counts 1.
ALONE = math.log(1.5) + 1
MAX_TERMS = 10_000
#: Bytes of text that are taken apart at once.
PART_BYTES = 1_000_000


#: Bytes: 2 a letter of terms, 1 another of words (beyond ASCII too), 0 between words.
_KINDS = np.ones(256, np.int8)
_KINDS[:128] = 0
_KINDS[[*b"0123456789_"]] = 1
_KINDS[97:123] = 2
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: What stands for a letter beyond ASCII; no byte of UTF-8.
_OTHER = 0xFF


def _latin() -> tuple[np.ndarray, str]:
    """What a character of two bytes from C2 80 to C3 BF comes to by its last bytes, and a pattern of what no single byte stands for."""
    to, rest = np.full((2, 256), _OTHER, np.uint8), []
    for c in map(chr, range(0x80, 0x100)):
        lead, last = c.encode()
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if unicodedata.category(x)[0] != "M")
        plain = re.sub(r"[^\x00-\x7f]", lambda m: m[0] if unicodedata.category(m[0])[0] in "LN" else " ", plain)
        if len(plain) == 1:
            to[lead - 0xC2, last] = ord(plain) if plain < "\x80" else _OTHER
        else:
            rest.append(c)
    return to, "[^\\x00-\\x{FF}]|[" + "".join(rest) + "]"


_LATIN, _RARE = _latin()


def _plain(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts in lower case, decomposed and freed of marks. Characters of ASCII and Latin-1 are looked up
    byte by byte; only texts that hold others go through Unicode's tables."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pc.all(pc.string_is_ascii(texts)).as_py():
        rare = pc.match_substring_regex(texts, _RARE)
        if pc.any(rare).as_py():
            low = pc.replace_substring_regex(pc.utf8_normalize(pc.utf8_lower(texts.filter(rare)), "NFKD"), r"\p{M}+", "")
            low = pc.replace_substring_regex(low, r"[^\x00-\x7F\p{L}\p{N}]+|[A-Z]", " ")  # other bytes beyond ASCII are letters or digits now
            texts = pc.replace_with_mask(texts, rare, low)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _LOW[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xC3))
    if len(lead):
        data[lead + 1] = _LATIN[data[lead] - 0xC2, data[lead + 1]]
        there = np.ones(len(data), bool)
        there[lead] = False
        data, offsets = data[there], offsets - np.searchsorted(lead, offsets)
    return data, offsets


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of bytes that are inside; runs end with their text."""
    inside = np.concatenate([[False], inside, [False]])
    cut = np.zeros(len(inside) - 1, bool)
    cut[offsets] = True
    return np.flatnonzero(inside[1:] & (~inside[:-1] | cut)), np.flatnonzero(inside[:-1] & (~inside[1:] | cut))


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeStringArray:
    """The runs as an array of words."""
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts] += 1
    edges[ends] -= 1
    letters = data[np.cumsum(edges[:-1], dtype=np.int8) > 0]
    places = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(letters.tobytes()))


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The text in which each run starts."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def words_of(texts: pa.Array, stop: frozenset[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, word, dictionary): the words that count, in order of rows and places. A word is a whole run of letters, digits and
    underscores, so ``abc123`` is none."""
    data, offsets = _plain(texts)
    kind = _KINDS[data]
    starts, ends = runs(kind > 0, offsets)
    whole = ends - starts >= 2
    strange = np.flatnonzero(kind == 1)
    whole[np.searchsorted(starts, strange, side="right") - 1] = False
    starts, ends = starts[whole], ends[whole]
    row = rows_of(starts, offsets)
    coded = spelled(data, starts, ends).dictionary_encode()
    known = coded.dictionary
    kept = pc.invert(pc.is_in(known, value_set=pa.array(sorted(stop), known.type)))
    some, code = kept.to_numpy(zero_copy_only=False), coded.indices.to_numpy().astype(np.int64)
    there = some[code]
    return row[there], (np.cumsum(some) - 1)[code[there]], known.filter(kept)


def _terms(row: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, term): words, then bigrams n + first * n + second."""
    pair = np.flatnonzero(row[1:] == row[:-1])
    return np.concatenate([row, row[pair]]), np.concatenate([word, n + word[pair] * n + word[pair + 1]])


def cosines(raw: pa.Array, prior: pa.Array, stop: frozenset[str], most: int = MAX_TERMS) -> np.ndarray:
    """TF-IDF cosine of each pair of texts, fitted on just these two, in closed form; NaN without any term. Of pairs with more
    than ``most`` terms the most frequent count, among equals the first by text."""
    pairs = len(raw)
    row, word, known = words_of(pa.concat_arrays([raw.cast(pa.large_string()), prior.cast(pa.large_string())]), stop)
    n = len(known)
    row, term = _terms(row, word, n)
    size = n + n * n  # of the space of terms; a batch's pairs times it stay below 2^63
    key = row % pairs * size + term if pairs else term
    (a, na), (b, nb) = (np.unique(key[side], return_counts=True) for side in (row < pairs, row >= pairs))
    _, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    pair_of = lambda keys: keys // max(size, 1)
    distinct = np.bincount(pair_of(a), minlength=pairs) + np.bincount(pair_of(b), minlength=pairs) - np.bincount(pair_of(a[in_a]), minlength=pairs)
    if (distinct > most).any():
        kept = _most_frequent(a, na, b, nb, np.flatnonzero(distinct > most), size, known, most)
        here_a, here_b = (np.isin(keys, kept) | (distinct[pair_of(keys)] <= most) for keys in (a, b))
        a, na, b, nb = a[here_a], na[here_a], b[here_b], nb[here_b]
        _, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    ta, tb = 1 + np.log(na), 1 + np.log(nb)
    weight_a, weight_b = np.full(len(a), ALONE), np.full(len(b), ALONE)
    weight_a[in_a] = weight_b[in_b] = 1.0
    sums = lambda keys, values: np.bincount(pair_of(keys), weights=values, minlength=pairs)
    xx, yy, xy = sums(a, (ta * weight_a) ** 2), sums(b, (tb * weight_b) ** 2), sums(a[in_a], ta[in_a] * tb[in_b])
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((xx == 0) & (yy == 0), np.nan, np.where((xx > 0) & (yy > 0), xy / np.sqrt(xx * yy), 0.0))


def _most_frequent(a, na, b, nb, pairs: np.ndarray, size: int, known: pa.Array, most: int) -> np.ndarray:
    """Keys that stay of over-long pairs. A blank sorts before letters, so terms in order of text are words in order of first
    word, then alone before with a second."""
    n = len(known)
    rank = np.empty(n, np.int64)
    rank[pc.array_sort_indices(known).to_numpy()] = np.arange(n)
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([na, nb])).astype(np.int64)
    over = np.isin(keys // size, pairs)
    keys, total = keys[over], total[over]
    term = keys % size
    one = term < n
    first, second = np.where(one, term, (term - n) // n), np.where(one, 0, (term - n) % n)
    order = np.lexsort((np.where(one, -1, rank[second]), rank[first], -total, keys // size))
    pair = (keys // size)[order]
    place = np.arange(len(pair)) - np.searchsorted(pair, pair)
    return keys[order[place < most]]


def term_lists(texts: pa.Array, stop: frozenset[str]) -> pa.Array:
    """Words, then bigrams, of each text."""
    row, word, known = words_of(texts, stop)
    pair = np.flatnonzero(row[1:] == row[:-1])
    spelled = known.take(pa.array(word)).cast(pa.string())
    joined = pc.binary_join_element_wise(spelled.take(pa.array(pair)), spelled.take(pa.array(pair + 1)), " ")
    rows = np.concatenate([row, row[pair]])
    order = np.argsort(rows, kind="stable")
    offsets = np.searchsorted(rows[order], np.arange(len(texts) + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays([spelled, joined]).take(pa.array(order)))


#: Letters, beyond ASCII too, whose upper case has letters of ASCII (``ß``, ``ı``, ligatures).
_GROWS = "[" + "".join(c for c in map(chr, range(0x80, 0x10000)) if re.search("[A-Z]", c.upper())) + "]"
_UP = np.arange(256, dtype=np.uint8)
_UP[97:123] -= 32


def counts_among(texts: pa.Array, words: pa.Array, categories: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of its upper-cased runs of two or more ASCII letters (see ``text.tokenize_upper``), and how many of
    them are ``words`` of each category; ``categories`` has a row per word and a column per category."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not pc.all(pc.string_is_ascii(texts)).as_py():
        grows = pc.match_substring_regex(texts, _GROWS)
        texts = pc.replace_with_mask(texts, grows, pa.array([t.upper() for t in texts.filter(grows).to_pylist()], pa.large_string()))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _UP[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    starts, ends = runs((data >= 65) & (data <= 90), offsets)
    long = ends - starts >= 2
    starts, ends = starts[long], ends[long]
    row = rows_of(starts, offsets)
    total = np.bincount(row, minlength=len(texts))
    # Few runs begin as a word does and are as long; only those are looked up.
    shape = lambda first, second, length: (first.astype(np.int64) << 24) | (second.astype(np.int64) << 16) | np.minimum(length, 0xFFFF)
    spelt = [w.encode() for w in words.to_pylist()]
    first, second, length = (np.array([f(w) for w in spelt if len(w) >= 2], np.int64) for f in (lambda w: w[0], lambda w: w[1], len))
    able = np.isin(shape(data[starts], data[starts + 1], ends - starts), shape(first, second, length))
    starts, ends, row = starts[able], ends[able], row[able]
    code = pc.index_in(spelled(data, starts, ends), value_set=words.cast(pa.large_string()))
    hit = pc.is_valid(code).to_numpy(zero_copy_only=False)
    row, code = row[hit], code.drop_null().to_numpy()
    return total, np.stack([np.bincount(row[of[code]], minlength=len(texts)) for of in categories.T], 1)


def parts(*texts: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """A batch of rows cut so that a part holds PART_BYTES at most, or one row: what is made of a part takes many times that."""
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + PART_BYTES, side="right")), start + 1)
        yield tuple(t.slice(start, stop - start) for t in texts)
        start = stop


def tfidf_terms(c: Column, stop: list[str]) -> Column:
    """Words of two or more letters without stop words, then bigrams over what is left. Lowers the session's Arrow batch."""
    known = frozenset(stop)
    small_batches(SparkSession.active())

    def run(texts: pa.Array) -> pa.Array:
        lists = [term_lists(part, known) for (part,) in parts(texts)]
        return pa.concat_arrays(lists) if lists else term_lists(texts, known)

    return F.arrow_udf(run, "array<string>").asNondeterministic()(c)
