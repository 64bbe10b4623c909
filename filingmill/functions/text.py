"""Tokens, terms and text clean-up as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at either end (``trim`` removes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokenize_upper(c: Column) -> Column:
    """Upper-cased runs of two or more ASCII letters."""
    return F.regexp_extract_all(F.upper(c), F.lit("[A-Z]{2,}"), F.lit(0))


def _folds() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and a == a.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_accents(c: Column) -> Column:
    """Lower case, Latin accents and combining marks removed."""
    accented, plain = _folds()
    return F.translate(F.regexp_replace(F.lower(c), r"\p{M}+", ""), accented, plain)


def stop_words() -> list[str]:
    """Spark's English list; pass another where scores must follow another vectorizer."""
    return StopWordsRemover.loadDefaultStopWords("english")


def word_count(c: Column) -> Column:
    """White-space separated words."""
    return F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)))


#: White space: of ASCII, and beyond it (as Unicode has it, and the separators of ASCII).
BLANKS = " \t\n\x0b\f\r"
BEYOND = "\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: A pattern of one of both. A letter fails at a table of bits and one range; a class that lists them asks one after the other.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"


def tidy(c: Column, beyond: str = "") -> Column:
    """Spaces, line breaks, page numbers and contents lines of plain text. ``beyond``: characters that are white space too."""
    s, around = SPACE if beyond == BEYOND else f"[\\s{beyond}]", F.lit(BLANKS + beyond)
    # Plain searches in bytes say where the dearer patterns are needed.
    short = lambda c, run, pattern, by: F.when(F.contains(c, F.lit(run)), F.regexp_replace(c, pattern, by)).otherwise(c)
    whole = F.transform(F.array(F.replace(c, F.lit("\t"), F.lit(" "))), lambda c: short(c, "  ", " {2,}", " "))
    whole = F.transform(whole, lambda c: short(c, "\n\n\n", "\n{3,}", "\n\n"))
    trimmed = F.transform(whole, lambda c: F.array_join(F.transform(F.split(c, "\n"), lambda line: F.btrim(line, around)), "\n"))
    # A line is looked for only in texts that hold its words, which is quicker to see.
    without = lambda c, sign, line: F.when(c.rlike(sign), F.regexp_replace(c, line, "")).otherwise(c)
    lines = F.transform(trimmed, lambda c: without(c, "(?i)contents", rf"(?imd)^{s}*table{s}+of{s}+contents{s}*$"))
    lines = F.transform(lines, lambda c: without(c, rf"-{s}*\d+{s}*-", rf"(?md)^{s}*-{s}*\d+{s}*-{s}*$"))
    lines = F.transform(lines, lambda c: without(c, rf"(?i)\d{s}+of{s}", rf"(?imd)^{s}*page{s}+\d+{s}+of{s}+\d+{s}*$"))
    return F.transform(lines, lambda c: F.btrim(F.replace(c, F.lit("\f"), F.lit("\n")), around))[0]


def pad_cik(c: Column) -> Column:
    """Ten digits where the text is digits; longer text is kept (``lpad`` would cut it)."""
    return F.when(F.length(c) < 10, F.lpad(c, 10, "0")).otherwise(c)


def dashed_accession(c: Column) -> Column:
    """18 digits, dashes aside, as 10-2-6; otherwise null."""
    digits = F.regexp_replace(c, "-", "")
    return F.when(
        digits.rlike("^[0-9]{18}$"),
        F.concat_ws("-", F.substring(digits, 1, 10), F.substring(digits, 11, 2), F.substring(digits, 13, 6))
    )
