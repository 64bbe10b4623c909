"""Filing documents to text and sections, as column expressions.

A page is cut at its tags, its character references are looked up between the pieces, and headings are found by splitting a
text at marked matches: lengths of the pieces are summed up to places. Everything runs inside Spark's generated code or its
array functions, without Python.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BEYOND, BLANKS, SPACE, tidy

MIN_WORDS = 50
#: A boundary this near to the start of a section, in characters, is part of its heading.
NEAR = 100
#: Characters in which a page is told by its tags.
HEAD = 5000

# Tags that tell a page; headings of each section in order of trust; boundaries that end a section (both
# titles of item 6 are one); sections of each form.
PAGE_TAGS = ("html", "body", "div", "p", "table", "span", "br", "head")
HEADINGS = {
    "mda": (
        r"Item\s+7[.\s]*[-—]?\s*Management['’]?s?\s+Discussion\s+and\s+Analysis",
        r"Item\s+2[.\s]*[-—]?\s*Management['’]?s?\s+Discussion\s+and\s+Analysis",
        r"Management['’]?s?\s+Discussion\s+and\s+Analysis",
        r"Item\s+7[^A-Z]*$",
        r"MD\s*&\s*A",
    ),
    "risk_factors": (r"Risk\s+Factors", r"Item\s+1A[^A-Z]*$"),
    "business": (r"Business\b", r"Item\s+1[^A-Z0-9]*$"),
    "financial": (
        r"Item\s+8[.\s]*[-—]?\s*Financial\s+Statements\s+and\s+Supplementary\s+Data",
        r"Notes?\s+to\s+(?:Consolidated\s+)?Financial\s+Statements",
    ),
}
BOUNDARIES = (
    r"Item\s+1[.\s]*[-—]?\s*Business\b",
    r"Item\s+1A[.\s]*[-—]?\s*Risk\s+Factors",
    r"Item\s+1B[.\s]*[-—]?\s*Unresolved\s+Staff",
    r"Item\s+2[.\s]*[-—]?\s*Management['’]?s?\s+Discussion",
    r"Item\s+2[.\s]*[-—]?\s*Properties",
    r"Item\s+3[.\s]*[-—]?\s*Legal\s+Proceedings",
    r"Item\s+4[.\s]*[-—]?\s*Mine\s+Safety",
    r"Item\s+5[.\s]*[-—]?\s*Market\s+for",
    r"Item\s+6[.\s]*[-—]?\s*(?:Selected|Reserved)",
    r"Item\s+7[.\s]*[-—]?\s*Management['’]?s?\s+Discussion",
    r"Item\s+7A[.\s]*[-—]?\s*Quantitative\s+and\s+Qualitative",
    r"Item\s+8[.\s]*[-—]?\s*Financial\s+Statements",
    r"Item\s+9[.\s]*[-—]?\s*Changes\s+in",
    r"Item\s+10[.\s]*[-—]?\s*Directors",
    r"Item\s+11[.\s]*[-—]?\s*Executive\s+Compensation",
    r"Item\s+12[.\s]*[-—]?\s*Security\s+Ownership",
    r"Item\s+13[.\s]*[-—]?\s*Certain\s+Relationships",
    r"Item\s+14[.\s]*[-—]?\s*Principal\s+Account",
    r"Item\s+15[.\s]*[-—]?\s*Exhibits",
    r"Part\s+(?:I|II|III|IV)\b",
    r"SIGNATURES?\s*$",
)
FORM_SECTIONS = {
    "10-K": ("mda", "risk_factors", "business", "financial"),
    "10-Q": ("mda", "risk_factors", "financial"),
    "10-K/A": ("mda", "risk_factors", "business", "financial"),
    "10-Q/A": ("mda", "risk_factors", "financial"),
}

def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once: as a lambda's variable; written out, it is computed wherever it stands."""
    return F.transform(F.array(c), use)[0]


def _matcher(*patterns: str) -> str:
    """Any of the patterns, in any case, ^ and $ at line breaks only; a common first word is looked for once. White space beyond
    ASCII is named, since Java's Unicode mode costs several times as much for all the rest."""
    item = r"Item\s+"
    after = [p.removeprefix(item) for p in patterns if p.startswith(item)]
    rest = [p for p in patterns if not p.startswith(item)]
    joined = "|".join([*([f"{item}(?:{'|'.join(after)})"] if after else []), *rest])
    spaced = joined.replace(r"[.\s]", rf"[.\s{BEYOND}]").replace(r"\s", rf"[\s{BEYOND}]").replace(rf"[.[\s{BEYOND}]{BEYOND}]", rf"[.\s{BEYOND}]")
    return "(?imd)" + spaced.replace(r"\b", r"(?![\p{L}\p{N}_])")


_BOUNDARY = _matcher(*BOUNDARIES)
_TAG = r"""<(?:!--[\s\S]*?(?:-->|\z)|/?[A-Za-z][^'">]*+(?:(?:"[^"]*+"|'[^']*+')[^'">]*+)*+>|[!?][^>]*+>)"""
_UNSHOWN = r"(?is)<(script|style)\b[^>]*+>.*?(?:</\1\s*+>|\z)"
_TABLE = r"(?i)<(/?)table\b[^>]*+>"
_REFERENCE = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[^\t\n\f <&#;]{1,32};?)"
_EDITION = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}  # what such numbers are taken for


def _shown(page: Column, strip_tables: bool) -> Column:
    """Text nodes of a page, one to a line: all but tags, comments, scripts, styles and, if asked, tables."""
    shown = F.when(page.rlike("(?i)<s(?:cript|tyle)"), F.regexp_replace(page, _UNSHOWN, "<x>")).otherwise(page)
    nodes = lambda page: F.array_join(F.filter(F.split(page, _TAG), lambda node: node != ""), "\n")
    return _once(shown, lambda page: nodes(_without_tables(page) if strip_tables else page))


def _without_tables(page: Column) -> Column:
    """A page without what stands inside tables."""
    pieces, ends = F.split(page, _TABLE), F.regexp_extract_all(page, F.lit(_TABLE), F.lit(1))
    # A piece follows its tag; what stands inside tables, nested ones too, is left out.
    steps = F.zip_with(F.concat(F.array(F.lit("")), F.transform(ends, lambda e: F.when(e == "/", "-").otherwise("+"))), pieces, lambda sign, text: F.struct(sign.alias("sign"), text.alias("text")))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        depth = F.when(x["sign"] == "+", s["depth"] + 1).when(x["sign"] == "-", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), F.when(depth == 0, F.array_append(s["kept"], x["text"])).otherwise(s["kept"]).alias("kept"))

    whole = F.array_join(F.aggregate(steps, start, step)["kept"], "<x>")
    return F.when(page.rlike(_TABLE), whole).otherwise(page)


def _character(n: Column) -> Column:
    """The character of a numeric reference, as browsers take it."""
    special = F.create_map(*[F.lit(x) for pair in {0: "�", 13: "\r", **_EDITION}.items() for x in pair])
    control = n.between(1, 8) | n.between(14, 31) | n.isin(11, 127) | n.between(0xFDD0, 0xFDEF) | (n % 65536).isin(0xFFFE, 0xFFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (
        F.when(n.isNull() | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�").when(n.isin(0, 13) | n.between(0x80, 0x9F), special[n.cast("int")])
        .when(control, "").otherwise(plain)
    )


def unescape(text: Column) -> Column:
    """Text with its character references resolved; unknown ones stay."""
    return _once(text, _unescaped)


def _unescaped(text: Column) -> Column:
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")

    def resolved(ref: Column) -> Column:
        name = F.substr(ref, F.lit(2))
        digits = F.regexp_replace(name, "^#[xX]?|;$", "")
        hexadecimal = F.lower(F.substr(name, F.lit(2), F.lit(1))) == "x"
        number = F.when(hexadecimal, F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 8, F.conv(digits, 16, 10))).otherwise(digits).try_cast("bigint")
        # A name without a semicolon may go on with other text: the longest beginning that is a name counts.
        shorter = F.filter(
            F.transform(F.reverse(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1)))), lambda n: F.struct(F.element_at(names, F.substr(name, F.lit(1), n)).alias("found"), F.substr(name, n + 1).alias("rest"))),
            lambda s: s["found"].isNotNull()
        )
        begun = F.get(shorter, 0)
        common = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "nbsp;": " "}
        known = F.lit(None).cast("string")
        for k, v in common.items():
            known = F.when(name == k, v).otherwise(known)
        return F.when(F.startswith(name, F.lit("#")), _character(number)).otherwise(
            F.coalesce(known, F.element_at(names, name), F.concat(begun["found"], begun["rest"]), ref)
        )

    pieces, refs = F.split(text, _REFERENCE), F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    joined = F.array_join(F.zip_with(pieces, F.transform(refs, resolved), lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def clean(raw: Column, strip_tables: bool = True) -> Column:
    """Plain text of a filing document; null and blank input give ''."""
    tags = F.regexp_count(F.substr(raw, F.lit(1), F.lit(HEAD)), F.lit(rf"(?i)<(?:{'|'.join(PAGE_TAGS)})\b"))
    text = F.when(tags >= 2, unescape(_shown(raw, strip_tables))).otherwise(raw)
    text = _once(unescape(text), lambda t: tidy(t, BEYOND))
    return F.when(F.coalesce(raw, F.lit("")).rlike(r"\S"), text).otherwise("")


_END = "struct<at:bigint,seen:array<string>,end:bigint>"


def _end(content: Column) -> Column:
    """Where a section ends: of each boundary only the first place after the heading counts, and not one inside the heading."""
    marks, pieces = F.regexp_extract_all(content, F.lit(_BOUNDARY), F.lit(0)), F.split(content, _BOUNDARY)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("seen"), F.lit(None).cast("bigint").alias("end")).cast(_END)

    def named(mark: Column) -> Column:
        """The boundary that was matched: its number and the first word of its title."""
        words = F.trim(F.regexp_replace(F.lower(mark), "[^a-z0-9]+", " "))
        item = F.regexp_extract(words, "^item ([0-9]+[ab]? [a-z]+)", 1)
        return F.when(item == "6 reserved", "6 selected").when(item != "", item).otherwise(F.substr(words, F.lit(1), F.lit(4)))

    def step(s: Column, x: Column) -> Column:
        place, name = s["at"] + F.length(x["text"]), named(x["mark"])
        new = ~F.array_contains(s["seen"], name)
        return F.struct(
            (place + F.length(x["mark"])).alias("at"), F.when(new, F.array_append(s["seen"], name)).otherwise(s["seen"]).alias("seen"),
            F.coalesce(s["end"], F.when(new & (place > NEAR), place)).alias("end"),
        ).cast(_END)

    steps = F.filter(F.zip_with(pieces, marks, lambda text, mark: F.struct(text.alias("text"), mark.alias("mark"))), lambda x: x["mark"].isNotNull())
    return F.coalesce(F.aggregate(steps, start, step)["end"], F.length(content).cast("bigint"))


def sections_of(text: Column, form_type: Column, least: int = MIN_WORDS) -> Column:
    """Array of (section_name, raw_text, word_count) for each section the form has and the text shows."""
    found = []
    for name, headings in HEADINGS.items():
        wanted = form_type.isin(*[f for f, names in FORM_SECTIONS.items() if name in names])
        # The first heading, in order of trust, that stands anywhere, at its first place.
        content = F.coalesce(*[F.get(F.split(text, _matcher(h), 2), 1) for h in headings])
        found.append(F.struct(F.lit(name).alias("section_name"), F.when(wanted, content).alias("content")))
    # Lambda variables let a long expression be used more than once and computed once.
    begun = F.filter(F.array(*found), lambda s: s["content"].isNotNull())
    count = lambda body: F.when(body == "", 0).otherwise(F.size(F.split(body, f"{SPACE}+")))
    ended = F.transform(begun, lambda s: F.struct(s["section_name"].alias("section_name"), strip_wide(F.substr(s["content"], F.lit(1), _end(s["content"]).cast("int"))).alias("body")))
    counted = F.transform(ended, lambda s: F.struct(
        s["section_name"].alias("section_name"), F.regexp_replace(s["body"], "\n{3,}", "\n\n").alias("raw_text"), count(s["body"]).alias("word_count")
    ))
    return F.filter(counted, lambda s: s["word_count"] >= least)


def strip_wide(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS + BEYOND))


def extract_sections(documents: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """From (filing_id, form_type, html): filing_id, section_name, raw_text, word_count."""
    cleaned = documents.select("filing_id", F.coalesce("form_type", F.lit("")).alias("form_type"), clean(F.col("html")).alias("text"))
    return cleaned.select("filing_id", F.inline(sections_of(F.col("text"), F.col("form_type"), least)))
