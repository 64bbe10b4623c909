import hashlib
import math
import random
import re
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from filingmill.functions import html, terms
from filingmill.functions.text import dashed_accession, fold_accents, pad_cik, tidy, tokenize_upper
from filingmill.operators import scoring
from filingmill.schemas import CATEGORIES

from plain_html import clean_text, sections_of


def column(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_tokens(spark):
    assert column(spark, "Straße résumé a bc12de", tokenize_upper) == ["STRASSE", "SUM", "BC", "DE"]


def test_accents(spark):
    assert column(spark, "Résumé ÑANDÚ é", fold_accents) == "resume nandu e"


def test_keys(spark):
    assert column(spark, "320193", pad_cik) == "0000320193"
    assert column(spark, "123456789012", pad_cik) == "123456789012"
    assert column(spark, "000032019323000106", dashed_accession) == "0000320193-23-000106"
    assert column(spark, "12", dashed_accession) is None


def test_tidy(spark):
    assert column(spark, " a  b\n\n\n\nTable of Contents\n- 42 -\nPage 3 of 9\n c ", tidy).split() == ["a", "b", "c"]


def test_clean_html(spark):
    clean_text = lambda raw, strip_tables=True: column(spark, raw, lambda c: html.clean(c, strip_tables))
    page = "<html><body><script>x()</script><style>p{}</style><p>One &amp; two</p><table><tr><td>9</td></tr></table><div>three</div></body></html>"
    assert clean_text(page).split() == ["One", "&", "two", "three"]
    assert "9" in clean_text(page, strip_tables=False)
    assert clean_text(None) == clean_text("  ") == ""
    assert clean_text("<ix:a>no page</ix:a>") == "<ix:a>no page</ix:a>"  # one tag does not make a page


def test_sections(spark):
    sections_of = lambda text, form: [tuple(s) for s in column(spark, text, lambda c: html.sections_of(c, F.lit(form)))]
    body = "word " * 60
    text = f"Item 1. Business\n{body}\nItem 1A. Risk Factors\n{body}\nItem 7. Management's Discussion and Analysis\n{body}\nSIGNATURES\n"
    found = {n: w for n, _, w in sections_of(text, "10-K")}
    assert found == {"business": 60, "risk_factors": 60, "mda": 60}
    assert set(n for n, _, _ in sections_of(text, "10-Q")) == {"mda", "risk_factors"}
    assert sections_of("Item 7. Management's Discussion and Analysis\nshort", "10-K") == []


def sections(spark, *texts):
    return spark.createDataFrame(
        [(str(i), "mda", t) for i, t in enumerate(texts)], "filing_id string, section_name string, raw_text string"
    )


def test_dictionary(spark):
    lexicon = spark.createDataFrame([("GOOD", "positive"), ("BAD", "negative"), ("BAD", "litigious")], "word string, category string")
    counts = scoring.category_counts(sections(spark, "good Good bad x1 fine", "", "none here"), lexicon)
    rows = {r.filing_id: r for r in counts.collect()}
    assert (rows["0"].positive, rows["0"].negative, rows["0"].litigious, rows["0"].total_tokens) == (2, 1, 1, 4)
    assert rows["1"].total_tokens == 0
    scored = {r.filing_id: r for r in scoring.dictionary_sentiment(counts).collect()}
    assert "1" not in scored
    assert scored["0"].sentiment_score == 0.25 and scored["0"].confidence == 0.75 and scored["2"].sentiment_score == 0


def cosine(spark, a, b):
    pairs = spark.createDataFrame([("1", "mda", a, b)], "filing_id string, section_name string, raw_text string, prior_text string")
    row = scoring.tfidf_cosine(pairs, ["the", "and"]).first()
    return row and row.similarity_score


def test_cosine(spark):
    a, b = "alpha beta gamma delta", "rho sigma tau"
    assert cosine(spark, a, a) == 1
    assert cosine(spark, a, b) == 0
    assert cosine(spark, "résumé naïve café plan", "resume naive cafe plan") > 0.8
    assert cosine(spark, "the and the", "and the") is None
    assert cosine(spark, a, a + " rho") == cosine(spark, a + " rho", a)


def test_llm_rows(spark):
    tick = "`" * 3
    raw = [
        f'{tick}json\n{{"sentiment_score": 0.5, "confidence": 7, "themes": ["a"], "tone": "Positive", "reasoning": "r"}}\n{tick}',
        '{"sentiment_score": "0.5"}', '{"sentiment_score": 2}', "[1]", "nonsense",
        '{"sentiment_score": -1}', None,
    ]
    rows = scoring.parse_llm_responses(
        spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    ).orderBy("i").collect()
    assert [r.valid for r in rows] == [True, False, False, False, False, True, False]
    assert (
        rows[0].sentiment_score, rows[0].confidence, rows[0].themes, rows[0].tone, rows[0].reasoning
    ) == (0.5, 1.0, ["a"], "positive", "r")
    assert (rows[5].confidence, rows[5].themes, rows[5].tone, rows[5].reasoning) == (0.5, [], "neutral", "")


def test_analyzers(spark):
    known = scoring.Analyzers()
    known.add("length", scoring.scorer(F.length("raw_text")))
    known.add("odd", scoring.scorer(F.when(F.col("filing_id") == "0", 1.0)))
    for bad, error in ((lambda: known.add("odd", None), ValueError), (lambda: known.replace("new", None), KeyError)):
        try:
            bad()
            raise AssertionError("no error")
        except error:
            pass
    good, failed = known.run(sections(spark, "abc", "de"))
    assert good.count() == 3 and failed.count() == 1


def test_tidy_query_cleans_all_documents(spark, tmp_path):
    texts = [
        " a  b \n\n\n\n c\td ", "x\fy", "one\n  Table of Contents  \ntwo\n- 42 -\nthree\nPage 3 of 9\nfour", "plain",
        "two  spaces", "end \nnext"
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text_md5 for r in queries()["tidy_text"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(clean_text(t).encode()).hexdigest() for i, t in enumerate(texts)}


def test_failing_analyzers_do_not_stop_others(spark):
    known = scoring.Analyzers()

    def broken(sections):
        raise RuntimeError("no model")

    known.add("broken", broken)
    known.add("length", scoring.scorer(F.length("raw_text")))
    known.add("odd", scoring.python_scorer(lambda t: 1 / (len(t) - 2)))
    good, failed = known.run(sections(spark, "abc", "de"))
    assert {(r.analyzer_name, r.filing_id) for r in good.collect()} == {("length", "0"), ("length", "1"), ("odd", "0")}
    errors = {(r.analyzer_name, r.filing_id): r.error for r in failed.collect()}
    assert errors[("broken", None)] == "RuntimeError: no model" and errors[("odd", "1")].startswith("ZeroDivisionError")


def test_long_lexicon_is_joined(spark, monkeypatch):
    lexicon = spark.createDataFrame([("GOOD", "positive"), ("BAD", "negative"), ("BAD", "litigious")], "word string, category string")
    rows = sections(spark, "good Good bad x1 fine", "", "none here")
    short = sorted(scoring.category_counts(rows, lexicon).collect())
    monkeypatch.setattr(scoring, "LEXICON_BYTES", 0)
    assert sorted(scoring.category_counts(rows, lexicon).collect()) == short


def test_category_counts_by_the_batch_follow_the_tokens(spark):
    lexicon = spark.createDataFrame(
        [("GOOD", "positive"), ("GOODS", "negative"), ("STRASSE", "negative"), ("STRASSE", "positive"), ("FI", "litigious"), ("A", "uncertainty"), ("lower", "positive")],
        "word string, category string"
    )
    every = [f"ab{chr(c)}cd good{chr(c)} {chr(c)}{chr(c)}" for c in range(0x80, 0x3000)]
    texts = ["good GoodS goo good", "Straße straße STRASSE strasse", "ﬁ ﬁne ﬃ", "a lower LOWER", "", None, "goo", "d ods", "ıſ ŉa", "x1good2 go-od", *every, *map(chr, range(0xFB00, 0xFB18))]
    sections = spark.createDataFrame([(str(i), "mda", t) for i, t in enumerate(texts)], "filing_id string, section_name string, raw_text string")
    counted = scoring.category_counts(sections, lexicon)
    assert "ArrowEvalPython" in counted._jdf.queryExecution().toString() and "regexp_extract_all" not in counted._jdf.queryExecution().toString()
    tokens = {r.filing_id: r.t or [] for r in sections.select("filing_id", tokenize_upper(F.col("raw_text")).alias("t")).collect()}
    of = {c: {r.word for r in lexicon.collect() if r.category == c} for c in CATEGORIES}
    for r in counted.collect():
        found = tokens[r.filing_id]
        assert r.total_tokens == len(found) and all(r[c] == sum(t in of[c] for t in found) for c in CATEGORIES), texts[int(r.filing_id)]


def test_blank_texts_are_told_without_a_walk_through_them(spark):
    schema = "filing_id string, section_name string, raw_text string, prior_text string"
    pairs = spark.createDataFrame([("1", "a", " \n\t", "big cat"), ("2", "a", "big cat", "\x0b \f"), ("3", "a", "\x85 big cat", "big cat"), ("4", "a", None, "big cat")], schema)
    scored = scoring.tfidf_cosine(pairs, [])
    assert {r.filing_id: r.similarity_score for r in scored.collect()} == {"3": 1.0}
    assert "regexp_replace" not in scored._jdf.queryExecution().toString()


def test_words_of_texts_beyond_ascii(monkeypatch):
    """Characters of Latin-1 are looked up by their bytes, only texts with others go through Unicode's tables."""
    points = [*range(0x80, 0x300), *range(0x370, 0x483), *range(0x1D00, 0x1DC0), *range(0x2000, 0x20D0), *range(0xFB00, 0xFB07)]
    every = [f"ab{chr(c)}cd {chr(c)}xy zz{chr(c)} Q" for c in points]
    row, word, known = terms.words_of(pa.array(["", None, *every]), frozenset())
    spelt = known.take(pa.array(word)).to_pylist()
    for i, text in enumerate(every):
        low = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if unicodedata.category(c)[0] != "M")
        low = "".join(c if c < "\x80" or unicodedata.category(c)[0] in "LN" else " " for c in low)
        low = re.sub("[A-Z]", " ", low)  # that decomposition makes
        words = [w for w in re.findall(r"\w+", low) if re.fullmatch("[a-z]{2,}", w)]
        assert [w for r, w in zip(row, spelt, strict=True) if r == i + 2] == words, text
    monkeypatch.setattr(terms.pc, "utf8_normalize", None)
    assert terms.words_of(pa.array(["Une Étude, «naïve» größer"]), frozenset())[2].to_pylist() == ["une", "etude", "naive"]


def counts_of(text, stop):
    low = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    words = [w for w in re.findall(r"\b[a-zA-Z]{2,}\b", low) if w not in stop]
    return Counter(words) + Counter(map(" ".join, zip(words, words[1:])))


def pair_cosine(a, b, most=terms.MAX_TERMS):
    """The closed form, term by term."""
    total = a + b
    kept = set(sorted(total, key=lambda t: (-total[t], t))[:most])
    a, b = ({t: 1 + math.log(n) for t, n in c.items() if t in kept} for c in (a, b))
    own = lambda c, other: sum(x * x * (1 if t in other else terms.ALONE**2) for t, x in c.items())
    xx, yy = own(a, b), own(b, a)
    if not a and not b:
        return None
    return sum(x * b[t] for t, x in a.items() if t in b) / math.sqrt(xx * yy) if xx and yy else 0.0


def test_terms_beyond_the_most_are_ranked():
    a, b = Counter({"a": 3, "b": 1, "c": 1}), Counter({"a": 1, "d": 1})
    assert pair_cosine(a, b, 1) == 1
    assert 0 < pair_cosine(a, b, 2) < 1
    assert pair_cosine(Counter(), Counter()) is None


@pytest.mark.parametrize("most", [1, 2, 5, 10, 10_000])
def test_cosines_of_a_batch_are_those_of_each_pair(most):
    r = random.Random(most)
    words = ["Ab", "abc", "the", "of", "naïve", "x1", "a_b", "straße", "Zürich", "q", "ﬁn", "ab", "é", "день", "e\u0301cole", "—", "ab\u0301d"]
    make = lambda: r.choice([None, "", " ", "The of", "".join(r.choice(words) + r.choice([" ", ", ", "\n", "-", "'"]) for _ in range(r.randint(0, 25)))])
    pairs = [(make(), make()) for _ in range(200)] + [("ab ab", "ab ab"), ("ab", "cd")]
    stop = frozenset(["the", "of"])
    got = terms.cosines(*(pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)), stop, most)
    for (x, y), c in zip(pairs, got, strict=True):
        expected = pair_cosine(counts_of(x or "", stop), counts_of(y or "", stop), most)
        assert (expected is None and math.isnan(c)) or c == pytest.approx(expected, abs=1e-12), (x, y)
    lists = terms.term_lists(pa.array([p[0] for p in pairs], pa.string()), stop).to_pylist()
    assert [Counter(t) for t in lists] == [counts_of(x or "", stop) for x, _ in pairs]
    assert len(terms.cosines(pa.array([], pa.string()), pa.array([], pa.string()), stop)) == 0


def test_an_analyzer_that_fails_while_running_leaves_the_others(spark):
    known = scoring.Analyzers()
    known.add("cast", scoring.scorer(F.col("raw_text").cast("int")))
    known.add("length", scoring.scorer(F.length("raw_text")))
    good, failed = known.run(sections(spark, "12", "no number"))
    assert sorted((r.analyzer_name, r.score) for r in good.collect()) == [("length", 2.0), ("length", 9.0)]
    only = failed.collect()
    assert [(r.analyzer_name, r.filing_id) for r in only] == [("cast", None)] and "CAST_INVALID_INPUT" in only[0].error


PAGES = [
    None, "", " \n", "plain &amp; text &lt;b&gt;", "<html><body>a<b>b</b>c</body></html>", "<p>x<br>y<br/>z</p>", "<p>1<table>2<table>3</table>4</table>5</p>",
    "<p>a</table>b<table>c", "<div><!-- no <p> --><p title='a>b' class=\"x>y\">q</p></div>", "<p>a &lt; b &amp;lt; c &copy; &notit; &notin; &amp &ampx; &unknown; &#65;&#x42; &#0; &#128; &#xD800; &#x110000; &#99999999999; &#x1F600;</p><p>",
    "<p>\u00a0wide\u2003 </p><p>&nbsp;in&nbsp;</p>\n\n\n\n<p>- 42 -</p><p>Page 1 of 2</p><p>Table  of Contents</p>a\fb", "<SCRIPT>var a='<p>';</SCRIPT><P>b</P><STYLE>x</STYLE><script>open",
    "<ix:nonnumeric><p>in</p><span>tag</span></ix:nonnumeric>", "<p>1 < 2 & 3 > 2</p><p>&", "<html><head><title>T</title></head><body></body></html>", "&amp;amp;<p>a</p><div>&amp;amp;</div>", "<p><p>" + "long " * 50_000,
]


def test_pages_against_plain_python(spark):
    pages = PAGES + [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    for strip_tables in (True, False):
        got = dict(map(tuple, rows.select("i", html.clean(F.col("html"), strip_tables)).collect()))
        for i, page in enumerate(pages):
            assert got[i] == clean_text(page, strip_tables), (i, page[:300])


def test_sections_against_plain_python(spark):
    r = random.Random(4)
    heads = [
        "Item 1. Business", "ITEM 1A - Risk Factors", "item 7.\u2014 Management\u2019s Discussion and Analysis", "Item 2 Properties", "Item 7\n", "Item 1A:", "MD & A", "Part II", "PART IV.",
        "SIGNATURES", "Signature page", "Item 6. Reserved", "Item 6. Selected", "Item 8. Financial Statements and Supplementary Data", "Notes to Consolidated Financial\nStatements", "risk\u00a0factors",
        "Item 9 Changes in", "businesses", "Item 15 Exhibits", "Item 1. 2\n\n", "Managements Discussion  and Analysis", "Item 7A Quantitative and Qualitative",
    ]
    texts = []
    for _ in range(150):
        texts.append("\n".join(r.choice([r.choice(heads), r.choice(heads), "word " * r.choice([3, 15, 30, 60]), "", "\n\n\n"]) for _ in range(r.randint(1, 25))))
    forms = ["10-K", "10-Q", "10-K/A", "8-K", ""]
    rows = [(i, forms[i % 5], t) for i, t in enumerate(texts)]
    got = spark.createDataFrame(rows, "i int, form string, t string").select("i", html.sections_of(F.col("t"), F.col("form"), 20).alias("s")).collect()
    for i, s in got:
        assert [tuple(x) for x in s] == sections_of(texts[i], forms[i % 5], 20), (i, forms[i % 5], texts[i])


def test_white_space_class_is_all_of_it(spark):
    """``SPACE`` is the white space that ``BLANKS`` and ``BEYOND`` list, and nothing else below U+3100."""
    from filingmill.functions.text import BEYOND, BLANKS, SPACE

    chars = spark.range(0x3100).select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert {r.c for r in chars.where(F.col("c").rlike(f"^{SPACE}$")).collect()} == set(BLANKS + BEYOND)


def test_page_is_computed_once(spark):
    """Scripts were cut out 16 times in the plan of one page, and once per use when it ran."""
    page = spark.createDataFrame([("<html><body><p>a &amp; b</p></body></html>",)], "html string").select(html.clean(F.col("html")).alias("t"))
    assert page.first().t == "a & b"
    assert page._jdf.queryExecution().optimizedPlan().toString().count("(script|style)") == 1


def test_terms_by_parts(spark, monkeypatch):
    """A batch of any rows is taken apart in parts of bounded bytes, with the same terms; sessions had batches of 10,000 rows."""
    monkeypatch.setattr(terms, "PART_BYTES", 40)
    texts = pa.array(["one two", None, "three " * 50, "", "four five six", "seven eight nine ten eleven"])
    cut = list(terms.parts(texts))
    assert len(cut) == 3 and [x for (p,) in cut for x in p.to_pylist()] == texts.to_pylist()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = spark.createDataFrame([(x,) for x in texts.to_pylist()], "t string").coalesce(1)
    got = [r.t for r in rows.select(terms.tfidf_terms(F.col("t"), []).alias("t")).collect()]
    assert got == terms.term_lists(texts, frozenset()).to_pylist()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
