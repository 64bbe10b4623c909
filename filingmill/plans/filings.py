"""Sources: text, JSON and CSV forms of the given tables, parsed back; documents and their sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingmill.functions import html
from filingmill.functions.text import tidy
from filingmill.operators.returns import daily_returns
from filingmill.sources import adapters, folders
from filingmill.sources import filings as src
from filingmill.sources import prices as px
from filingmill.sources.store import delete_at_end, new_path, stored

from . import standin as S
from .registry import query
from .standin import rounded, with_

_FORM = {"1-URGENT": "10-K", "2-HIGH": "10-Q"}


@query("parse_filing_index", """SELECT substr(x, 1, 10) || '-' || substr(x, 11, 2) || '-' || substr(x, 13,
  6) AS accession_number, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, 'Company ' || o_custkey AS company_name,
  CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' ELSE '10-Q' END AS form_type,
  CAST(o_orderdate AS DATE) AS filed_date,
  'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || x || '/index.htm' AS url, 'C' || o_custkey AS ticker
  FROM (SELECT *, lpad(CAST(o_orderkey AS VARCHAR), 18, '0') AS x FROM orders)
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 11 <> 3 AND o_custkey % 2 = 0""")
def _(spark, d):
    o = S.read(spark, d, "orders")
    form = F.create_map(*[F.lit(x) for kv in _FORM.items() for x in kv])[F.col("o_orderpriority")]
    path = F.concat(F.lit("edgar/data/"), "o_custkey", F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 18, "0"), F.lit("/index.htm"))
    line = F.concat_ws(
        "|", F.concat(F.lit("Company "), "o_custkey"), F.coalesce(form, F.lit("8-K")),
        F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), path
    )
    lines = o.select(F.when(F.col("o_orderkey") % 11 == 3, F.concat(line, F.lit("|x"))).otherwise(line).alias("value"))
    c = S.read(spark, d, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"),
        F.concat(F.lit("C"), "c_custkey").alias("ticker"), (F.col("c_custkey") % 2 == 0).alias("even")
    )
    return src.parse_filing_index(lines, ("10-K", "10-Q"), c.where("even"), c)


def _ticker_rows(spark, d):
    c = S.read(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("g"))
    entry = F.struct(
        F.col("c_custkey").cast("string").alias("k"),
        F.struct(
            F.col("c_custkey").alias("cik_str"), F.concat(F.lit("t"), F.col("c_custkey") % 97).alias("ticker")
        ).alias("v")
    )
    return src.parse_company_tickers(c.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")))  # 100 to a group


@query(
    "parse_company_tickers",
    "SELECT 'T' || (c_custkey % 97) AS ticker, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, "
    "CAST(c_custkey AS INTEGER) AS ordinal FROM customer"
)
def _(spark, d):
    return _ticker_rows(spark, d)


@query(
    "resolve_tickers",
    "SELECT 'T' || (c_custkey % 97) AS ticker, lpad(CAST(max(c_custkey) AS VARCHAR), 10, '0') AS cik FROM customer "
    "GROUP BY ALL"
)
def _(spark, d):
    asked = S.read(spark, d, "customer").select(F.concat(F.lit("t"), F.col("c_custkey") % 97).alias("ticker"))
    return src.resolve_tickers(asked, _ticker_rows(spark, d))


@query("reverse_tickers", "SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, 'T' || (c_custkey % 97) AS ticker FROM customer")
def _(spark, d):
    return src.reverse_tickers(_ticker_rows(spark, d))


@query("explode_submissions", """SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik,
  CAST(o_orderkey AS VARCHAR) AS accession_number, CASE o_orderpriority WHEN '1-URGENT' THEN '10-K'
  ELSE '10-Q' END AS form_type, CAST(o_orderdate AS DATE) AS filed_date,
  'https://www.sec.gov/Archives/edgar/data/' || CASE WHEN o_custkey = 0 THEN ''
  ELSE CAST(o_custkey AS VARCHAR) END || '/' || o_orderkey || '/doc.htm' AS url FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= DATE '1996-01-01'
  AND o_orderdate <= DATE '2000-12-31'""")
def _(spark, d):
    form = F.create_map(*[F.lit(x) for kv in _FORM.items() for x in kv])[F.col("o_orderpriority")]
    one = F.struct(
        F.col("o_orderkey").cast("string").alias("a"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"),
        F.coalesce(form, F.lit("8-K")).alias("f"), (F.col("o_orderkey") % 3).alias("page")
    )
    grouped = S.read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(one).alias("r"))  # one company's filings

    def page(k: int):
        r = F.filter("r", lambda x: x["page"] == k)
        return F.struct(
            r["a"].alias("accessionNumber"), r["d"].alias("filingDate"), r["f"].alias("form"),
            F.transform(r, lambda _: F.lit("doc.htm")).alias("primaryDocument")
        )

    value = F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.struct(page(0).alias("recent")).alias("filings")))
    more = F.array(F.to_json(page(1)), F.to_json(page(2)))  # older filings come as appended pages
    return src.explode_submissions(grouped.select(value.alias("value"), more.alias("pages")), ("10-K", "10-Q"), "1996-01-01", "2000-12-31")


@query(
    "prices_from_csv",
    with_(S.PRICES)
    + "SELECT ticker, date, round(price, 8) AS open, round(price, 8) AS high, round(price, 8) AS low, round(price, "
      "8) AS close, CAST(0 AS BIGINT) AS volume, CAST(NULL AS DOUBLE) AS adj_close, 'csv' AS source FROM prices "
      "WHERE dayofmonth(date) <> 7"
)
def _(spark, d):
    day = F.when(F.dayofmonth("date") == 7, F.lit("n/a")).otherwise(F.col("date").cast("string"))
    rows = S.prices(spark, d).select("ticker", day.alias("Date"), F.col("price").cast("string").alias("Close"))
    return rounded(px.prices_from_rows(rows), 8)


@query(
    "prices_from_chart_json",
    with_(S.PRICES)
    + "SELECT ticker, date, round(price, 8) AS open, round(price, 8) AS high, round(price, 8) AS low, round(price, "
      "8) AS close, CAST(CASE WHEN dayofmonth(date) = 5 THEN 0 ELSE 100 END AS BIGINT) AS volume FROM prices "
      "WHERE dayofmonth(date) <> 7 AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"
)
def _(spark, d):
    p = F.when(F.dayofmonth("date") != 7, F.col("price"))
    one = F.struct(
        F.unix_timestamp(F.col("date").cast("timestamp")).alias("t"), p.alias("p"),
        F.when(F.dayofmonth("date") != 5, F.lit(100)).alias("v")
    )
    g = S.prices(spark, d).groupBy("ticker", F.trunc("date", "month").alias("m")).agg(F.array_sort(F.collect_list(one)).alias("r"))  # one ticker's month
    arrays = F.struct(*[F.col("r.p").alias(k) for k in ("open", "high", "low", "close")], F.col("r.v").alias("volume"))
    value = F.to_json(
        F.struct(F.col("r.t").alias("timestamp"), F.struct(F.array(arrays).alias("quote")).alias("indicators")),
        {"ignoreNullFields": "false"}
    )
    return rounded(
        px.prices_from_chart_json(
            g.select("ticker", value.alias("value")), "1996-01-01", "2000-12-31"
        ).select("ticker", "date", "open", "high", "low", "close", "volume"),
        8
    )


@query(
    "read_filing_documents",
    with_(S.FILINGS)
    + "SELECT cik, filing_id AS accession_number, 'doc.htm' AS name, 0 AS piece, sha256(text) AS text_sha256 "
      "FROM filings JOIN documents ON right(filing_id, 6) = right(lpad(CAST(doc_id AS VARCHAR), 18, '0'), 6)"
)
def _(spark, d):
    """Documents landed as files in three charsets, undeclared, and read back."""
    latin = F.col("text").rlike("^[\\x00-\\x7F\\u00A0-\\u00FF]*$")
    charset = F.when((F.col("lang") == "de") & latin, "windows-1252").when(F.col("lang") == "fr", "utf-16").otherwise("utf-8")
    x = F.lpad(F.col("doc_id").cast("string"), 18, "0")
    texts = S.read(spark, d, "documents").select(S.accession(x).alias("filing_id"), "text", charset.alias("encoding"))
    rows = texts.join(S.filings(spark, d).select("filing_id", "cik"), "filing_id").select(
        "cik", F.col("filing_id").alias("accession_number"), F.lit("doc.htm").alias("name"), "encoding", "text"
    )
    folders.register(spark)
    path = new_path(spark, "documents")
    rows.write.format("filing_folder").mode("append").option("path", path).save()
    delete_at_end(spark, path)
    return src.read_filing_folder(spark, path).select("cik", "accession_number", "name", "piece", F.sha2("html", 256).alias("text_sha256"))


@query(
    "read_prices",
    with_(S.PRICES)
    + "SELECT ticker, date, round(price, 8) AS open, round(price, 8) AS close, CAST(CASE WHEN CAST(substr(ticker, 2) AS INT) % 2 = 0 THEN 7 ELSE 0 "
      "END AS BIGINT) AS volume, CASE WHEN CAST(substr(ticker, 2) AS INT) % 2 = 0 THEN 'yahoo_finance' ELSE 'csv' END AS source "
      "FROM prices WHERE date >= DATE '1996-01-01'"
)
def _(spark, d):
    """Prices landed as one file per ticker, even ones as charts, odd ones as CSV under two headers, and read by the adapters."""
    own, number = S.prices(spark, d), F.substring("ticker", 2, 9).cast("int")
    day = F.struct("date", "price")
    rows = stored(own.groupBy("ticker").agg(F.array_sort(F.collect_list(day)).alias("r")), "ticker_days")  # one ticker's days
    price = F.transform("r", lambda x: x["price"])
    quote = F.struct(*[price.alias(k) for k in ("open", "high", "low", "close")], F.transform("r", lambda x: F.lit(7)).alias("volume"))
    chart = F.to_json(F.struct(
        F.transform("r", lambda x: F.unix_timestamp(x["date"].cast("timestamp"))).alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators")
    ))
    header = F.when(number % 4 == 1, "Date,Close,Notes").otherwise("last,timestamp")
    line = lambda x: F.when(number % 4 == 1, F.concat_ws(",", x["date"], x["price"], F.lit('"a, b"'))).otherwise(F.concat_ws(",", x["price"], x["date"]))
    table = F.array_join(F.concat(F.array(header), F.transform("r", line)), "\n")
    folders.register(spark)
    found = None
    for odd, kind, text in ((0, "chart", chart), (1, "csv", table)):
        path = new_path(spark, kind)
        rows.where(number % 2 == odd).select("ticker", text.alias("text")).write.format(f"{kind}_folder").mode("append").option("path", path).save()
        delete_at_end(spark, path)
        bars = adapters.read_prices(spark, kind, path, start="1996-01-01")
        found = bars if found is None else found.unionByName(bars)
    return rounded(found.select("ticker", "date", "open", "close", "volume", "source"), 8)


@query(
    "returns_from_csv",
    "SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, round(avg(round(l_discount, 4)), "
    "6) AS value, 'ret' AS kind FROM lineitem GROUP BY ALL"
)
def _(spark, d):
    rows = S.read(spark, d, "lineitem").select(
        F.concat(F.lit("S"), "l_suppkey").alias("ticker"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.round("l_discount", 4).cast("string").alias("return"), F.lit("1").alias("price")
    )
    return rounded(px.returns_from_rows(rows), 6)


@query(
    "returns_from_price_csv",
    with_(S.PRICES)
    + "SELECT ticker, date, round(price / lag(price) OVER (PARTITION BY ticker ORDER BY date) - 1, 4) + 0.0 AS ret "
      "FROM prices"
)
def _(spark, d):
    rows = px.returns_from_rows(
        S.prices(spark, d).select(
            "ticker", F.col("date").cast("string").alias("date"), F.col("price").cast("string").alias("adj_close")
        )
    )
    return rounded(daily_returns(rows.select("ticker", "date", F.col("value").alias("price"))))


@query(
    "universe_from_csv",
    with_(S.UNIVERSE)
    + "SELECT ticker, start_date, end_date FROM universe WHERE CAST(substr(ticker, 2) AS INT) % 10 <> 4"
)
def _(spark, d):
    k = F.substring("ticker", 2, 9).cast("int") % 10
    rows = S.universe(spark, d).select(
        F.concat(F.lit(" "), F.lower("ticker"), F.lit("\t")).alias("ticker"),
        F.when(k == 4, F.lit("soon")).otherwise(F.col("start_date").cast("string")).alias("start_date"),
        F.coalesce(F.col("end_date").cast("string"), F.lit(" ")).alias("end_date")
    )
    return src.universe_rows(rows)


@query(
    "lexicon_from_csv",
    """SELECT word, category FROM (SELECT 'W' || (p_partkey % 500) AS word, arg_max(CASE WHEN p_size % 3 = 0 THEN 'negative' WHEN p_size % 3 = 1 THEN 'strong_modal' END, p_partkey) AS category FROM part WHERE p_size % 3 < 2 GROUP BY ALL)"""
)
def _(spark, d):
    k = F.col("p_size") % 3
    rows = S.read(spark, d, "part").select(
        F.concat(F.lit(" w"), F.col("p_partkey") % 500).alias("Word"),
        F.when(k == 0, F.lit("-2020")).otherwise("0").alias("Negative"), F.lit("").alias("Positive"),
        F.when(k == 1, F.lit("2009")).otherwise("0").alias("Strong_Modal_Words"), F.col("p_partkey").alias("ordinal")
    )
    return src.lexicon_from_wide(rows)


def _tidy_sql(text: str) -> str:
    """The operator's replacements, one after the other."""
    steps = (
        ("[ \\t]+", " "), ("\\n{3,}", "\n\n"), ("(?m)^[ \\t\\r\\f\\v]+|[ \\t\\r\\f\\v]+$", ""),
        ("(?im)^\\s*table\\s+of\\s+contents\\s*$", ""), ("(?m)^\\s*-\\s*\\d+\\s*-\\s*$", ""),
        ("(?im)^\\s*page\\s+\\d+\\s+of\\s+\\d+\\s*$", "")
    )
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return f"regexp_replace(translate({text}, chr(12), chr(10)), '^\\s+|\\s+$', '', 'g')"


_NODES = "replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', '<x>', 'g'), '<!--.*?-->', '<x>', 'gs'), chr(11), '')"
_REFERENCES = (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;?", "&"))


def _clean_sql() -> str:
    """Tags cut out, the references that pages hold resolved twice, and the text tidied."""
    text = f"regexp_replace(regexp_replace({_NODES}, '(?:<[!/a-zA-Z][^>]*>)+', chr(11), 'g'), '^\\x0B|\\x0B$', '', 'g')"
    text = f"replace({text}, chr(11), chr(10))"
    for _ in range(2):
        for pattern, by in _REFERENCES:
            text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return _tidy_sql(text)


@query("clean_html", f"SELECT page_id, {_clean_sql()} AS text FROM pages")
def _(spark, d):
    return S.spread(S.read(spark, d, "pages").select("page_id", "html")).select("page_id", html.clean(F.col("html")).alias("text"))


@query("tidy_text", f"SELECT doc_id, md5({_tidy_sql('text')}) AS text_md5 FROM documents")
def _(spark, d):
    return S.read(spark, d, "documents").select("doc_id", F.md5(tidy(F.col("text"))).alias("text_md5"))


_RISK, _MDA = "Item 1A. Risk Factors", "Item 7. Management's Discussion and Analysis"
_M = _MDA.replace("'", "''")
# What follows each heading, and where the later headings stand in it; the first over 100 characters away ends the section.
_SECTIONS_SQL = f"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS filing_id, lang,
  chr(10) || {_tidy_sql("text")} || chr(10) AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT filing_id, 'business' AS section_name, t || '{_RISK}' || t || '{_M}' || t || 'SIGNATURES' AS c, [length(t),
  2 * length(t) + {len(_RISK)}, 3 * length(t) + {len(_RISK) + len(_MDA)}] AS p FROM t WHERE lang = 'en'
  UNION ALL SELECT filing_id, 'risk_factors', t || '{_M}' || t || 'SIGNATURES', [length(t), 2 * length(t) + {len(_MDA)}]
  FROM t UNION ALL SELECT filing_id, 'mda', t || 'SIGNATURES', [length(t)] FROM t),
b AS (SELECT filing_id, section_name, regexp_replace(substr(c, 1, coalesce(list_min(list_filter(p, lambda x: x > 100)),
  length(c))), '^\\s+|\\s+$', '', 'g') AS b FROM c)
SELECT filing_id, section_name, CAST(n AS INTEGER) AS word_count, md5(b) AS text_md5
  FROM (SELECT *, len(regexp_extract_all(b, '\\S+')) AS n FROM b) WHERE n >= 50"""


@query("extract_sections", _SECTIONS_SQL)
def _(spark, d):
    """Filings made of a document under each heading."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    head = lambda h: F.concat(F.lit(f"<p>{h}</p><p>"), text, F.lit("</p>"))
    page = F.concat(F.lit("<html><body>"), head("Item 1. Business"), head(_RISK), head(_MDA), F.lit("<p>SIGNATURES</p></body></html>"))
    rows = S.spread(S.read(spark, d, "documents").select("doc_id", "lang", "text"))
    docs = rows.select(
        F.col("doc_id").cast("string").alias("filing_id"),
        F.when(F.col("lang") == "en", "10-K").otherwise("10-Q").alias("form_type"), page.alias("html")
    )
    return html.extract_sections(docs).select("filing_id", "section_name", "word_count", F.md5("raw_text").alias("text_md5"))
