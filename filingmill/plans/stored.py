"""Look-ups, validation, set operations, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingmill.operators import catalog, portfolio, returns, scoring, validate
from filingmill.sources import sinks
from filingmill.sources.store import delete_at_end, new_path, stored
from filingmill.sources.tables import KeyedTable

from . import standin as S
from .backtests import END, START, days
from .registry import query
from .standin import rounded, with_

_F = with_(S.FILINGS)
_FCOLS = "filing_id, ticker, form_type, filed_date"


@query(
    "list_filings",
    _F
    + f"SELECT {_FCOLS} FROM filings WHERE upper(ticker) = 'SRC1' AND form_type = '10-K' "
      f"AND filed_date BETWEEN DATE '2020-06-01' AND DATE '2023-06-30'"
)
def _(spark, d):
    return catalog.list_filings(
        S.filings(spark, d), "Src1", "10-K", "2020-06-01", "2023-06-30"
    ).select("filing_id", "ticker", "form_type", "filed_date")


@query("list_filings_page", _F + f"SELECT {_FCOLS} FROM filings ORDER BY filed_date DESC, filing_id LIMIT 50")
def _(spark, d):
    return catalog.list_filings(S.filings(spark, d), limit=50).select("filing_id", "ticker", "form_type", "filed_date")


@query(
    "get_signals",
    with_(*S.TO_SIMILARITY, S.RAW)
    + "SELECT ticker, signal_date, signal_name, raw_value + 0.0 AS raw_value FROM raw WHERE ticker = 'src2' "
      "AND signal_date BETWEEN DATE '2020-06-01' AND DATE '2023-06-30' AND signal_name = 'dictionary_mda'"
)
def _(spark, d):
    return rounded(
        catalog.get_signals(
            S.raw(spark, d), "src2", "2020-06-01", "2023-06-30", "dictionary_mda"
        ).select("ticker", "signal_date", "signal_name", "raw_value"),
        6
    )


@query(
    "get_composites",
    with_(S.SCORES)
    + "SELECT ticker, signal_date, round(composite_score, 6) + 0.0 AS composite_score FROM scores "
      "WHERE ticker = 'S7' AND signal_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"
)
def _(spark, d):
    return rounded(catalog.get_composites(S.scores(spark, d), "S7", "1996-01-01", "2000-12-31"), 6)


@query(
    "signal_screen",
    with_(S.SCORES)
    + "SELECT *, (SELECT count(*) FROM scores WHERE composite_score BETWEEN -0.2 AND 0.2) AS total "
      "FROM (SELECT ticker, signal_date, round(composite_score, 6) + 0.0 AS composite_score FROM scores "
      "WHERE composite_score BETWEEN -0.2 AND 0.2 ORDER BY scores.composite_score DESC, ticker, "
      "signal_date LIMIT 50 OFFSET 20)"
)
def _(spark, d):
    return rounded(catalog.signal_screen(S.scores(spark, d), -0.2, 0.2, offset=20), 6)


@query(
    "get_bars",
    with_(S.PRICES)
    + "SELECT ticker, date, round(price, 8) AS price FROM prices WHERE ticker = 'S3' "
      "AND date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'"
)
def _(spark, d):
    return rounded(catalog.get_bars(S.prices(spark, d), "S3", "1998-01-01", "1999-12-31"), 8)


@query(
    "get_sentiments",
    with_(*S.TO_SENTIMENT)
    + "SELECT filing_id, section_name, sentiment_score + 0.0 AS sentiment_score FROM sentiment "
      "WHERE filing_id = '0000000000-00-000003' AND section_name = 'mda'"
)
def _(spark, d):
    return rounded(
        catalog.get_sentiments(
            S.sentiment(spark, d), "0000000000-00-000003", "mda", "dictionary"
        ).select("filing_id", "section_name", "sentiment_score"),
        6
    )


@query(
    "get_similarity",
    with_(*S.TO_SIMILARITY)
    + "SELECT filing_id, section_name, prior_filing_id, similarity_score + 0.0 AS similarity_score FROM similarity "
      "WHERE filing_id = '0000000000-00-000090'"
)
def _(spark, d):
    return rounded(
        catalog.get_sentiments(S.similarity(spark, d), "0000000000-00-000090").select(
            "filing_id", "section_name", "prior_filing_id", "similarity_score"
        ),
        6
    )


@query(
    "validate_filings",
    _F
    + "SELECT filing_id, CASE WHEN length(cik) < 10 THEN lpad(cik, 10, '0') ELSE cik END AS cik, k <> 1 AND k <> 2 "
      "AND k <> 3 AS valid FROM (SELECT filing_id, CASE WHEN k = 1 THEN 'x' || cik "
      "ELSE ltrim(cik, '0') END AS cik, k FROM (SELECT *, CAST(right(filing_id, 6) AS INT) % 7 AS k FROM filings))"
)
def _(spark, d):
    k = F.substring("filing_id", -6, 6).cast("int") % 7
    bad = S.filings(spark, d).select(
        "filing_id", F.regexp_replace("filing_id", "-", "").alias("accession_number"),
        F.when(k == 1, F.concat(F.lit("x"), "cik")).otherwise(F.regexp_replace("cik", "^0+", "")).alias("cik"),
        F.when(k == 2, F.lit("http://x")).otherwise(F.col("url")).alias("url"),
        F.when(k == 3, F.lit("8-K")).otherwise(F.col("form_type")).alias("form_type"),
    )
    return validate.validate_filings(bad).select("filing_id", "cik", "valid")


@query(
    "validate_scores",
    with_(*S.TO_SIMILARITY)
    + "SELECT filing_id, section_name, CAST(right(filing_id, 6) AS INT) % 5 NOT IN (1, 2) AS valid FROM similarity"
)
def _(spark, d):
    k = F.substring("filing_id", -6, 6).cast("int") % 5
    rows = S.similarity(spark, d).withColumn("similarity_score", F.when(k == 1, 1.5).otherwise(F.col("similarity_score"))).withColumn(
        "change_score", F.when(k == 2, F.col("change_score") + 0.5).otherwise(F.col("change_score"))
    )
    return validate.validate_scores(rows).select("filing_id", "section_name", "valid")


@query(
    "validate_bars",
    with_(S.PRICES)
    + "SELECT ticker, date, round(price, 8) AS adjusted_close, dayofmonth(date) <> 13 AS valid FROM prices"
)
def _(spark, d):
    p = F.col("price")
    bars = S.prices(spark, d).select(
        "ticker", "date", p.alias("high"), F.when(F.dayofmonth("date") == 13, p + 1).otherwise(p).alias("low"),
        p.alias("close"), F.lit(None).cast("double").alias("adj_close"), F.lit(1).alias("volume")
    )
    return rounded(validate.validate_bars(bars).select("ticker", "date", "adjusted_close", "valid"), 8)


@query(
    "quarantine",
    with_(S.PRICES)
    + "SELECT ticker, date, dayofmonth(date) <> 13 AS valid, (SELECT count(*) FROM prices WHERE dayofmonth(date) <> 13) AS n_valid, "
      "(SELECT count(*) FROM prices WHERE dayofmonth(date) = 13) AS n_bad FROM prices"
)
def _(spark, d):
    """Bars checked and written in one pass; both parts read back, with the counts of that pass."""
    p = F.col("price")
    low = F.when(F.dayofmonth("date") == 13, p + 1).otherwise(p).alias("low")
    bars = S.prices(spark, d).select("ticker", "date", p.alias("high"), low, p.alias("close"), F.lit(None).cast("double").alias("adj_close"), F.lit(1).alias("volume"))
    path = new_path(spark, "quarantine")
    made = validate.quarantine(validate.validate_bars(bars), path)
    delete_at_end(spark, path)
    parts = made.valid.select("ticker", "date", F.lit(True).alias("valid")).unionByName(made.bad.select("ticker", "date", "valid"))
    return parts.select("*", F.lit(made.n_valid).cast("long").alias("n_valid"), F.lit(made.n_bad).cast("long").alias("n_bad"))


@query(
    "word_count_drift",
    with_(S.FILINGS, S.SECTIONS)
    + "SELECT filing_id, section_name, word_count AS counted, word_count > 0 "
      "AND abs(word_count + 20 - word_count) > 0.1 * word_count AS drifted FROM sections"
)
def _(spark, d):
    s = S.sections(spark, d).withColumn("word_count", F.col("word_count") + 20)
    return validate.word_count_drift(s).select("filing_id", "section_name", F.col("counted").cast("long").alias("counted"), "drifted")


_CASES = {
    "good": {}, "dates": {"start": END, "end": START}, "long": {"long_quantile": 6}, "short": {"short_quantile": 0},
    "half_life": {"half_life": 0}, "empty": {"universe": []},
    "weights": {"weighting": "custom", "weights": {}}, "given": {"weighting": "custom", "weights": {"a": 1.0}},
}
_SAID = {
    "dates": "start must be before end", "long": "quantile 6 is not in 1..5", "short": "quantile 0 is not in 1..5",
    "half_life": "half_life must be at least 1", "empty": "the universe is empty",
    "weights": "custom weights are empty",
}


def _said(**case) -> str:
    try:
        portfolio.check_params(
            **{
                "start": START, "end": END, "universe": ["A"], "quantiles": 5, "long_quantile": 1,
                "short_quantile": 5, **case
            }
        )
    except ValueError as e:
        return str(e)
    return "ok"


@query(
    "check_params",
    with_(S.UNIVERSE) + "SELECT c AS name, said, members FROM (VALUES "
    + ", ".join(f"('{c}', '{_SAID.get(c, 'ok')}')" for c in _CASES)
    + ") AS v(c, said), (SELECT count(DISTINCT ticker) AS members FROM universe)"
)
def _(spark, d):
    """What the operator says of each case, with the size of the universe that the good case is for."""
    rows = spark.createDataFrame([(c, _said(**case)) for c, case in _CASES.items()], "name string, said string")
    return rows.join(S.universe(spark, d).agg(F.countDistinct("ticker").alias("members")))


@query(
    "new_only",
    with_(*S.TO_SIMILARITY)
    + "SELECT filing_id, section_name FROM sections ANTI JOIN (SELECT filing_id FROM similarity) USING (filing_id)"
)
def _(spark, d):
    return sinks.new_only(S.sections(spark, d), S.similarity(spark, d), ["filing_id"]).select("filing_id", "section_name")


@query(
    "upsert",
    "SELECT doc_id, coalesce(q, 9) AS quality FROM (SELECT doc_id FROM documents) LEFT "
    "JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY ALL) USING (doc_id)"
)
def _(spark, d):
    old = S.read(spark, d, "documents").select("doc_id", F.lit(9).alias("quality"))
    lab = S.read(spark, d, "labels").select("doc_id", "quality")
    new = lab.select("doc_id", (F.col("quality") + 5).alias("quality"), F.lit(1).alias("n")).unionByName(lab.withColumn("n", F.lit(2)))
    return sinks.upsert(old, new, ["doc_id"], "n")


@query(
    "upsert_stored",
    with_(*S.TO_SIMILARITY, S.RAW)
    + "SELECT ticker, filing_id, signal_name, signal_date, CASE WHEN signal_date >= DATE '2023-01-01' THEN raw_value + 1 "
      "ELSE raw_value END + 0.0 AS raw_value FROM raw"
)
def _(spark, d):
    """Signals stored by month; those since 2023 scored again, in two loads, and merged into their months."""
    raw = stored(S.raw(spark, d).withColumn("month", F.date_format("signal_date", "yyyyMM")), "raw")
    table = KeyedTable(spark, new_path(spark, "signals"), ("filing_id", "signal_name", "signal_date"), by="month")
    delete_at_end(spark, table.path)
    table.upsert(raw.withColumn("load", F.lit(1)), "load")
    again = raw.where("signal_date >= date'2023-01-01'")
    first = again.withColumn("raw_value", F.col("raw_value") + 9).withColumn("load", F.lit(1))
    table.upsert(first.unionByName(again.withColumn("raw_value", F.col("raw_value") + 1).withColumn("load", F.lit(2))), "load")
    return rounded(table.read().select("ticker", "filing_id", "signal_name", "signal_date", "raw_value"), 6)


@query(
    "replace_sections_stored",
    with_(S.FILINGS, S.SECTIONS)
    + "SELECT filing_id, section_name, sha256(raw_text) AS text_sha256 FROM sections WHERE filing_id NOT IN (SELECT filing_id "
      "FROM filings WHERE form_type = '10-K') OR section_name = 'risk_factors'"
)
def _(spark, d):
    """Sections stored by a hash of their filing; annual reports saved again, with their risk factors if they have any."""
    sections = S.sections(spark, d)
    table = KeyedTable(spark, new_path(spark, "sections"), ("filing_id", "section_name"), spread=("filing_id",))
    delete_at_end(spark, table.path)
    table.upsert(sections.withColumn("load", F.lit(1)), "load")
    saved = S.filings(spark, d).where("form_type = '10-K'").select("filing_id")
    table.replace(saved, sections.where("section_name = 'risk_factors'").join(saved, "filing_id", "left_semi"))
    return table.read().select("filing_id", "section_name", F.sha2("raw_text", 256).alias("text_sha256"))


@query(
    "replace_sections",
    with_(S.FILINGS, S.SECTIONS)
    + "SELECT filing_id, section_name FROM sections WHERE filing_id NOT IN (SELECT filing_id FROM filings "
      "WHERE form_type = '10-K') OR section_name = 'mda'"
)
def _(spark, d):
    s, f = S.sections(spark, d).select("filing_id", "section_name"), S.filings(spark, d).where("form_type = '10-K'")
    return sinks.replace_sections(s, f, s.where("section_name = 'mda'").join(f.select("filing_id"), "filing_id", "left_semi"))


@query(
    "signals_wide",
    with_(*S.TO_COMPOSITES)
    + "SELECT ticker, signal_date, max(composite_score) + 0.0 AS composite_score, max(rank) AS rank, "
    + ", ".join(
        f"CAST(max(e) FILTER (signal_name = '{n}') AS DOUBLE) + 0.0 AS {n}"
        for n in ("dictionary_mda", "dictionary_risk_factors", "similarity_mda", "similarity_risk_factors")
    )
    + " FROM composites LEFT JOIN (SELECT as_of AS signal_date, ticker, signal_name, "
      "round(CAST(weight * own AS DECIMAL(20, 10)), 6) AS e FROM weighed) USING (ticker, signal_date) GROUP BY ALL"
)
def _(spark, d):
    wide = sinks.signals_wide(S.composites(spark, d))
    return wide.select(
        "ticker", "signal_date", (F.col("composite_score") + 0.0).alias("composite_score"), "rank",
        *[(F.round(c, 6) + 0.0).alias(c) for c in wide.columns[4:]]
    )


_JSON = (
    "SELECT ticker, signal_date, max(composite_score) + 0.0 AS composite_score, max(rank) AS rank, "
    "CAST(count(e) AS INTEGER) AS n_components, round(sum(e), 4) + 0.0 AS total FROM composites"
)
_WEIGHED = "(SELECT as_of AS signal_date, ticker, CAST(weight * own AS DECIMAL(20, 10)) AS e FROM weighed)"


@query("signals_json", with_(*S.TO_COMPOSITES) + f"{_JSON} LEFT JOIN {_WEIGHED} USING (ticker, signal_date) GROUP BY ALL")
def _(spark, d):
    """Composites written as JSON files and read back."""
    path = new_path(spark, "signals-json")
    sinks.write_signals_json(S.composites(spark, d), path)
    delete_at_end(spark, path)
    back = spark.read.schema("ticker string, signal_date date, composite_score double, rank int, components map<string,double>").json(path)
    total = F.round(F.aggregate(F.map_values("components"), F.lit(0.0), lambda a, x: a + x), 4)
    return back.select(
        "ticker", "signal_date", (F.col("composite_score") + 0.0).alias("composite_score"), "rank",
        F.size("components").alias("n_components"), (total + 0.0).alias("total")
    )


_REPORT = """per AS (SELECT signal_date, count(*) AS n, round(avg(composite_score), 6) + 0.0 AS net FROM scores GROUP BY ALL)
SELECT 'period' AS part, CAST(signal_date AS VARCHAR) AS name, net AS value FROM per
  UNION ALL SELECT 'signals', CAST(signal_date AS VARCHAR), n FROM per
UNION ALL SELECT 'metric', 'best', round(max(composite_score), 6) + 0.0 FROM scores
  UNION ALL SELECT 'metric', 'worst', round(min(composite_score), 6) + 0.0 FROM scores"""


@query("backtest_report", with_(S.SCORES).rstrip() + ",\n" + _REPORT)
def _(spark, d):
    s = S.scores(spark, d)
    net = F.round(F.avg("composite_score"), 6).alias("net")
    measured = s.agg(F.round(F.max("composite_score"), 6).alias("best"), F.round(F.min("composite_score"), 6).alias("worst"))
    report = sinks.backtest_report(
        s.groupBy(F.col("signal_date").alias("period_start")).agg(net), measured,
        s.groupBy("signal_date").agg(F.count("*").alias("n"))
    )
    kind = "struct<periods:array<struct<period_start:string,net:double>>,metrics:array<struct<best:double,worst:double>>,signals:array<struct<signal_date:string,n:bigint>>>"
    entry = lambda part, name, value: F.struct(F.lit(part).alias("part"), name.alias("name"), (value + 0.0).alias("value"))
    rows = F.concat(
        F.transform("j.periods", lambda x: entry("period", x["period_start"], x["net"])),
        F.transform("j.signals", lambda x: entry("signals", x["signal_date"], x["n"].cast("double"))),
        F.transform("j.metrics", lambda x: entry("metric", F.lit("best"), x["best"])),
        F.transform("j.metrics", lambda x: entry("metric", F.lit("worst"), x["worst"])),
    )
    return report.select(F.from_json("report", kind).alias("j")).select(F.inline(rows))


@query(
    "latest_filing",
    _F
    + "SELECT cik, form_type, arg_max(filing_id, (filed_date, filing_id)) AS filing_id, "
      "max(filed_date) AS filed_date FROM filings GROUP BY cik, form_type"
)
def _(spark, d):
    return catalog.latest_filing(S.filings(spark, d))


@query(
    "latest_signals_per_ticker",
    with_(S.SCORES)
    + "SELECT ticker, signal_date, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY ticker "
      "ORDER BY signal_date DESC) AS r FROM scores) WHERE r <= 10"
)
def _(spark, d):
    return catalog.latest_signals_per_ticker(S.scores(spark, d)).select("ticker", "signal_date", "r")


@query("latest_filings_per_ticker", with_(S.FILINGS, S.SECTIONS, S.PRIOR) + """SELECT filing_id, ticker,
  CAST(r AS INTEGER) AS r, array_to_string(n, ',') AS sections, filing_id IN (SELECT filing_id
  FROM pairs) AS has_similarity FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filed_date DESC,
  filing_id) AS r FROM filings)
  JOIN (SELECT filing_id, list(section_name ORDER BY section_name) AS n FROM sections GROUP BY ALL) USING (filing_id) WHERE r <= 20""")
def _(spark, d):
    f, s = S.filings(spark, d), S.sections(spark, d)
    pairs = scoring.prior_section_pairs(f, s)
    status = catalog.analysis_status(f, s.select("filing_id", F.lit("dictionary").alias("analyzer_name")), pairs)
    return catalog.latest_filings_per_ticker(f, s, status).select(
        "filing_id", "ticker", "r", F.array_join("sections", ",").alias("sections"), "has_similarity"
    )


@query(
    "analysis_status",
    with_(*S.TO_SIMILARITY)
    + "SELECT filing_id, filing_id IN (SELECT filing_id FROM sentiment) AS has_dictionary, "
      "filing_id IN (SELECT filing_id FROM similarity) AS has_similarity, false AS has_llm FROM filings"
)
def _(spark, d):
    return catalog.analysis_status(S.filings(spark, d), S.sentiment(spark, d), S.similarity(spark, d))


@query(
    "section_names",
    with_(S.FILINGS, S.SECTIONS)
    + "SELECT filing_id, string_agg(section_name, ',' ORDER BY section_name) AS sections FROM sections "
      "GROUP BY filing_id"
)
def _(spark, d):
    return catalog.section_names(S.sections(spark, d)).select("filing_id", F.array_join("sections", ",").alias("sections"))


@query(
    "filing_detail",
    with_(*S.TO_SIMILARITY)
    + "SELECT filing_id, ticker, (SELECT count(*) FROM sections s "
      "WHERE s.filing_id = f.filing_id) AS n_sections, (SELECT count(*) FROM sentiment s "
      "WHERE s.filing_id = f.filing_id) AS n_sentiment, (SELECT count(*) FROM similarity s "
      "WHERE s.filing_id = f.filing_id) AS n_similarity FROM filings f"
)
def _(spark, d):
    f = catalog.filing_detail(S.filings(spark, d), S.sections(spark, d), S.sentiment(spark, d), S.similarity(spark, d))
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return f.select(
        "filing_id", "ticker", n("sections").alias("n_sections"), n("sentiment").alias("n_sentiment"),
        n("similarity").alias("n_similarity")
    )


@query(
    "filing_detail_values",
    with_(*S.TO_SIMILARITY)
    + """SELECT filing_id, ticker, form_type, filed_date,
  (SELECT string_agg(section_name || '=' || word_count, ',' ORDER BY section_name) FROM sections s WHERE s.filing_id = f.filing_id) AS words,
  (SELECT round(sum(sentiment_score), 6) + 0.0 FROM sentiment s WHERE s.filing_id = f.filing_id) AS sentiment,
  (SELECT string_agg(section_name, ',' ORDER BY section_name) FROM sentiment s WHERE s.filing_id = f.filing_id) AS scored,
  (SELECT round(sum(similarity_score), 6) + 0.0 FROM similarity s WHERE s.filing_id = f.filing_id) AS similarity,
  (SELECT round(sum(change_score), 6) + 0.0 FROM similarity s WHERE s.filing_id = f.filing_id) AS change FROM filings f"""
)
def _(spark, d):
    """Every value of the records: words by section, scored sections, scores."""
    f = catalog.filing_detail(S.filings(spark, d), S.sections(spark, d), S.sentiment(spark, d), S.similarity(spark, d))
    total = lambda c, field: F.aggregate(c, F.lit(0.0), lambda a, x: a + x[field])
    word = lambda e: F.concat_ws("=", e["key"], e["value"])
    rows = f.select(
        "filing_id", "ticker", "form_type", "filed_date", F.array_join(F.transform(F.array_sort(F.map_entries("sections")), word), ",").alias("words"),
        total("sentiment", "sentiment_score").alias("sentiment"), F.array_join(F.transform("sentiment", lambda x: x["section_name"]), ",").alias("scored"),
        total("similarity", "similarity_score").alias("similarity"), total("similarity", "change_score").alias("change"),
    )
    return rounded(rows, 6)


@query(
    "table_counts",
    with_(S.FILINGS, S.SECTIONS, S.SCORES)
    + "SELECT 'filings' AS table_name, count(*) AS n FROM filings UNION ALL SELECT 'sections', count(*) "
      "FROM sections UNION ALL SELECT 'composites', count(*) FROM scores"
)
def _(spark, d):
    return catalog.table_counts({"filings": S.filings(spark, d), "sections": S.sections(spark, d), "composites": S.scores(spark, d)})


@query(
    "coverage_status",
    with_(S.FILINGS, S.SCORES)
    + "SELECT count(*) AS filings, count(DISTINCT ticker) AS tickers, min(filed_date) AS first_filed, "
      "max(filed_date) AS last_filed, (SELECT count(*) FROM scores) AS composites, (SELECT max(signal_date) "
      "FROM scores) AS last_signal FROM filings"
)
def _(spark, d):
    return catalog.coverage_status(S.filings(spark, d), S.scores(spark, d))


@query("distinct_tickers", _F + "SELECT DISTINCT ticker FROM filings WHERE ticker IS NOT NULL")
def _(spark, d):
    return catalog.distinct_tickers(S.filings(spark, d))


@query(
    "common_sections",
    with_(S.FILINGS, S.SECTIONS)
    + "SELECT section_name FROM sections JOIN filings USING (filing_id) "
      "WHERE form_type = '10-K' INTERSECT SELECT section_name FROM sections JOIN filings USING (filing_id) "
      "WHERE form_type = '10-Q'"
)
def _(spark, d):
    s = S.sections(spark, d).join(S.filings(spark, d).select("filing_id", "form_type"), "filing_id")
    return catalog.common_sections(s.where("form_type = '10-K'"), s.where("form_type = '10-Q'"))


@query(
    "raw_signal_union",
    with_(*S.TO_SIMILARITY, S.RAW)
    + "SELECT signal_name, count(*) AS n, count(DISTINCT filing_id) AS filings, round(sum(raw_value), 3) + 0.0 AS total, min(signal_date) AS first, "
      "max(signal_date) AS last FROM raw GROUP BY ALL"
)
def _(spark, d):
    return rounded(S.raw(spark, d).groupBy("signal_name").agg(
        F.count("*").alias("n"), F.count_distinct("filing_id").alias("filings"), F.sum("raw_value").alias("total"),
        F.min("signal_date").alias("first"), F.max("signal_date").alias("last")
    ), 3)


@query(
    "universe_superset",
    with_(S.UNIVERSE)
    + "SELECT 'S' || s_suppkey AS ticker FROM supplier WHERE s_suppkey % 10 = 0 UNION SELECT ticker FROM universe "
      "WHERE end_date IS NULL OR end_date >= DATE '1995-03-31'"
)
def _(spark, d):
    static = S.read(spark, d, "supplier").where("s_suppkey % 10 = 0").select(F.concat(F.lit("S"), "s_suppkey").alias("ticker"))
    return catalog.universe_superset(static, portfolio.universe_on_date(days(spark), S.universe(spark, d)))


@query(
    "missing_tickers",
    with_(S.PRICES)
    + "SELECT DISTINCT 'S' || c_custkey AS ticker FROM customer WHERE 'S' || c_custkey NOT IN (SELECT ticker "
      "FROM prices)"
)
def _(spark, d):
    return returns.missing_tickers(
        S.read(spark, d, "customer").select(F.concat(F.lit("S"), "c_custkey").alias("ticker")), S.prices(spark, d)
    )
