import json
from datetime import date

import pytest

from filingmill.sources import filings, prices, sinks


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_index(spark):
    got = filings.parse_filing_index(lines(
        spark, "Company|Form|CIK|Date|Path", "---",
        "Apple|10-K|320193|2023-11-03|edgar/data/320193/0000320193-23-000106.txt/x", "B|8-K|1|2023-01-01|a/b/c/d",
        "C|10-Q|2|bad|a/b/c/d", "D|10-Q|2|2023-01-01|a/b"
    ), ("10-K", "10-Q")).collect()
    assert [(r.accession_number, r.cik, r.filed_date) for r in got] == [("0000320193-23-000106.txt", "0000320193", date(2023, 11, 3))]


def test_tickers(spark):
    rows = filings.parse_company_tickers(lines(spark, json.dumps({"0": {"cik_str": 1, "ticker": "a"}, "1": {"cik_str": 2, "ticker": "A"}})))
    asked = spark.createDataFrame([("a",)], "ticker string")
    assert [tuple(r) for r in filings.resolve_tickers(asked, rows).collect()] == [("A", "0000000002")]


def test_submissions_of_unequal_length(spark):
    raw = json.dumps(
        {
            "cik": "5",
            "filings": {
                "recent": {
                    "accessionNumber": ["1-1", "1-2"], "filingDate": ["2024-01-01"], "form": ["10-K", "10-K"],
                    "primaryDocument": []
                }
            }
        }
    )
    got = filings.explode_submissions(lines(spark, raw), ("10-K",)).collect()
    assert [(r.accession_number, r.url.rsplit("/", 1)[1]) for r in got] == [("1-1", "")]


def test_price_rows(spark):
    rows = spark.createDataFrame(
        [("A", "2024-01-02", "10", "11"), ("A", "x", "10", "1"), ("A", "2024-01-03", "", "1")],
        "ticker string, Date string, Close string, `Adj Close` string"
    )
    got = prices.prices_from_rows(rows).collect()
    assert len(got) == 1 and (got[0].open, got[0].close, got[0].volume, got[0].adj_close, got[0].source) == (10, 10, 0, 11, "csv")
    with pytest.raises(ValueError, match="close"):
        prices.prices_from_rows(rows.drop("Close", "Adj Close"))


def test_chart(spark):
    q = {"open": [1.0, None], "high": [2.0, 2.0], "low": [1.0, 1.0], "close": [1.5, 1.5], "volume": [None, 5]}
    raw = spark.createDataFrame(
        [("A", json.dumps({"timestamp": [1704153600, 1704240000], "indicators": {"quote": [q]}}))],
        "ticker string, value string"
    )
    got = prices.prices_from_chart_json(raw).collect()
    assert [(r.date, r.volume, r.adj_close) for r in got] == [(date(2024, 1, 2), 0, None)]


def test_repeated_returns_are_averaged(spark):
    rows = spark.createDataFrame([("A", "2024-01-02", "0.1"), ("A", "2024-01-02", "0.3")], "ticker string, date string, ret string")
    assert prices.returns_from_rows(rows).first().value == pytest.approx(0.2)


def test_universe(spark):
    rows = spark.createDataFrame(
        [
            (" a ", "2020-01-01", ""), ("b", "bad", ""), ("c", "2020-01-01", "bad"), ("", "2020-01-01", ""),
            ("d", "2020-01-01", "2021-01-01")
        ],
        "ticker string, start_date string, end_date string"
    )
    assert sorted((r.ticker, r.end_date) for r in filings.universe_rows(rows).collect()) == [("A", None), ("D", date(2021, 1, 1))]


def test_lexicon_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Word,Negative,Positive,Strong Modal\nbad,2009,0,0\nok,0,-2020,\nnone,0,0,0\nbad,0,1,0\n")
    got = sorted(tuple(r) for r in filings.lexicon_from_csv(spark, str(tmp_path / "l.csv")).collect())
    assert got == [("BAD", "positive"), ("OK", "positive")]


def test_documents(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>one\ntwo</p>")
    got = filings.read_filing_documents(spark, str(tmp_path)).first()
    assert got.html == "<p>one\ntwo</p>" and got.path.endswith("a.html")


def test_upsert_and_files(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, ["k"], "n").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    c = spark.createDataFrame(
        [("A", date(2024, 1, 1), 0.5, {"x": 0.1}, 1), ("B", date(2024, 1, 1), 0.4, {"y": 0.2}, 2)],
        "ticker string, signal_date date, composite_score double, components map<string,double>, rank int"
    )
    sinks.write_signals_csv(c, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.columns == ["ticker", "signal_date", "composite_score", "rank", "x", "y"] and back.where("x is null").count() == 1
    sinks.write_signals_json(c, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
