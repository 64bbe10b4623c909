import json
import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from filingmill.sources import adapters, filings, folders


def landed(spark, rows, schema="cik string, accession_number string, name string, encoding string, text string", kind="filing_folder"):
    folders.register(spark)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/in"
    spark.createDataFrame(rows, schema).write.format(kind).mode("append").option("path", path).save()
    return path


def test_charsets_names_and_nulls(spark):
    rows = [
        ("1", "a-1", "utf8.htm", "utf-8", "naïve “x” ß"), ("1", "a-2", "old.htm", "windows-1252", "naïve “x” ß"),
        ("2", "b", "told.htm", "iso-8859-15", '<meta charset="iso-8859-15">10 €'), ("2", "b", "wide.txt", "utf-16", "naïve\r\nx"),
        ("3", "c", "mark.txt", "utf-8-sig", "é"), ("3", "c", "xml.xml", "iso-8859-7", '<?xml version="1.0" encoding="ISO-8859-7"?>αβγ'),
        ("../4", "", ".x/y", "utf-8", "escaped"), (None, "c", "_z", "utf-8", None), ("5", "c", "odd", "utf-8", "charset=nonsense é"),
    ]
    path = landed(spark, rows)
    got = {(r.cik, r.accession_number, r.name): (r.html, r.piece) for r in filings.read_filing_folder(spark, path).collect()}
    assert got == {r[:3]: (r[4] or "", 0) for r in rows}
    assert {r.name: r.encoding for r in filings.read_filing_folder(spark, path, ["1", "3"]).collect()} == {
        "utf8.htm": "utf-8", "old.htm": "windows-1252", "mark.txt": "utf-8-sig", "xml.xml": "iso8859-7"
    }
    assert filings.read_filing_folder(spark, path + "/none").count() == 0


def test_pushed_filters_open_only_their_folders(spark):
    path = landed(spark, [(str(i), "a", f"{k}.htm", "utf-8", f"{i} {k}") for i in range(6) for k in range(3)])
    os.rename(f"{path}/4/a/0.htm", f"{path}/4/a/as it is.htm")
    assert {r.name for r in filings.read_filing_folder(spark, path, ["4"]).collect()} == {"as it is.htm", "1.htm", "2.htm"}
    assert spark.read.format("filing_folder").option("path", path).load().where("name = 'as it is.htm'").count() == 1
    rows = spark.read.format("filing_folder").option("path", path).load()
    pruned = rows.where((F.col("cik").isin("1", "4", "9")) & (F.col("name") == "0.htm") & (F.length("text") > 1))
    assert [tuple(r) for r in pruned.select("cik", "name", "text").collect()] == [("1", "0.htm", "1 0")]
    reader = folders.FolderReader(folders.FilingFolder({"path": path}))
    left = list(reader.pushFilters([folders.In(("cik",), ("1", "4", "9")), folders.EqualTo(("name",), "0.htm"), folders.EqualTo(("size",), 3)]))
    assert [f.attribute for f in left] == [("size",)]
    assert [f[1].removeprefix(path) for p in reader.partitions() for f in p.files] == ["/1/a/0.htm"]


def test_long_documents_come_in_pieces_and_files_in_tasks(spark):
    text = "αx€" * 5000
    path = landed(spark, [("1", "a", f"{i}.htm", "utf-8", text + str(i)) for i in range(7)])
    rows = spark.read.format("filing_folder").option("path", path).option("piece_chars", 1000).option("task_bytes", 2_000_000).load()
    assert rows.rdd.getNumPartitions() == 4
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r.name, r.piece)):
        assert len(r.text) <= 1000 and r.size == len((text + r.name[0]).encode())
        got[r.name] = got.get(r.name, "") + r.text
    assert got == {f"{i}.htm": text + str(i) for i in range(7)}


def test_price_adapters(spark):
    quote = {"open": [1.0, None], "high": [2.0, 2.0], "low": [1.0, 1.0], "close": [1.5, 1.5], "volume": [None, 5]}
    chart = json.dumps({"timestamp": [1704153600, 1704240000], "indicators": {"quote": [quote]}})
    path = landed(spark, [("A", chart), ("B", "no json")], "ticker string, text string", "chart_folder")
    bars = adapters.read_prices(spark, "chart", path)
    assert bars.columns == list(adapters.BARS) and [(r.ticker, r.close, r.volume) for r in bars.collect()] == [("A", 1.5, 0)]
    tables = [
        ("A", "Date,Open,Close,Adj Close,Volume\n2024-01-02,9,10,\"1,1\",5\nbad,1,1,1,1\n2024-01-03,,11,12,"), ("B", "last,timestamp\r\n7,2024-01-02\r\n"),
        ("C", ""), ("D", "date\n2024-01-02"),
    ]
    path = landed(spark, tables, "ticker string, text string", "csv_folder")
    got = sorted((r.ticker, str(r.date), r.open, r.close, r.volume, r.adj_close) for r in adapters.read_prices(spark, "csv", path).collect())
    assert got == [("A", "2024-01-02", 9.0, 10.0, 5, None), ("A", "2024-01-03", 11.0, 11.0, 0, 12.0), ("B", "2024-01-02", 7.0, 7.0, 0, None)]
    assert adapters.read_prices(spark, "csv", path, ["A"], start="2024-01-03", end="2024-01-03").count() == 1
    with pytest.raises(ValueError, match="not known"):
        adapters.read_prices(spark, "none", path)
    with pytest.raises(ValueError, match="is known"):
        adapters.add_prices("csv", adapters.charts)
    adapters.add_prices("bare", lambda s, p, t: s.createDataFrame([("A",)], "ticker string"))
    with pytest.raises(ValueError, match="gives no"):
        adapters.read_prices(spark, "bare", path)
    members = adapters.read_universe(spark, "static", ["b ", "A", "a", ""]).collect()
    assert [(r.ticker, r.end_date) for r in members] == [("A", None), ("B", None)]


def test_long_price_files_are_read_whole(spark, tmp_path):
    """Only the first 16 million characters of a file and the first 32 cells of a line were looked at."""
    times, n = [1704153600 + 86400 * i for i in range(3)], 17_000_000
    quote = json.dumps({k: [1.0, 2.0, 3.0] for k in ("open", "high", "low", "close")} | {"volume": [1, 2, 3]})
    (tmp_path / "A.json").write_text(f'{{"timestamp": {times}, {" " * n}"indicators": {{"quote": [{quote}]}}}}')
    (tmp_path / "B.json").write_text(f'{{"timestamp": {times}, "indicators": {{"quote": [{quote}]}}}}')
    bars = adapters.read_prices(spark, "chart", str(tmp_path))
    assert sorted((r.ticker, str(r.date), r.close) for r in bars.collect()) == [(t, f"2024-01-0{2 + i}", 1.0 + i) for t in "AB" for i in range(3)]
    days = "".join(f"2024-01-{i:02},{i},{'x' * 1_000_000}\r\n" for i in range(1, 32))
    (tmp_path / "A.csv").write_text(f"Date,Close,Notes\r\n{days}2024-02-01,32,last")
    wide = ",".join(f"x{i}" for i in range(40))
    (tmp_path / "B.csv").write_text(f'{wide},Date,"Close"\n{wide},2024-01-01,1\n"a, ""b"", c",{wide[3:]},2024-01-02,"2"\n"odd,{wide[3:]},2024-01-03,3\n')
    got = adapters.read_prices(spark, "csv", str(tmp_path))
    assert sorted(r.close for r in got.where("ticker = 'A'").collect()) == [float(i) for i in range(1, 33)]
    assert sorted((str(r.date), r.close) for r in got.where("ticker = 'B'").collect()) == [(f"2024-01-0{i}", float(i)) for i in (1, 2, 3)]


def test_tables_are_whole_lines_under_the_first(tmp_path):
    for end in ("\n", "\r\n", "\r"):
        for last in ("", end):
            rows = ["name,x", *[f"{i},{'y' * (i * 7 % 23)}" for i in range(40)], "z" * 60]
            whole = end.join(rows) + last
            for chars in (1, 2, 7, 8, 20, 100, 10_000):
                parts = list(folders.tables(whole[i : i + chars] for i in range(0, len(whole), chars)))
                found = [[x for x in re.split("\r?\n|\r", p) if x] for p in parts]
                assert all(p[0] == "name,x" for p in found) and [x for p in found for x in p[1:]] == rows[1:]
    assert list(folders.tables(iter([""]))) == [""]


def test_csv_lines_are_parsed_once(spark, tmp_path):
    """The parser stands twice in the plan, for the header and for quoted lines, whatever is read of them; it stood there once
    per cell and use. Lines with quotes and without, short and long, give the same cells."""
    wide = ",".join(f"x{i}" for i in range(40))
    (tmp_path / "A.csv").write_text(f'Notes, Close ,Date,{wide}\n"a, b",1.5,2020-01-02\nplain,2.5,2020-01-03,{wide}\n"1","3.5","2020-01-04"\nshort\n')
    bars = adapters.read_prices(spark, "csv", str(tmp_path), start="2020-01-01")
    assert sorted((str(r.date), r.close, r.open) for r in bars.collect()) == [("2020-01-02", 1.5, 1.5), ("2020-01-03", 2.5, 2.5), ("2020-01-04", 3.5, 3.5)]
    assert bars._jdf.queryExecution().optimizedPlan().toString().count("from_csv") <= 2


def test_short_files_are_opened_once_and_many_share_tasks(tmp_path, monkeypatch):
    import pyarrow.fs as pafs

    from filingmill.sources import folders

    texts = [b"", b"plain", "é ß".encode(), "é".encode("cp1252"), "ä漢".encode("utf-16"), b"<meta charset=windows-1252>\xe9", b"\xef\xbb\xbfmark", b"\x81 odd", b"a" * 5000 + b"charset=utf-16", "é".encode() * 40]
    for i, data in enumerate(texts):
        (tmp_path / str(i)).write_bytes(data)
        path, opens = str(tmp_path / str(i)), []

        class Files:
            def open_input_stream(self, p):
                opens.append(p)
                return pafs.LocalFileSystem().open_input_stream(p)

        for chars in (7, 45, 1000, 10_000):
            charset = folders.charset_of(pafs.LocalFileSystem(), path)
            expected = (charset, list(folders.pieces(pafs.LocalFileSystem(), path, charset, chars)))
            opens.clear()
            told, found = folders.texts_of(Files(), path, len(data), chars)
            assert (told, list(found)) == expected
            assert len(opens) == 1 or len(data) >= chars
    for i in range(1000):
        (tmp_path / f"{i}.csv").write_text("x")
    reader = folders.CsvFolder({"path": str(tmp_path)}).reader(None)
    assert len(reader.partitions()) == 8
    monkeypatch.setattr(folders, "MANY", 999)
    assert [len(p.files) for p in reader.partitions()] == [1000]
