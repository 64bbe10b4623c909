"""Filing indexes, ticker lists, submission lists, documents and lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filingmill.functions.text import dashed_accession, pad_cik, strip
from filingmill.schemas import CATEGORIES

from .folders import register

# Where documents are.
ARCHIVES = "https://www.sec.gov/Archives/"
INDEX_COLUMNS = ("company", "form", "cik", "date", "path")


def parse_filing_index(
    lines: DataFrame, forms: tuple[str, ...], ciks: DataFrame | None = None, tickers: DataFrame | None = None,
    columns: tuple[str, ...] = INDEX_COLUMNS
) -> DataFrame:
    """Pipe-delimited lines (``value``) of wanted forms as filings. ``columns`` is the order of the five parts,
    ``ciks`` (cik) narrows, ``tickers`` (cik, ticker) names; both are joined by size, without a hint."""
    parts = lines.select(F.split("value", "[|]").alias("p")).where(F.size("p") == 5)
    part = {c: strip(F.col("p")[i]) for i, c in enumerate(columns)}
    rows = parts.select(
        part["company"].alias("company_name"), part["form"].alias("form_type"), pad_cik(part["cik"]).alias("cik"),
        part["date"].try_cast("date").alias("filed_date"), part["path"].alias("path")
    ).where(F.col("form_type").isin(*forms) & F.col("filed_date").isNotNull())
    steps = F.split("path", "/")
    key = steps[F.size(steps) - 2]
    found = rows.where(F.size(steps) >= 4).select(
        F.when(key.rlike("^[0-9]{18}$"), dashed_accession(key)).when(key.contains("-"), key).alias("accession_number"),
        "cik", "company_name", "form_type", "filed_date", F.concat(F.lit(ARCHIVES), "path").alias("url"),
    ).where("accession_number is not null")
    if ciks is not None:
        found = found.join(ciks.select("cik").distinct(), "cik", "left_semi")
    if tickers is not None:
        found = found.join(tickers.select("cik", "ticker"), "cik", "left")
    return found


def parse_company_tickers(raw: DataFrame) -> DataFrame:
    """JSON objects ``{n: {cik_str, ticker}}`` (``value``) as (ticker, cik, ordinal)."""
    m = F.from_json("value", "map<string,struct<cik_str:bigint,ticker:string>>")
    rows = raw.select(F.explode(m)).select(
        F.upper("value.ticker").alias("ticker"), pad_cik(F.col("value.cik_str").cast("string")).alias("cik"),
        F.col("key").cast("int").alias("ordinal")
    )
    return rows.where("ticker is not null and cik is not null")


def resolve_tickers(asked: DataFrame, tickers: DataFrame) -> DataFrame:
    """(ticker, cik) of asked tickers in any case; the last entry of a ticker counts."""
    last = tickers.groupBy("ticker").agg(F.max_by("cik", "ordinal").alias("cik"))
    return asked.select(F.upper("ticker").alias("ticker")).distinct().join(last, "ticker")


def reverse_tickers(tickers: DataFrame) -> DataFrame:
    """(cik, ticker): the last entry of a cik counts."""
    return tickers.groupBy("cik").agg(F.max_by("ticker", "ordinal").alias("ticker"))


_RECENT = "struct<accessionNumber:array<string>,filingDate:array<string>,form:array<string>,primaryDocument:array<string>>"


def explode_submissions(raw: DataFrame, forms: tuple[str, ...], start=None, end=None) -> DataFrame:
    """Parallel arrays in JSON (``value``: cik, filings.recent; ``pages``: more such arrays) as one row per filing."""
    doc = F.from_json("value", f"struct<cik:string,filings:struct<recent:{_RECENT}>>")
    pages = F.coalesce(
        F.transform("pages", lambda p: F.from_json(p, _RECENT)), F.array().cast(f"array<{_RECENT}>")
    ) if "pages" in raw.columns else F.array().cast(f"array<{_RECENT}>")
    lists = raw.select(doc.alias("j"), pages.alias("pages")).select(
        pad_cik(F.col("j.cik")).alias("cik"), F.concat(F.array("j.filings.recent"), "pages").alias("lists")
    )
    rows = lists.select("cik", F.explode("lists").alias("r")).where("r is not null").select(
        "cik", F.explode(F.arrays_zip("r.accessionNumber", "r.filingDate", "r.form", "r.primaryDocument")).alias("z")
    )
    z = [F.col(f"z.{c}") for c in ("accessionNumber", "filingDate", "form", "primaryDocument")]
    found = rows.select(
        "cik", z[0].alias("accession_number"), z[1].try_cast("date").alias("filed_date"), z[2].alias("form_type"),
        F.coalesce(z[3], F.lit("")).alias("doc")
    )
    found = found.where(F.col("accession_number").isNotNull() & F.col("form_type").isin(*forms) & F.col("filed_date").isNotNull())
    if start is not None:
        found = found.where(F.col("filed_date") >= F.lit(start).cast("date"))
    if end is not None:
        found = found.where(F.col("filed_date") <= F.lit(end).cast("date"))
    url = F.concat(
        F.lit(f"{ARCHIVES}edgar/data/"), F.regexp_replace("cik", "^0+", ""), F.lit("/"),
        F.regexp_replace("accession_number", "-", ""), F.lit("/"), "doc"
    )
    return found.select("cik", "accession_number", "form_type", "filed_date", url.alias("url"))


def read_filing_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, html): one row per landed UTF-8 document, whatever its place."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def read_filing_folder(spark: SparkSession, path: str, ciks: list[str] | None = None) -> DataFrame:
    """(cik, accession_number, name, encoding, size, piece, html) of landed documents, ``<cik>/<accession>/<name>``; with ``ciks``
    only their folders are looked into. See ``folders`` for charsets and very long documents."""
    register(spark)
    rows = spark.read.format("filing_folder").option("path", path).load().withColumnRenamed("text", "html")
    return rows.where(F.col("cik").isin(ciks)) if ciks is not None else rows


def _column_of(category: str, columns: list[str]) -> str | None:
    named = {c.lower().replace(" ", "_"): c for c in columns}
    return named.get(category) or next((c for n, c in named.items() if category in n), None)


def lexicon_from_wide(rows: DataFrame, word: str = "Word") -> DataFrame:
    """(word, category) of a wide table, one column per category: any text but empty and ``0`` marks. Needs an
    ``ordinal`` column; of a word's rows that mark anything the last counts."""
    columns = {c: _column_of(c, [x for x in rows.columns if x not in (word, "ordinal")]) for c in CATEGORIES}
    mark = lambda c: F.when((F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) != "") & (F.trim(F.col(f"`{c}`")) != "0"), True).otherwise(False)
    marked = F.filter(F.array(*[F.when(mark(source), F.lit(c)) for c, source in columns.items() if source]), lambda x: x.isNotNull())
    named = rows.select(
        F.upper(strip(F.col(word))).alias("word"), marked.alias("categories"), "ordinal"
    ).where((F.size("categories") > 0) & (F.col("word") != ""))
    last = W.partitionBy("word").orderBy(F.desc("ordinal"))
    return named.withColumn("r", F.row_number().over(last)).where("r = 1").select("word", F.explode("categories").alias("category"))


def lexicon_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """The wide table from CSV files; file order is the order of rows."""
    rows = spark.read.csv(path, header=True)
    return lexicon_from_wide(
        rows.withColumn("ordinal", F.monotonically_increasing_id()),
        next(c for c in rows.columns if c.lower() == "word")
    )


def universe_rows(rows: DataFrame) -> DataFrame:
    """(ticker, start_date, end_date) of text rows: bad rows are dropped, a blank end is open."""
    day = lambda c: strip(F.col(c)).try_cast("date")
    blank: Column = F.coalesce(strip(F.col("end_date")), F.lit("")) == ""
    good = rows.select(
        F.upper(strip(F.col("ticker"))).alias("ticker"), day("start_date").alias("start_date"),
        day("end_date").alias("end_date"), blank.alias("open")
    )
    return good.where(
        (F.col("ticker") != "") & F.col("start_date").isNotNull() & (F.col("open") | F.col("end_date").isNotNull())
    ).drop("open")


def universe_from_csv(spark: SparkSession, path: str) -> DataFrame:
    return universe_rows(spark.read.csv(path, header=True))
