"""The library's tables, made by Spark from the given ones, and the same in plain SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingmill.functions.text import word_count
from filingmill.operators import scoring, signals
from filingmill.sources.store import stored

# The lexicon and stop words of the stand-in tables, and the dates queries ask for.
LEXICON = {
    "negative": "OF LE DER NO LAS", "positive": "THE AND LA DIE EL", "uncertainty": "TO QUE IST",
    "litigious": "IN DE VON", "constraining": "IS LES MIT OF",
    "strong_modal": "THAT ET SICH", "weak_modal": "FOR EN ES THE",
}
STOP = [
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "this", "le", "la", "de", "que", "der", "die", "und",
    "el", "los", "en"
]
AS_OF = ["2020-12-31", "2021-06-30", "2022-06-30", "2023-06-30", "2023-12-31"]
START, END = "1995-01-01", "2001-09-30"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores where there are fewer files than cores: a file of one row group is read by one task."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if len(rows.inputFiles()) < n else rows


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to fewer digits than they were computed with, for comparison."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def accession(digits: Column) -> Column:
    """18 digits as an accession number."""
    return F.concat_ws("-", F.substring(digits, 1, 10), F.substring(digits, 11, 2), F.substring(digits, 13, 6))


def filings(spark: SparkSession, d: str) -> DataFrame:
    x = F.lpad(F.col("doc_id").cast("string"), 18, "0")
    return read(spark, d, "documents").select(
        accession(x).alias("filing_id"),
        F.lpad((1000 + F.substring("source", 4, 9).cast("int")).cast("string"), 10, "0").alias("cik"),
        F.col("source").alias("ticker"), F.concat(F.lit("Company "), "source").alias("company_name"),
        F.when(F.col("lang") == "en", "10-K").otherwise("10-Q").alias("form_type"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") * 7 % 1461).cast("int")).alias("filed_date"),
        F.concat(F.lit("https://www.sec.gov/Archives/"), x).alias("url"),
    )


FILINGS = """filings AS (SELECT left(x, 10) || '-' || substr(x, 11, 2) || '-' || right(x, 6) AS filing_id,
  lpad(CAST(1000 + CAST(substr(source, 4) AS INT) AS VARCHAR), 10, '0') AS cik,
  source AS ticker, 'Company ' || source AS company_name, CASE WHEN lang = 'en' THEN '10-K' ELSE '10-Q' END AS form_type,
  CAST(DATE '2020-01-01' + CAST(doc_id * 7 % 1461 AS INTEGER) AS DATE) AS filed_date, 'https://www.sec.gov/Archives/' || x AS url
  FROM (SELECT *, lpad(CAST(doc_id AS VARCHAR), 18, '0') AS x FROM documents))"""


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Every text as ``mda``; of every third document its second half as ``risk_factors`` too."""
    x = F.lpad(F.col("doc_id").cast("string"), 18, "0")
    half = F.substr("text", F.floor(F.length("text") / 2).cast("int") + 1)
    parts = F.array(
        F.struct(F.lit("mda").alias("section_name"), F.col("text").alias("raw_text")),
        F.when(
            F.col("doc_id") % 3 == 0, F.struct(F.lit("risk_factors").alias("section_name"), half.alias("raw_text"))
        )
    )
    rows = spread(read(spark, d, "documents").select("doc_id", "text")).select(
        accession(x).alias("filing_id"),
        F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")
    )
    return rows.select("filing_id", "p.section_name", "p.raw_text", word_count(F.col("p.raw_text")).alias("word_count"))


SECTIONS = """sections AS (SELECT *, len(regexp_extract_all(raw_text, '\\S+')) AS word_count FROM (
  SELECT left(x, 10) || '-' || substr(x, 11, 2) || '-' || right(x, 6) AS filing_id, section_name, raw_text FROM (
    SELECT doc_id, 'mda' AS section_name, text AS raw_text, lpad(CAST(doc_id AS VARCHAR), 18, '0') AS x FROM documents
    UNION ALL SELECT doc_id, 'risk_factors', substr(text, length(text) // 2 + 1), lpad(CAST(doc_id AS VARCHAR), 18, '0')
    FROM documents WHERE doc_id % 3 = 0)))"""


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, c) for c, words in LEXICON.items() for w in words.split()], "word string, category string")


LEXICON_SQL = "lexicon(word, category) AS (VALUES " + ", ".join(
    f"('{w}', '{c}')" for c, words in LEXICON.items() for w in words.split()
) + ")"
TOKENS = """tokens AS (SELECT filing_id, section_name, unnest(regexp_extract_all(upper(replace(raw_text, 'ß', 'ss')), '[A-Z]{2,}')) AS word FROM sections)"""
COUNTS = "counts AS (SELECT s.filing_id, s.section_name, coalesce(t.n, 0) AS total_tokens, " + ", ".join(f"coalesce(h.{c}, 0) AS {c}" for c in LEXICON) + """ FROM sections s
  LEFT JOIN (SELECT filing_id, section_name, count(*) AS n FROM tokens GROUP BY ALL) t USING (filing_id, section_name)
  LEFT JOIN (SELECT filing_id, section_name, """ + ", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in LEXICON) + """
    FROM tokens JOIN lexicon USING (word) GROUP BY ALL) h USING (filing_id, section_name))"""
SENTIMENT = """sentiment AS (SELECT filing_id, section_name, 'dictionary' AS analyzer_name,
  round(greatest(-1, least(1, (positive - negative) / total_tokens)), 6) AS sentiment_score, round(least(1,
  (positive + negative) / total_tokens), 6) AS confidence
  FROM counts WHERE total_tokens > 0)"""
TO_SENTIMENT = [FILINGS, SECTIONS, LEXICON_SQL, TOKENS, COUNTS, SENTIMENT]


def sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Stored: all that follows reads these short rows, not the texts."""
    scored = scoring.dictionary_sentiment(scoring.category_counts(sections(spark, d), lexicon(spark)))
    return stored(
        scored.select(
            "filing_id", "section_name", F.lit("dictionary").alias("analyzer_name"), "sentiment_score", "confidence"
        ),
        "sentiment"
    )


PRIOR = """prior AS (SELECT * FROM (SELECT filing_id, lag(filing_id) OVER (PARTITION BY ticker, form_type
  ORDER BY filed_date, filing_id) AS prior_filing_id FROM filings) WHERE prior_filing_id IS NOT NULL),
pairs AS (SELECT s.filing_id, s.section_name, p.prior_filing_id, s.raw_text, q.raw_text AS prior_text FROM sections s
  JOIN prior p USING (filing_id)
  JOIN sections q ON q.filing_id = p.prior_filing_id AND q.section_name = s.section_name)"""


def similarity(spark: SparkSession, d: str) -> DataFrame:
    """Stored, as ``sentiment`` is."""
    pairs = scoring.prior_section_pairs(filings(spark, d), sections(spark, d))
    return stored(scoring.tfidf_cosine(pairs, STOP, ("filing_id", "section_name", "prior_filing_id")), "similarity")


def _terms(column: str) -> str:
    words = f"list_filter(regexp_extract_all(replace(strip_accents(lower({column})), 'ß', '0'), '\\b[a-zA-Z]{{2,}}\\b'), lambda t: NOT list_contains([{', '.join(f"'{w}'" for w in STOP)}], t))"
    return f"SELECT filing_id, section_name, {words} AS w FROM pairs"


SIMILARITY = f"""ga AS ({_terms("raw_text")}), gb AS ({_terms("prior_text")}),
ta AS (SELECT filing_id, section_name, unnest(list_concat(w, list_transform(range(1, len(w)),
  lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM ga),
tb AS (SELECT filing_id, section_name, unnest(list_concat(w, list_transform(range(1, len(w)),
  lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM gb),
tc AS (SELECT filing_id, section_name, term, sum(a) AS a, sum(b) AS b FROM (SELECT *, 1 AS a, 0 AS b FROM ta
  UNION ALL SELECT *, 0, 1 FROM tb) GROUP BY ALL),
tr AS (SELECT *, row_number() OVER (PARTITION BY filing_id, section_name ORDER BY a + b DESC, term) AS r FROM tc),
tw AS (SELECT filing_id, section_name, CASE WHEN a > 0 AND b > 0 THEN 1 ELSE ln(1.5::DOUBLE) + 1 END AS idf, CASE
  WHEN a > 0 THEN 1 + ln(a) ELSE 0 END AS x, CASE WHEN b > 0 THEN 1 + ln(b) ELSE 0 END AS y FROM tr WHERE r <= 10000),
ts AS (SELECT filing_id, section_name, sum(x * idf * y * idf) AS dot, sum(x * idf * x * idf) AS xx,
  sum(y * idf * y * idf) AS yy FROM tw GROUP BY ALL),
similarity AS (SELECT filing_id, section_name, prior_filing_id, round(greatest(0, least(1, CASE WHEN xx * yy > 0
  THEN dot / sqrt(xx * yy) ELSE 0 END)), 6) AS similarity_score,
  round(1 - round(greatest(0, least(1, CASE WHEN xx * yy > 0 THEN dot / sqrt(xx * yy) ELSE 0 END)), 6), 6) AS change_score
  FROM ts JOIN pairs USING (filing_id, section_name) WHERE trim(raw_text, ' \t\n') <> '' AND trim(prior_text, ' \t\n') <> '')"""
TO_SIMILARITY = [*TO_SENTIMENT, PRIOR, SIMILARITY]


def raw(spark: SparkSession, d: str) -> DataFrame:
    return signals.raw_signals(sentiment(spark, d), similarity(spark, d), filings(spark, d))


RAW = """raw AS (SELECT ticker, filing_id, signal_name, CAST(filed_date + 2 AS DATE) AS signal_date, raw_value FROM (
  SELECT filing_id, analyzer_name || '_' || section_name AS signal_name, sentiment_score AS raw_value FROM sentiment
  UNION ALL SELECT filing_id, 'similarity_' || section_name, change_score FROM similarity)
  JOIN filings USING (filing_id) WHERE ticker IS NOT NULL)"""
DATES = "dates(as_of) AS (VALUES " + ", ".join(f"(DATE '{d}')" for d in AS_OF) + ")"
EXPANDED = "expanded AS (SELECT * FROM raw JOIN dates ON signal_date <= as_of)"
STATS = """stats AS (SELECT as_of, signal_name, count(*) AS n, avg(raw_value) AS mean, stddev_samp(raw_value) AS std,
  min(raw_value) AS low, max(raw_value) AS high FROM expanded GROUP BY ALL),
less AS (SELECT as_of, signal_name, raw_value, count(*) AS ties, coalesce(sum(count(*)) OVER (PARTITION BY as_of,
  signal_name ORDER BY raw_value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less
  FROM expanded GROUP BY as_of, signal_name, raw_value)"""
BUILT = """built AS (SELECT as_of, ticker, filing_id, signal_name, signal_date, raw_value,
  CASE WHEN n < 3 THEN NULL WHEN low = high THEN 0 ELSE round((raw_value - mean) / std, 6) END AS z_score,
  CASE WHEN n < 3 THEN NULL WHEN low = high THEN 50 ELSE round(100 * (2 * less + ties + 1) / (2 * n), 2) END AS percentile,
  CASE WHEN as_of - signal_date <= 0 THEN 1.0 WHEN as_of - signal_date > 900 THEN 0.0 ELSE round(pow(2.0,
  -(as_of - signal_date) / 90), 6) END AS decay_weight
  FROM expanded JOIN stats USING (as_of, signal_name) JOIN less USING (as_of, signal_name, raw_value))"""
TO_BUILT = [*TO_SIMILARITY, RAW, DATES, EXPANDED, STATS, BUILT]


def as_of(spark: SparkSession) -> DataFrame:
    from datetime import date

    return signals.dates(spark, [date.fromisoformat(x) for x in AS_OF])


def built(spark: SparkSession, d: str) -> DataFrame:
    return signals.build_signals(stored(raw(spark, d), "raw"), as_of(spark))


def weights_sql(weight: str) -> str:
    """Composites, as CTEs, from the weight expression over (as_of, ticker) windows of active names ``names``."""
    return f"""part AS (SELECT as_of, ticker, signal_name, sum(coalesce(z_score, raw_value) * decay_weight) AS vd,
    sum(decay_weight) AS d, arg_min(decay_weight, (signal_date, filing_id)) AS own
    FROM built WHERE decay_weight > 0 GROUP BY ALL),
  weighed AS (SELECT *, {weight} AS weight FROM part),
  scored AS (SELECT as_of, ticker, round(sum(weight * vd) / sum(abs(weight) * d), 6) AS composite_score FROM weighed
  WHERE weight <> 0 GROUP BY ALL HAVING sum(abs(weight) * d) <> 0),
  composites AS (SELECT ticker, as_of AS signal_date, composite_score, row_number() OVER (PARTITION BY as_of
  ORDER BY composite_score DESC, ticker) AS rank FROM scored)"""


EQUAL = weights_sql("round(1 / count(*) OVER (PARTITION BY as_of, ticker), 6)")
TO_COMPOSITES = [*TO_BUILT, EQUAL]


def composites(spark: SparkSession, d: str) -> DataFrame:
    b = stored(built(spark, d), "built")
    return signals.composite(b, signals.weights_equal(b))


def prices(spark: SparkSession, d: str) -> DataFrame:
    """Mean unit price of a supplier's shipments per day. Lines go to their ticker's task at once, where days, months and the
    windows over a ticker follow without another exchange; a day has hardly more than one line, so nothing is summed before."""
    p = F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))
    lines = read(spark, d, "lineitem").select(
        F.concat(F.lit("S"), "l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"), p.alias("p")
    )
    return lines.repartition("ticker").groupBy("ticker", "date").agg(F.avg("p").alias("price"))


PRICES = (
    "prices AS (SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, "
    "avg(l_extendedprice / nullif(l_quantity, 0)) AS price FROM lineitem GROUP BY ALL)"
)


def universe(spark: SparkSession, d: str) -> DataFrame:
    life = read(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.to_date(F.min("l_shipdate")).alias("start_date"), F.to_date(F.max("l_shipdate")).alias("z")
    )
    return read(spark, d, "supplier").join(life, F.col("s_suppkey") == F.col("l_suppkey")).select(
        F.concat(F.lit("S"), "s_suppkey").alias("ticker"), "start_date",
        F.when(F.col("s_suppkey") % 3 != 0, F.col("z")).alias("end_date")
    )


UNIVERSE = """universe AS (SELECT 'S' || s_suppkey AS ticker, start_date, CASE WHEN s_suppkey % 3 <> 0 THEN z END AS end_date FROM supplier
  JOIN (SELECT l_suppkey, CAST(min(l_shipdate) AS DATE) AS start_date, CAST(max(l_shipdate) AS DATE) AS z FROM lineitem
  GROUP BY ALL) ON s_suppkey = l_suppkey)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Composites for backtests: returned less accepted lines of a supplier's quarter."""
    flag = lambda f: F.count_if(F.col("l_returnflag") == f)
    # Numbers and days are grouped, which is quicker than texts; names come after.
    lines = read(spark, d, "lineitem").groupBy("l_suppkey", F.trunc("l_shipdate", "quarter").alias("q"))
    return lines.agg(((flag("R") - flag("A")) / F.count("*")).alias("composite_score")).select(
        F.concat(F.lit("S"), "l_suppkey").alias("ticker"), F.last_day(F.add_months("q", 2)).alias("signal_date"), "composite_score"
    )


SCORES = """scores AS (SELECT 'S' || l_suppkey AS ticker, CAST(last_day(date_trunc('quarter',
  l_shipdate) + INTERVAL 2 MONTH) AS DATE) AS signal_date,
  (count(*) FILTER (l_returnflag = 'R') - count(*) FILTER (l_returnflag = 'A')) / count(*) AS composite_score FROM lineitem GROUP BY ALL)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
