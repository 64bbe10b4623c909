"""Text scores, signals and composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingmill.functions.terms import tfidf_terms
from filingmill.functions.text import tokenize_upper
from filingmill.operators import scoring, signals
from filingmill.sources.store import stored

from . import standin as S
from .registry import query
from .standin import rounded, with_

GIVEN = {"dictionary_mda": 2.0, "similarity_mda": -1.0}
ICS = [("dictionary_mda", 0.05), ("similarity_mda", -0.02)]


@query("tokenize_upper", with_(S.FILINGS, S.SECTIONS, S.TOKENS) + "SELECT word, count(*) AS n FROM tokens GROUP BY word")
def _(spark, d):
    return S.sections(spark, d).select(
        F.explode(tokenize_upper(F.col("raw_text"))).alias("word")
    ).groupBy("word").agg(F.count("*").alias("n"))


@query("category_counts", with_(*S.TO_SENTIMENT) + "SELECT * FROM counts")
def _(spark, d):
    return scoring.category_counts(S.sections(spark, d), S.lexicon(spark))


@query(
    "dictionary_sentiment",
    with_(*S.TO_SENTIMENT)
    + "SELECT filing_id, section_name, sentiment_score + 0.0 AS sentiment_score, confidence FROM sentiment"
)
def _(spark, d):
    return rounded(S.sentiment(spark, d).drop("analyzer_name"), 6)


@query("prior_section_pairs", with_(S.FILINGS, S.SECTIONS, S.PRIOR) + "SELECT filing_id, prior_filing_id, section_name FROM pairs")
def _(spark, d):
    return scoring.prior_section_pairs(S.filings(spark, d), S.sections(spark, d)).select("filing_id", "prior_filing_id", "section_name")


@query(
    "tfidf_terms",
    with_(S.FILINGS, S.SECTIONS, S.PRIOR, S.SIMILARITY.partition(",\ntb AS")[0])
    + "SELECT term, count(*) AS n FROM ta GROUP BY term"
)
def _(spark, d):
    pairs = scoring.prior_section_pairs(S.filings(spark, d), S.sections(spark, d))
    return pairs.select(F.explode(tfidf_terms(F.col("raw_text"), S.STOP)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(
    "tfidf_cosine",
    with_(*S.TO_SIMILARITY)
    + "SELECT filing_id, section_name, similarity_score + 0.0 AS similarity_score FROM similarity"
)
def _(spark, d):
    return rounded(S.similarity(spark, d).select("filing_id", "section_name", "similarity_score"), 6)


@query(
    "change_score",
    with_(*S.TO_SIMILARITY)
    + "SELECT filing_id, section_name, prior_filing_id, change_score + 0.0 AS change_score FROM similarity"
)
def _(spark, d):
    return rounded(S.similarity(spark, d).drop("similarity_score"), 6)


@query("llm_prompt_rows", with_(S.FILINGS, S.SECTIONS) + """SELECT filing_id, section_name, length(t) AS text_length,
  length(t) > 50000 AS truncated,
  md5(replace(replace(p, '{section}', section_name), '{form}', form_type) || CASE WHEN length(t) > 50000 THEN substr(t,
  1, 50000) || chr(10) || '[... text truncated for length ...]' || chr(10) ELSE t END) AS prompt_md5
  FROM (SELECT *, regexp_replace(regexp_replace(raw_text, '^\\s+', ''), '\\s+$', '') AS t, $P$""" + scoring.PROMPT.partition("{text}")[0] + """$P$ AS p FROM sections JOIN filings USING (filing_id)) WHERE t <> ''""")
def _(spark, d):
    rows = scoring.llm_prompt_rows(S.sections(spark, d).join(S.filings(spark, d).select("filing_id", "form_type"), "filing_id"))
    return rows.select("filing_id", "section_name", "text_length", "truncated", F.md5("prompt").alias("prompt_md5"))


@query("parse_llm_responses", """SELECT doc_id, k < 4 AS valid, CASE WHEN k < 4 THEN (doc_id % 21 - 10) / 10 END AS sentiment_score,
  CASE k WHEN 0 THEN least(1, greatest(0, (doc_id % 15) / 10)) WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 WHEN 3 THEN 0.5 END AS confidence,
  CASE k WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 10 WHEN 3 THEN 0 END AS n_themes, CASE WHEN k = 0 THEN 'mixed'
  WHEN k < 4 THEN 'neutral' END AS tone
  FROM (SELECT doc_id, doc_id % 7 AS k FROM labels)""")
def _(spark, d):
    k, score = F.col("doc_id") % 7, ((F.col("doc_id") % 21 - 10) / 10).cast("string")
    fence = F.lit("`" * 3)
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    raw = (
        F.when(
            k == 0,
            say(
                fence, "json\n", '{"sentiment_score": ', score, ', "confidence": ',
                ((F.col("doc_id") % 15) / 10).cast("string"), ', "themes": ["a", "b"], "tone": "mixed"}\n', fence
            )
        )
        .when(k == 1, say('{"sentiment_score": ', score, ', "confidence": "high", "themes": "none", "tone": "odd"}'))
        .when(
            k == 2,
            say(
                '{"sentiment_score": ', score,
                ', "confidence": 0.25, "themes": ["1","2","3","4","5","6","7","8","9","10","11"]}'
            )
        )
        .when(k == 3, say('{"sentiment_score": ', score, "}")).when(
            k == 4, say('{"sentiment_score": "', score, '"}')
        ).when(k == 5, F.lit('{"sentiment_score": 1.5}')).otherwise("not json")
    )
    parsed = scoring.parse_llm_responses(S.read(spark, d, "labels").select("doc_id", raw.alias("raw")))
    return parsed.select(
        "doc_id", "valid", "sentiment_score", "confidence",
        F.when(F.col("valid"), F.size("themes")).cast("long").alias("n_themes"), "tone"
    )


@query(
    "raw_signals",
    with_(*S.TO_SIMILARITY, S.RAW)
    + "SELECT ticker, filing_id, signal_name, signal_date, raw_value + 0.0 AS raw_value FROM raw"
)
def _(spark, d):
    return rounded(S.raw(spark, d), 6)


@query(
    "attach_filing_dates",
    with_(*S.TO_SENTIMENT)
    + "SELECT filing_id, section_name, ticker, filed_date FROM sentiment JOIN filings USING (filing_id) "
      "WHERE ticker IS NOT NULL"
)
def _(spark, d):
    return signals.attach_filing_dates(S.sentiment(spark, d), S.filings(spark, d)).select(
        "filing_id", "section_name", "ticker", "filed_date"
    )


@query(
    "signals_as_of",
    with_(*S.TO_SIMILARITY, S.RAW, S.DATES, S.EXPANDED)
    + "SELECT as_of, signal_name, count(*) AS n FROM expanded GROUP BY ALL"
)
def _(spark, d):
    return signals.signals_as_of(S.raw(spark, d), S.as_of(spark)).groupBy("as_of", "signal_name").agg(F.count("*").alias("n"))


@query(
    "cross_section",
    with_(*S.TO_BUILT)
    + "SELECT as_of, signal_name, n, round(mean, 4) + 0.0 AS mean, round(std, 4) + 0.0 AS std FROM stats"
)
def _(spark, d):
    return rounded(
        signals.cross_section(S.raw(spark, d), S.as_of(spark)).select(
            "as_of", "signal_name", F.col("n").cast("long").alias("n"), "mean", "std"
        )
    )


_BUILT = "SELECT as_of, filing_id, signal_name, {} FROM built"


@query("zscore", with_(*S.TO_BUILT) + _BUILT.format("z_score + 0.0 AS z_score"))
def _(spark, d):
    return rounded(signals.zscore(S.raw(spark, d), S.as_of(spark)).select("as_of", "filing_id", "signal_name", "z_score"), 6)


@query("percentile_rank", with_(*S.TO_BUILT) + _BUILT.format("percentile"))
def _(spark, d):
    return rounded(signals.percentile_rank(S.raw(spark, d), S.as_of(spark)).select("as_of", "filing_id", "signal_name", "percentile"), 2)


@query("decay", with_(*S.TO_BUILT) + _BUILT.format("decay_weight"))
def _(spark, d):
    s = signals.signals_as_of(S.raw(spark, d), S.as_of(spark))
    return rounded(
        s.select(
            "as_of", "filing_id", "signal_name",
            signals.decay_weight(F.col("as_of"), F.col("signal_date")).alias("decay_weight")
        ),
        6
    )


@query(
    "build_signals",
    with_(*S.TO_BUILT)
    + "SELECT as_of, ticker, filing_id, signal_name, signal_date, raw_value + 0.0 AS raw_value, "
      "z_score + 0.0 AS z_score, percentile, decay_weight FROM built"
)
def _(spark, d):
    return rounded(S.built(spark, d), 6)


_RANKED = "SELECT ticker, signal_date, composite_score + 0.0 AS composite_score, rank FROM composites"


def _ranked(composites):
    return rounded(composites.select("ticker", "signal_date", "composite_score", "rank"), 6)


@query("composite_rank", with_(*S.TO_COMPOSITES) + _RANKED)
def _(spark, d):
    return _ranked(S.composites(spark, d))


@query(
    "weights_equal",
    with_(*S.TO_BUILT)
    + "SELECT as_of, ticker, signal_name, round(1 / count(*) OVER (PARTITION BY as_of, ticker), 6) AS weight "
      "FROM (SELECT DISTINCT as_of, ticker, signal_name FROM built WHERE decay_weight > 0)"
)
def _(spark, d):
    return signals.weights_equal(S.built(spark, d))


_IC = "CASE signal_name " + " ".join(f"WHEN '{k}' THEN {abs(v)}" for k, v in ICS) + " ELSE 0 END"
_IC_WEIGHT = (
    f"round(CASE WHEN sum({_IC}) OVER (PARTITION BY as_of, "
    f"ticker) > 0 THEN {_IC} / sum({_IC}) OVER (PARTITION BY as_of, ticker) "
    f"ELSE 1 / count(*) OVER (PARTITION BY as_of, ticker) END, 6)"
)


@query("weights_ic", with_(*S.TO_BUILT, S.weights_sql(_IC_WEIGHT)) + _RANKED)
def _(spark, d):
    b = stored(S.built(spark, d), "built")
    return _ranked(signals.composite(b, signals.weights_ic(b, spark.createDataFrame(ICS, "signal_name string, ic double"))))


_CUSTOM = "CASE signal_name " + " ".join(
    f"WHEN '{k}' THEN round({v} / {sum(map(abs, GIVEN.values()))}, 6)" for k, v in GIVEN.items()
) + " ELSE 0 END"


@query("weights_custom", with_(*S.TO_BUILT, S.weights_sql(_CUSTOM)) + _RANKED)
def _(spark, d):
    b = stored(S.built(spark, d), "built")
    return _ranked(signals.composite(b, signals.weights_custom(b, GIVEN)))


@query(
    "components",
    with_(*S.TO_COMPOSITES)
    + "SELECT as_of AS signal_date, ticker, signal_name, CAST(round(CAST(weight * own AS DECIMAL(20, 10)), "
      "6) AS DOUBLE) + 0.0 AS effective FROM weighed JOIN scored USING (as_of, ticker)"
)
def _(spark, d):
    c = S.composites(spark, d).select("signal_date", "ticker", F.explode("components").alias("signal_name", "effective"))
    return rounded(c, 6)


@query("signal_counts_by_date", with_(*S.TO_COMPOSITES) + "SELECT signal_date, count(*) AS n FROM composites GROUP BY ALL")
def _(spark, d):
    return signals.signal_counts_by_date(S.composites(spark, d))


@query(
    "run_analyzers",
    with_(*S.TO_SENTIMENT)
    + "SELECT filing_id, section_name, 'dictionary' AS analyzer_name, 'sentiment' AS kind, "
      "sentiment_score + 0.0 AS score FROM sentiment UNION ALL SELECT filing_id, section_name, 'length', "
      "'sentiment', length(raw_text) / 1000000 FROM sections"
)
def _(spark, d):
    known = scoring.Analyzers()
    known.add(
        "dictionary",
        lambda s: scoring.dictionary_sentiment(scoring.category_counts(s, S.lexicon(spark))).select(
            "filing_id", "section_name", F.lit("sentiment").alias("kind"),
            (F.col("sentiment_score") + 0.0).alias("score")
        )
    )
    known.add("length", scoring.scorer(F.length("raw_text") / 1_000_000))
    return known.run(S.sections(spark, d))[0]


@query("llm_rows_quarantine", """SELECT doc_id, doc_id % 7 < 4 AS valid, CASE WHEN doc_id % 7 < 4 THEN doc_id % 100 / 100 + 0.0 END AS sentiment_score,
  CASE WHEN doc_id % 7 < 4 THEN CASE WHEN doc_id % 7 = 1 THEN 1.0 ELSE 0.5 END END AS confidence,
  CASE WHEN doc_id % 7 < 4 THEN CASE WHEN doc_id % 7 = 2 THEN 'mixed' ELSE 'neutral' END END AS tone FROM labels""")
def _(spark, d):
    """Answers made of every label: good ones, an out-of-range confidence, a tone in capitals, text, a text score, a large score."""
    number = (F.col("doc_id") % 100 / 100).cast("string")
    kind = F.col("doc_id") % 7
    answer = lambda *parts: F.concat(F.lit('{"sentiment_score": '), *[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit("}"))
    raw = (
        F.when(kind == 1, answer(number, ', "confidence": 7')).when(kind == 2, answer(number, ', "tone": "MIXED"')).when(kind == 3, answer(number, ', "tone": "odd"'))
        .when(kind == 4, F.lit("none")).when(kind == 5, answer('"', number, '"')).when(kind == 6, answer("1", number)).otherwise(answer(number))
    )
    parsed = scoring.parse_llm_responses(S.read(spark, d, "labels").select("doc_id", raw.alias("raw")))
    return parsed.select("doc_id", "valid", "sentiment_score", "confidence", "tone")
