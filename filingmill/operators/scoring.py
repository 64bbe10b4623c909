"""Section scores: word categories, TF-IDF change, and language-model rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filingmill.functions import terms
from filingmill.functions.text import strip, tokenize_upper
from filingmill.schemas import CATEGORIES
from filingmill.sources.store import small_batches, stored

SECTION_KEY = ("filing_id", "section_name")
#: A lexicon of this many bytes or less becomes constants of the plan; a longer one is joined by shuffle.
LEXICON_BYTES = 1 << 20


def category_counts(sections: DataFrame, lexicon: DataFrame, key: tuple[str, ...] = SECTION_KEY) -> DataFrame:
    """Per section total_tokens and one count per category, also of sections without tokens.

    A text is tokenised once. A lexicon of bounded size is looked up in the tokens of each batch of texts (see ``terms``), so
    nothing is shuffled; with a longer one, counts per word meet it by shuffle."""
    size = lexicon.agg(F.sum(F.length("word") + F.length("category") + 16)).first()[0] or 0
    if size <= LEXICON_BYTES:
        found = _counter(_by_category(lexicon))
        small_batches(sections.sparkSession)
        return sections.select(*key, found("raw_text").alias("t")).select(*key, "t.*")
    tokens = tokenize_upper(F.col("raw_text"))
    by_word = lexicon.groupBy("word").agg(F.collect_set("category").alias("categories"))
    seen = sections.select(
        *key, F.explode_outer(tokens).alias("word")
    ).groupBy(*key, "word").agg(F.count("word").alias("n")).join(by_word, "word", "left")
    hits = [F.sum(F.when(F.array_contains("categories", c), F.col("n")).otherwise(0)).alias(c) for c in CATEGORIES]
    return seen.groupBy(*key).agg(F.sum("n").cast("int").alias("total_tokens"), *hits)


def _counter(by_category: dict[str, set[str]]) -> Callable[..., Column]:
    """total_tokens and a count per category of a text, by the batch."""
    words = sorted(set().union(*by_category.values()))
    categories = np.array([[w in by_category[c] for c in CATEGORIES] for w in words], bool).reshape(len(words), len(CATEGORIES))

    def run(texts: pa.Array) -> pa.Array:
        found = [terms.counts_among(part, pa.array(words, pa.string()), categories) for (part,) in terms.parts(texts)]
        total = np.concatenate([np.empty(0, np.int64), *[n for n, _ in found]]).astype(np.int32)
        counts = np.concatenate([np.empty((0, len(CATEGORIES)), np.int64), *[c for _, c in found]])
        columns = [pa.array(total), *[pa.array(np.ascontiguousarray(c), pa.int64()) for c in counts.T]]
        return pa.StructArray.from_arrays(columns, ["total_tokens", *CATEGORIES])

    schema = "struct<total_tokens:int," + ",".join(f"{c}:bigint" for c in CATEGORIES) + ">"
    return F.arrow_udf(run, schema).asNondeterministic()


def _by_category(lexicon: DataFrame) -> dict[str, set[str]]:
    rows = lexicon.where(F.col("category").isin(*CATEGORIES) & F.col("word").isNotNull()).collect()  # LEXICON_BYTES at most
    return {c: {r.word for r in rows if r.category == c} for c in CATEGORIES}


def dictionary_sentiment(counts: DataFrame) -> DataFrame:
    """Score, confidence and ratios of sections that have tokens."""
    n, p, m = (F.col(c) for c in ("total_tokens", "positive", "negative"))
    seen = counts.where("total_tokens > 0")
    return seen.withColumns({
        "sentiment_score": F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (p - m) / n)), 6),
        "confidence": F.round(F.least(F.lit(1.0), (p + m) / n), 6),
        "positive_ratio": F.round(p / n, 6), "negative_ratio": F.round(m / n, 6),
    })


def tfidf_cosine(pairs: DataFrame, stop: list[str], key: tuple[str, ...] = SECTION_KEY) -> DataFrame:
    """From (key, raw_text, prior_text): similarity_score and change_score, fitted on each pair alone.

    The terms of a pair are counted where its row is (see ``terms``), so no term is ever a row: exploding them and counting
    by key and term took ten times as long. Pairs without any term are dropped, as are blank texts."""
    known = frozenset(stop)
    small_batches(pairs.sparkSession)

    def run(raw: pa.Array, prior: pa.Array) -> pa.Array:
        found = [terms.cosines(*part, known) for part in terms.parts(raw, prior)]
        return pa.array(np.concatenate([np.empty(0), *found]), pa.float64(), from_pandas=True)  # NaN is null

    usable = pairs.where(F.col("raw_text").rlike(r"\S") & F.col("prior_text").rlike(r"\S"))  # ends at the first letter; ``strip`` walks the text
    scored = usable.select(
        *key, F.arrow_udf(run, "double").asNondeterministic()("raw_text", "prior_text").alias("c")
    ).where("c is not null")
    scored = scored.select(*key, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c"))), 6).alias("similarity_score"))
    return scored.withColumn("change_score", F.round(1 - F.col("similarity_score"), 6))


def prior_pairs(filings: DataFrame) -> DataFrame:
    """filing_id, prior_filing_id: the filing before by date within (ticker, form_type), ties by id."""
    w = W.partitionBy("ticker", "form_type").orderBy("filed_date", "filing_id")
    return filings.where("ticker is not null").select(
        "filing_id", F.lag("filing_id").over(w).alias("prior_filing_id")
    ).where("prior_filing_id is not null")


def prior_section_pairs(filings: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections with the same section of the prior filing, if that filing has it."""
    pairs = prior_pairs(filings)
    now = sections.select("filing_id", "section_name", "raw_text").join(pairs, "filing_id")
    before = sections.select(F.col("filing_id").alias("prior_filing_id"), "section_name", F.col("raw_text").alias("prior_text"))
    return now.join(before, ["prior_filing_id", "section_name"])


# Fixed value: the request to the model; the text stands at the end.
PROMPT = (
    "Rate the sentiment of this {section} section of a {form} filing. Answer with one JSON object with the fields "
    "sentiment_score (-1.0 to 1.0), confidence (0.0 to 1.0), themes (3 to 5 strings), tone (positive, negative, neutral or mixed) "
    "and reasoning (one or two sentences), and nothing else.\n\n{text}"
)
MAX_TEXT = 50_000
CUT_NOTE = "\n[... text truncated for length ...]\n"
TONES = ("positive", "negative", "neutral", "mixed")
_RESPONSE = "sentiment_score double, confidence double, themes array<string>, tone string, reasoning string"


def llm_prompt_rows(sections: DataFrame) -> DataFrame:
    """filing_id, section_name, text_length, truncated, prompt for sections with text."""
    text = strip(F.col("raw_text"))
    rows = sections.withColumn("text", text).where("text <> ''")
    long = F.length("text") > MAX_TEXT
    shown = F.when(long, F.concat(F.substring("text", 1, MAX_TEXT), F.lit(CUT_NOTE))).otherwise(F.col("text"))
    before, _, _ = PROMPT.partition("{text}")
    head = F.replace(F.replace(F.lit(before), F.lit("{section}"), F.col("section_name")), F.lit("{form}"), F.col("form_type"))
    return rows.select(
        "filing_id", "section_name", F.length("text").alias("text_length"), long.alias("truncated"),
        F.concat(head, shown).alias("prompt")
    )


def parse_llm_responses(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``valid`` and the fields; an invalid row has nulls and goes to quarantine by ``where(~valid)``."""
    text = strip(F.col(raw))
    text = F.when(text.startswith("```"), strip(F.regexp_replace(text, "(?m)^[ \t]*```.*$\n?", ""))).otherwise(text)
    kept = lambda name: F.get_json_object(text, f"$.{name}")
    parsed = F.from_json(text, _RESPONSE)
    # A number that was written as a text is not a number: the JSON type decides.
    kinds = F.from_json(text, "map<string,string>")
    quoted = lambda name: text.rlike(f'"{name}"\\s*:\\s*"')
    number = lambda name: F.when(~quoted(name), kept(name).try_cast("double"))
    score = number("sentiment_score")
    listed = kept("themes").startswith("[")
    themes = F.when(listed, F.slice(F.from_json(kept("themes"), "array<string>"), 1, 10)).otherwise(F.array().cast("array<string>"))
    out = rows.withColumns(
        {
            "sentiment_score": score,
            "valid": F.coalesce(
                text.startswith("{") & kinds.isNotNull() & parsed.isNotNull() & score.between(-1, 1), F.lit(False)
            )
        }
    )
    ok = F.col("valid")
    return out.withColumns({
        "sentiment_score": F.when(ok, F.round("sentiment_score", 6)),
        "confidence": F.when(ok, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number("confidence"), F.lit(0.5)))), 6)),
        "themes": F.when(ok, F.coalesce(themes, F.array().cast("array<string>"))),
        "tone": F.when(ok, F.when(F.lower(kept("tone")).isin(*TONES), F.lower(kept("tone"))).otherwise("neutral")),
        "reasoning": F.when(ok, F.coalesce(kept("reasoning"), F.lit(""))),
    })


Analyzer = Callable[[DataFrame], DataFrame]
#: What is kept of an analyzer's error.
ERROR_CHARS = 1000


class Analyzers:
    """Named analyzers: functions from section rows (with prior_text) to (filing_id, section_name, kind, score) and,
    if they have it, error. Each runs as a job of its own into a stored table, so results and failures read what was made
    once, and what fails does not stop the others: a row without a score is put aside with its error, and an analyzer that
    raises, while its plan is made or while it runs, gives one failure row without a section."""

    def __init__(self) -> None:
        self._known: dict[str, Analyzer] = {}

    def add(self, name: str, analyzer: Analyzer) -> None:
        if name in self._known:
            raise ValueError(f"analyzer {name!r} exists")
        self._known[name] = analyzer

    def replace(self, name: str, analyzer: Analyzer) -> None:
        if name not in self._known:
            raise KeyError(name)
        self._known[name] = analyzer

    def run(self, sections: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(results, failures: filing_id, section_name, analyzer_name, kind, error)."""
        wanted = names if names is not None else sorted(self._known)
        if not wanted:
            raise ValueError("no analyzer to run")
        empty = "filing_id string, section_name string, analyzer_name string, kind string, score double, error string"
        found, raised = sections.sparkSession.createDataFrame([], empty), []
        for name in wanted:
            analyzer = self._known[name]
            try:
                rows = analyzer(sections)
                error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
                rows = rows.select(
                    *SECTION_KEY, F.lit(name).alias("analyzer_name"), "kind",
                    F.col("score").cast("double").alias("score"), error.alias("error")
                )
                rows = stored(rows, "analyzer")
            except Exception as e:  # any user code; the others go on and the failure is reported
                raised.append((None, None, name, None, None, f"{type(e).__name__}: {e}".split("\n")[0][:ERROR_CHARS]))
                continue
            found = found.unionByName(rows)
        failed = found.where("score is null").unionByName(sections.sparkSession.createDataFrame(raised, empty))
        return found.where("score is not null").drop("error"), failed.drop("score")


def scorer(column: Column, kind: str = "sentiment") -> Analyzer:
    """An analyzer from a column expression."""
    return lambda sections: sections.select(*SECTION_KEY, F.lit(kind).alias("kind"), column.cast("double").alias("score"))


def python_scorer(score: Callable[[str], float], kind: str = "sentiment") -> Analyzer:
    """An analyzer from a Python function of a section's text, run on Arrow batches; an exception is that row's error."""

    def one(text: str) -> dict:
        try:
            return {"score": float(score(text)), "error": None}
        except Exception as e:  # any user code; the row is put aside
            return {"score": None, "error": f"{type(e).__name__}: {e}"}

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], pa.struct([("score", pa.float64()), ("error", pa.string())]))

    made = F.arrow_udf(run, "struct<score:double,error:string>").asNondeterministic()
    return lambda sections: sections.select(
        *SECTION_KEY, F.lit(kind).alias("kind"), made("raw_text").alias("s")
    ).select(*SECTION_KEY, "kind", "s.*")
