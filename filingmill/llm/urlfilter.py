"""URL filtering by pattern rules that an inverted index selects.

Every rule is a regular expression with the literal tokens that any URL it fits must hold. Rules are filed
under their rarest token, by counts over all URLs (Spark counts only tokens that occur in rules). A URL's
tokens fetch candidate rules, and only those run. URLs are mapped without a shuffle; the index is as large as
the rule list, which ``MAX_RULES`` bounds. Rules come from tables: listed ones (``listed``: host, path, verdict), and words of
topics (``topical``: topic, word), each of which gives a rule per place in which it may stand: a part of the host, a segment of
the path, a key or value of the query. Listed rules decide; where none fits, any pattern that blocks does.

Defined results: a null url, or one without ``://``, has an empty host and path and is allowed by no rule; very long
urls are judged whole; of listed rules that fit, the longest decides, of equally long ones the first; repeated rows
give equal rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RULES = 100_000
_TOKEN = re.compile("[A-Za-z0-9]+")


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` runs on host + path + the rest; ``tokens`` are in every URL it fits, in lower case."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool = False  # a listed rule names itself in the result, and the longest of them decides


def site(host: str, path: str, verdict: str) -> UrlRule:
    """Fits the host and all its subdomains where the path starts with ``path``."""
    tokens = tuple(dict.fromkeys(t.lower() for t in _TOKEN.findall(host + (path.rpartition("/")[0]))))
    return UrlRule(host + path, verdict, r"(?s)\A(?:[^/?#]*\.)?" + re.escape(host) + re.escape(path), tokens, True)


# The listed rules (host, path, verdict); words of topics that are kept out; other patterns.
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
TOPICS = {
    "gambling": "casino casinos poker bets bet betting roulette slots jackpot bingo lottery lotto wager sportsbook",
    "adult": "adult porn porno xxx sex escort escorts nude nudes camgirls hentai erotic milf webcam",
    "ads": "ads ad adserver adtrack adclick banner banners popup popunder tracker trackers clickbait affiliate sponsored",
    "pills": "viagra cialis pharma pharmacy pills steroids xanax tramadol",
    "loans": "payday loan loans cashadvance forex cryptogiveaway",
    "piracy": "warez crack cracks cracked keygen keygens torrent torrents nulled serials",
}
#: Where a word of a topic may stand: before and behind it.
PLACES = {
    "host": (r"\A(?:[^/?#]*[.-])?", r"(?:[.:/?#-]|\Z)"),
    "path": (r"\A[^/?#]*/(?:[^?#]*/)?", r"(?:/|\.html?|[?#]|\Z)"),
    "query": (r"\A[^?#]*\?(?:[^#]*[&;=])?", r"(?:[&;=#]|\Z)"),
}
LISTED = tuple(site(*r) for r in RULES)
PATTERNS = (
    UrlRule("casino", "block", r"(?i)\bcasino\b", ("casino",)),
    UrlRule("porn", "block", r"(?i)\bporn\b", ("porn",)),
    UrlRule("xxx-host", "block", r"(?i)\A[^/?#]*\.xxx(?:[:/?#]|\Z)", ("xxx",)),
    UrlRule("login", "block", r"(?i)/login(?:[/?#]|\Z)", ("login",)),
    UrlRule("log-in", "block", r"(?i)/log-in(?:[/?#]|\Z)", ("log", "in")),
    UrlRule("session", "block", r"(?i)[?&]session=[0-9a-z]+", ("session",)),
)


def topic_rules(words: list[tuple[str, str]]) -> tuple[UrlRule, ...]:
    """One rule per (topic, word) and place; words are letters and digits, so each is its own token."""
    return tuple(
        UrlRule(f"{topic}:{word}:{place}", "block", f"(?i){before}{word}{behind}", (word,))
        for topic, word in words for place, (before, behind) in PLACES.items()
    )


def topical(topics: DataFrame) -> tuple[UrlRule, ...]:
    """Rules of a table of words (topic, word), lower-cased; words with other characters, or more than MAX_RULES, raise an error."""
    words = topics.select("topic", F.lower("word").alias("word")).where("word is not null").distinct().orderBy("topic", "word").limit(MAX_RULES + 1).collect()
    if len(words) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} words")
    if bad := [w for _, w in words if not re.fullmatch("[a-z0-9]+", w)]:
        raise ValueError(f"not a word: {bad[0]}")
    return topic_rules([tuple(w) for w in words])


def given(spark: SparkSession) -> tuple[UrlRule, ...]:
    """The rules above, read from their tables, and the other patterns."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    topics = spark.createDataFrame([(t, w) for t, words in TOPICS.items() for w in words.split(" ")], "topic string, word string")
    return listed(rules) + PATTERNS + topical(topics)


def listed(rules: DataFrame) -> tuple[UrlRule, ...]:
    """Rules of a table (host, path, verdict), in that order; more than MAX_RULES raise an error."""
    rows = rules.select("host", "path", "verdict").distinct().orderBy("host", "path", "verdict").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules: shard them")
    return tuple(site(*r) for r in rows)


class RuleIndex:
    def __init__(self, rules: tuple[UrlRule, ...], counts: dict[str, int]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"over {MAX_RULES} rules: shard them")
        self.always, self.filed = [], defaultdict(list)
        for r in rules:
            entry = (r, re.compile(r.pattern))
            if r.tokens:
                self.filed[min(r.tokens, key=lambda t: (counts.get(t, 0), t))].append(entry)
            else:
                self.always.append(entry)

    def candidates(self, seen: str) -> list[tuple[UrlRule, re.Pattern]]:
        """The rules that run on a URL: those filed under one of its tokens."""
        tokens = dict.fromkeys(t.lower() for t in _TOKEN.findall(seen))
        return [*self.always, *(e for t in tokens for e in self.filed.get(t, ()))]

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        host = path = rest = ""
        if url and "://" in url:
            after = url.partition("://")[2]
            cut = re.search("[/?#]", after)
            host, tail = (after[: cut.start()], after[cut.start() :]) if cut else (after, "")
            host = host.translate(_LOWER)
            cut = re.search("[?#]", tail)
            path, rest = (tail[: cut.start()], tail[cut.start() :]) if cut else (tail, "")
        seen = f"{host}{path}{rest}"
        fits = [r for r, pattern in self.candidates(seen) if pattern.match(seen) or not r.listed and pattern.search(seen)]
        listed = max((r for r in fits if r.listed), key=lambda r: len(r.name), default=None)
        if listed:
            return host, path, listed.name, listed.verdict
        return host, path, None, "block" if any(r.verdict == "block" for r in fits) else "allow"


_LOWER = {c: c + 32 for c in range(65, 91)}
_KIND = pa.struct([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def token_counts(pages: DataFrame, rules: tuple[UrlRule, ...]) -> dict[str, int]:
    """How many URLs hold each token that some rule has; as long as the rule list."""
    wanted = pages.sparkSession.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.tokens})], "token string")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("[a-z0-9]+"), F.lit(0)))
    found = pages.select(F.explode(tokens).alias("token")).join(F.broadcast(wanted), "token").groupBy("token").agg(F.count("*").alias("n"))
    return {r.token: r.n for r in found.collect()}


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every page, by the rules given (if none, ``given``)."""
    rules = given(pages.sparkSession) if rules is None else rules
    counts = token_counts(pages.select("url"), rules)
    index: list[RuleIndex] = []

    def run(urls: pa.Array) -> pa.Array:
        if not index:
            index.append(RuleIndex(rules, counts))
        return pa.StructArray.from_arrays(
            [pa.array(list(c), pa.string()) for c in zip(*map(index[0].judge, urls.to_pylist()), strict=True)]
            if len(urls) else [pa.array([], pa.string())] * 4,
            fields=list(_KIND)
        )

    udf = F.arrow_udf(run, "struct<host:string,path:string,rule:string,verdict:string>").asNondeterministic()
    return pages.select("page_id", udf(F.col("url")).alias("j")).select("page_id", "j.host", "j.path", "j.rule", "j.verdict")


# The same in plain SQL: host and path are cut out, the longest listed rule that fits decides, then the patterns.
_LISTED_SQL = ", ".join(f"('{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}', '{r.name}', '{r.verdict}')" for r in LISTED)
_WORDS = "|".join(w for words in TOPICS.values() for w in words.split(" "))
_PATTERNS_SQL = " OR ".join(
    f"regexp_matches(seen, '{p}')" for p in (*(r.pattern for r in PATTERNS), *(f"(?i){before}(?:{_WORDS}){behind}" for before, behind in PLACES.values()))
).replace(r"\Z", r"\z")
SQL = f"""
WITH rules(h, p, name, verdict) AS (VALUES {_LISTED_SQL}),
a AS (SELECT page_id, row_number() OVER () AS k, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail FROM a),
c AS (SELECT page_id, k, host, regexp_extract(tail, '^[^?#]*') AS path, host || tail AS seen FROM b),
d AS (SELECT k, arg_max(name, length(name)) AS rule, arg_max(verdict, length(name)) AS verdict FROM c JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {_PATTERNS_SQL} THEN 'block' ELSE 'allow' END) AS verdict FROM c LEFT JOIN d USING (k)
"""
