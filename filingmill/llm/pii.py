"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are what four fixed expressions find (e-mail, IP, card, phone). Candidates are typed: tokens with digits,
handles (``@name``), and capitalised names after a colon. Every seed and candidate stands in lexical patterns:
its last two words to the left, its last word to the left, and that word with its first to the right. Patterns and
instances (the distinct texts) make a bipartite graph, aggregated before anything is joined.

Belief goes through the graph ROUNDS times. A pattern's score is the believed share of its instances, discounted
by how many it has; it is accepted with a score of CONFIDENCE and SUPPORT believed instances, whether these are
seeds or were themselves discovered in an earlier round. An instance's belief is 1 for a seed, else
1 - product of (1 - score) over its accepted patterns. Candidates in accepted patterns are the spans of kind
``ctx``. Patterns of fewer than SUPPORT instances can never be accepted and leave the graph at once.

Spans are found without Python: matches are wrapped in two control characters (which the text's own are
first turned into a third of equal length for), the text is split at them, and lengths give code points.
Prefix sums are taken in blocks, so a text with very many matches stays near linear. A pattern or instance that
very many edges share is salted in every join, and sums over it are combined before they are shuffled.

Base expressions are rewritten for Java without changing what they match: possessive where nothing may be given
back, and a match may start only at the end of the last one or where no earlier character could belong to it.

Defined results: null is an empty text; repeated rows and copies give equal rows, and count as one instance; an
empty table gives an empty result; texts with control characters 1 and 2 keep their offsets; very long texts are
read whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

ROUNDS, CONFIDENCE, SUPPORT = 4, 0.6, 3
#: An instance of at least this belief counts for a pattern's support.
BELIEVED = 0.5
#: Parts into which the edges of one pattern or instance are dealt in joins.
SALTS = 16
KINDS = ("email", "ip", "card", "phone")
EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for an expression to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
NEEDS_CANDIDATE = r"[0-9]|@[A-Za-z0-9_]|: \p{Lu}"
CANDIDATE = (
    r"(?<![\p{L}\p{N}@._+-])(?=[A-Za-z-]*+[0-9])[A-Za-z0-9][A-Za-z0-9-]{5,39}(?![\p{L}\p{N}@_-])"
    r"|(?<![\p{L}\p{N}@._+-])@[A-Za-z0-9_]{3,30}(?![\p{L}\p{N}@_-])"
    r"|(?<=: )\p{Lu}[\p{L}'-]{1,30}(?: \p{Lu}[\p{L}'-]{1,30}){0,2}(?![\p{L}'-])"
)
_OPEN, _SHUT, _OTHER = "\x01", "\x02", "\x03"
_BLOCK = 64


def pieces(text: Column, expression: str) -> Column:
    """Text between matches and matches, in turn; always an odd number."""
    safe = F.translate(text, _OPEN + _SHUT, _OTHER + _OTHER)
    wrapped = F.regexp_replace(safe, F.lit(f"({expression})"), F.lit(f"{_OPEN}$1{_SHUT}"))
    return F.split(wrapped, f"[{_OPEN}{_SHUT}]", -1)


def located(parts: str) -> Column:
    """From a column of pieces: (start, end, text, left, right) per match, with 60 characters on either side."""
    lengths = F.transform(parts, lambda p: F.length(p).cast("long"))
    zero = F.lit(0).cast("long")
    plus = lambda a, x: a + x
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)), zero, plus),
    )
    # Each step adds one block's sum to the running totals.
    totals = F.aggregate(blocks, F.array(zero), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    known = F.struct(lengths.alias("lengths"), totals.alias("totals"))
    odd = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i % 2 == 0)

    def at(k: Column, i: Column) -> Column:
        before = (i - 1).cast("int")
        block = F.floor(before / _BLOCK).cast("int")
        start = F.element_at(k["totals"], block + 1) + F.aggregate(F.slice(k["lengths"], block * _BLOCK + 1, before % _BLOCK), zero, plus)
        own = F.element_at(parts, i)
        return F.struct(
            start.alias("start"), (start + F.length(own)).alias("end"), own.alias("text"),
            F.right(F.element_at(parts, i - 1), F.lit(60)).alias("left"),
            F.left(F.element_at(parts, i + 1), F.lit(60)).alias("right")
        )

    # transform over one struct, so that the sums are made once per text
    return F.flatten(F.transform(F.array(known), lambda k: F.transform(odd, lambda i: at(k, i))))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, F.lit("[^0-9]"), F.lit(""))


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
    doubled = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 1, doubled(value(i))).otherwise(value(i)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        # Leading zeros do not count; longer than three digits is over 255.
        part = lambda p: F.regexp_replace(p, F.lit("^0+(?=[0-9])"), F.lit(""))
        return F.forall(
            F.split(text, r"\."),
            lambda p: (F.length(part(p)) <= 3) & (F.substr(part(p), F.lit(1), F.lit(3)).cast("int") <= 255)
        )
    if kind == "card":
        d = _digits(text)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    return F.lit(True)


_FOUND = "array<struct<start:bigint,end:bigint,text:string,left:string,right:string>>"


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds to (…, text) one column of valid spans per kind and one of candidates outside them, each (start, end,
    instance, patterns), and drops the text."""
    kept = [c for c in docs.columns if c != "text"]
    kinds = {**EXPRESSIONS, "ctx": CANDIDATE}
    needs = {**NEEDS, "ctx": NEEDS_CANDIDATE}
    # One match splits a text in three; the common case, none, splits nothing.
    cut = docs.select(*kept, *[F.when(F.col("text").rlike(needs[k]), pieces(F.col("text"), e)).alias(f"p_{k}") for k, e in kinds.items()])
    none = F.array().cast(_FOUND)
    found = cut.select(*kept, *[F.when(F.size(f"p_{k}") > 1, located(f"p_{k}")).otherwise(none).alias(k) for k in kinds])
    told = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(s["text"]).alias("instance"), contexts(s["left"], s["right"]).alias("patterns"))
    checked = lambda k: F.transform(F.filter(k, lambda s: _valid(k, s["text"])), told).alias(k)
    inside = lambda s: F.exists(F.concat(*KINDS), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return found.select(*kept, *map(checked, kinds)).withColumn("ctx", F.filter("ctx", lambda s: ~inside(s)))


def contexts(left: Column, right: Column) -> Column:
    """The patterns a span stands in: two words to the left; one on either side; one to the left."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))
    last = F.slice(words(left), -2, 2)
    two = F.when(F.size(last) == 2, F.concat(F.array_join(last, " "), F.lit(" _")))
    before, after = F.regexp_extract(F.lower(left), r"(\p{L}+)\P{L}*$", 1), F.regexp_extract(F.lower(right), r"^\P{L}*(\p{L}+)", 1)
    around = F.when((before != "") & (after != ""), F.concat(before, F.lit(" _ "), after))
    return F.array_compact(F.array(two, around, F.when(before != "", F.concat(before, F.lit(" _")))))


def _salted(rows: DataFrame) -> DataFrame:
    """Every row under every salt, for a side that has one row per key."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def edges(found: DataFrame) -> DataFrame:
    """The graph: (pattern, instance, seed, salt), one row per distinct pair, of patterns with SUPPORT instances."""
    seeds = found.select(F.explode(F.concat(*KINDS)).alias("s"), F.lit(1).alias("seed"))
    others = found.select(F.explode("ctx").alias("s"), F.lit(0).alias("seed"))
    pairs = seeds.unionByName(others).select(F.explode("s.patterns").alias("pattern"), F.col("s.instance").alias("instance"), "seed")
    pairs = pairs.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")).withColumn(
        "salt", F.pmod(F.xxhash64("instance", "pattern"), F.lit(SALTS)).cast("int")
    )
    pairs = stored(pairs, "pairs")
    common = pairs.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("pattern")
    return pairs.join(_salted(common), ["pattern", "salt"])


def patterns(graph: DataFrame) -> DataFrame:
    """Accepted patterns: (pattern, score), by ROUNDS of belief over ``edges``."""
    sure = graph.groupBy("instance").agg(F.max("seed").alias("sure"))
    belief = graph.join(_salted(sure), ["instance", "salt"]).select(
        "pattern", "instance", "salt", F.col("sure").cast("double").alias("belief")
    )
    accepted = None
    for k in range(ROUNDS):
        b, n = F.sum("belief"), F.count("*")
        scored = belief.groupBy("pattern").agg(
            (b / n * b / (b + 1)).alias("score"), F.count_if(F.col("belief") >= BELIEVED).alias("support")
        )
        accepted = stored(
            scored.where((F.col("score") >= CONFIDENCE) & (F.col("support") >= SUPPORT)).select("pattern", "score"),
            f"accepted{k}"
        )
        doubt = graph.join(_salted(accepted), ["pattern", "salt"]).groupBy("instance").agg(
            F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))).alias("d")
        )
        value = sure.join(doubt, "instance", "left").select(
            "instance",
            F.when(F.col("sure") == 1, 1.0).otherwise(1 - F.exp(F.coalesce("d", F.lit(0.0)))).alias("belief")
        )
        belief = graph.select("pattern", "instance", "salt").join(_salted(value), ["instance", "salt"])
    return accepted


def find(docs: DataFrame) -> DataFrame:
    """doc_id with the valid spans of each base kind, and discovered spans in ``ctx``: (start, end, confidence)."""
    found = base_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "spans")  # ids are fixed once stored
    accepted = patterns(stored(edges(found), "graph"))
    open_ = found.where(F.size("ctx") > 0).select("row", F.explode("ctx").alias("s"))
    each = open_.select(
        "row", "s.start", "s.end", F.explode("s.patterns").alias("pattern"),
        F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")
    )
    new = each.join(_salted(accepted), ["pattern", "salt"]).groupBy("row", "start", "end").agg(F.max("score").alias("confidence"))
    new = new.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "confidence"))).alias("new"))  # one text's
    none = F.array().cast("array<struct<start:bigint,end:bigint,confidence:double>>")
    short = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k)
    return found.select("row", "doc_id", *[short(k) for k in KINDS]).join(new, "row", "left").select(
        "doc_id", *KINDS, F.coalesce("new", none).alias("ctx")
    )


def report(docs: DataFrame) -> DataFrame:
    shown = lambda k: F.transform(k, lambda s: F.concat(F.lit(f"{k}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
    say = lambda *kinds: F.array_join(F.concat(*map(shown, kinds)), ",")
    return find(docs).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(say(*KINDS), 256).alias("base_sha256"), say(*KINDS, "ctx").alias("spans")
    )
