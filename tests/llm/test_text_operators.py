import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from filingmill.llm import chat, decontamination, labelled, pii, quality, secrets, toxicity, urlfilter

# ---------------------------------------------------------------- decontamination


def contaminated_rows():
    r = random.Random(5)
    items = [
        (1, " ".join(f"b{i}" for i in range(20))), (2, "short item"), (3, "one"), (4, ""), (5, None),
        (6, " ".join(f"b{i}" for i in range(5, 30))), (2, "short item"), (None, "no id"),
        (10, "b1 b2 b3 b4 b5 b6 b7"), (7, "ÉTÉ über x")
    ]
    words = [f"b{i}" for i in range(30)] + ["short", "item", "One", "x", "ÉTÉ", "über"]
    rows = [(0, None), (1, ""), (2, "!!!")]
    for i in range(3, 150):
        parts = []
        for _ in range(r.randint(1, 12)):
            if r.random() < 0.4:
                a = r.randrange(30)
                parts.append(" ".join(f"B{j}" for j in range(a, min(30, a + r.randint(1, 18)))))
            else:
                parts.append(r.choice([*words, "pad", "fill\n"]))
        rows.append((i, r.choice([" ", ", "]).join(parts)))
    return rows, items


@pytest.mark.parametrize("shard_bytes", [8 << 20, 40])
def test_decontamination(spark, shard_bytes):
    rows, items = contaminated_rows()
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, __hits string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id long")
    found, hits = decontamination.matches(docs, bench, shard_bytes=shard_bytes)
    good = [(i, t) for i, t in items if i is not None]
    for r in found.select("doc_id", "text", hits.alias("h"), decontamination.is_contaminated(hits).alias("c")).collect():
        n, hit, ids, bad = decontamination.brute_force(r.text, good)
        assert (r.h.n_words, len(r.h.hits), sorted(map(str, r.h["items"])), r.c) == (n, hit, ids, bad), r.text
    if shard_bytes > 40:
        by = {r.doc_id: r for r in decontamination.report(docs, bench).collect()}
        for d, t in rows:
            n, hit, ids, bad = decontamination.brute_force(t, good)
            assert (
                by[d].n_words, by[d].n_hit, by[d].n_items, by[d].items_sha256, by[d].contaminated
            ) == (n, hit, len(ids), decontamination.digest(ids), bad)
        kept = decontamination.decontaminate(docs, bench)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {d for d, t in rows if not decontamination.brute_force(t, good)[3]}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.report(none, items).count() == 0
    assert decontamination.report(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items).first().n_items == 0


def test_decontamination_of_a_very_long_text(spark):
    item = " ".join(f"b{i}" for i in range(20))
    long = " ".join(f"w{i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, f"{long} {item}", "x"), (2, long, "y")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, item, 0)], "item_id long, text string, n_words int")
    got = {r.doc_id: r for r in decontamination.report(docs, items).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (200_020, 20, 1, False)
    assert (got[2].n_words, got[2].n_hit, got[2].n_items) == (200_000, 0, 0)


# ---------------------------------------------------------------- secrets


def brute_secrets(text):
    key = "|".join(
        "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
        for w in ("password", "passwd", "secret", "token")
    ) + "|[aA][pP][iI]_?[kK][eE][yY]"
    kinds = [
        ("assign", rf"({key})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)
    ]
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, g, n) in enumerate(kinds) for m in re.finditer(p, text) if len(m.group(g)) >= n]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def secret_texts():
    r = random.Random(3)
    bits = [
        "password", "PassWd", "token", "secret", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdefgh1",
        "deadbeef" * 4, "AKIA", "ABCDEF012345", "é", "x", "\n", "==", "/", "-", "ſecret"
    ]
    return [None, "", "a" * 100_000 + " token=abcdefgh1"] + ["".join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(1500)]


def test_secrets(spark):
    texts = secret_texts()
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in secrets.report(docs).collect():
        base = [f"{k}:{a}:{b}" for k, a, b in brute_secrets(texts[r.doc_id] or "")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), texts[r.doc_id]
        assert r.n_assign + r.n_access + r.n_hex == len(base) and set(base) <= set(r.spans.split(","))


def test_redaction(spark):
    docs = spark.createDataFrame(
        [(1, "é token=abcdefgh1 end", 21), (2, None, 5), (3, "clean", 5)], "doc_id long, text string, n_chars long"
    )
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(docs).collect()}
    assert got == {1: ("é <secret> end", 14), 2: (None, 5), 3: ("clean", 5)}


@pytest.mark.parametrize(("kind", "text"), [
    ("pem", "-----BEGIN RSA PRIVATE KEY-----"), ("github", "ghp_" + "a1B2" * 9), ("slack", "xoxb-1234567890-abc"),
    ("google", "AIza" + "b" * 35), ("stripe", "sk_live_" + "1a" * 12),
    ("jwt", "eyJhbGci.eyJzdWIi.c2ln"), ("url", "postgres://me:pa55@db.example.com"),
])
def test_added_rules(kind, text):
    spans = secrets.Scanner().spans(f"see {text} there".encode())
    assert (4, [r.kind for r in secrets.RULES].index(kind), 4 + len(text)) in spans


def test_spans_of_all_rules_are_those_of_re():
    r = random.Random(3)
    bits = [
        "password", "token", "secret", "api_key", "=", ":", " ", '"', "AKIA", "ABCDEFGH1234", "0123456789abcdef",
        "deadbeef" * 4, "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ghp_", "xoxb-", "AIza", "sk_live_", "eyJ", "eyJ",
        ".", "http://", "user", ":pw", "@host", "\n", "-", "Z"
    ]
    scanner = secrets.scanner(secrets.RULES)
    for _ in range(4000):
        data = "".join(r.choice(bits) for _ in range(r.randint(1, 25))).encode()
        expected = []
        for k, rule in enumerate(secrets.RULES):
            for m in re.finditer(rule.match.encode(), data):
                begin = re.compile(rule.value.encode()).match(data[: m.end()], m.start()).end() if rule.value else m.start()
                if m.end() - begin >= rule.least:
                    expected.append((m.start(), k, m.end()))
        assert scanner.spans(data) == sorted(expected), data


@pytest.mark.parametrize("unit", [b"eyJ", b"http://", b"token = ", b"http://a:", b"-----BEGIN A"])
def test_a_megabyte_is_read_in_linear_time(unit):
    import time

    scanner, took = secrets.scanner(secrets.RULES), []
    for size in (100_000, 1_000_000):
        began = time.process_time()
        scanner.spans(unit * (size // len(unit)))
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 1


def test_secrets_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.report(none).count() == secrets.redact(none).count() == 0


# ---------------------------------------------------------------- URLs


@pytest.mark.parametrize(("url", "expected"), [
    (None, ("", "", None, "allow")), ("nothing", ("", "", None, "allow")),
    ("http://A.Com/x?y", ("a.com", "/x", "com/", "allow")), ("http://com", ("com", "", None, "allow")),
    ("https://m.example.com/en/1", ("m.example.com", "/en/1", "example.com/en/", "block")),
    ("https://www.example.com/en/1#a", ("www.example.com", "/en/1", "www.example.com/en/", "allow")),
    ("x://b.net/es/", ("b.net", "/es/", "net/es/", "block")), ("x://b.net/ES/", ("b.net", "/ES/", None, "allow")),
    ("x://notnet/es/", ("notnet", "/es/", None, "allow")),
    ("http://w.org/login?u=1", ("w.org", "/login", None, "block")),
    ("http://w.org/a?session=1f", ("w.org", "/a", None, "block")),
    ("http://example.com/EN/", ("example.com", "/EN/", "com/", "allow")),
    ("http://casino.org/", ("casino.org", "/", None, "block")), ("http://", ("", "", None, "allow")),
])
def test_urls(spark, url, expected):
    pages = spark.createDataFrame([(1, url, "h")], "page_id long, url string, host string")
    assert tuple(urlfilter.judge(pages).first())[1:] == expected


def test_index_runs_only_candidates():
    counts = {"com": 9, "example": 5, "en": 7, "www": 1, "net": 3, "es": 2, "fr": 4}
    index = urlfilter.RuleIndex(urlfilter.LISTED + urlfilter.PATTERNS, counts)
    assert {t for t in index.filed} >= {"www", "es", "net", "example", "com"}
    ran = []

    class Watched:
        def __init__(self, pattern):
            self.pattern = pattern

        def match(self, text):
            ran.append(self.pattern.pattern)
            return self.pattern.match(text)

        search = match

    index.filed = {t: [(r, Watched(p)) for r, p in entries] for t, entries in index.filed.items()}
    index.judge("http://a.net/es/")
    assert ran and all("net" in p or "es" in p for p in ran)
    ran.clear()
    index.judge("http://plain.org/")
    assert not ran


def test_urls_against_all_rules():
    """The index gives what trying every rule gives."""
    r = random.Random(6)
    rules = urlfilter.LISTED + urlfilter.PATTERNS
    one, all_ = urlfilter.RuleIndex(rules, {}), urlfilter.RuleIndex(rules, {})
    all_.always, all_.filed = all_.always + [e for es in all_.filed.values() for e in es], {}
    bits = [
        "http://", "www.", "example", ".com", "/en/", "/", "net", ".net", "/es/", "/fr/", "casino", "login",
        "?session=1", "#", ".xxx", "com", ":80", "A", "É"
    ]
    for _ in range(5000):
        url = "".join(r.choice(bits) for _ in range(r.randint(0, 8)))
        assert one.judge(url) == all_.judge(url), url


def test_urls_of_odd_tables(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    long = "http://a.net/es/" + "x" * 500_000
    rows = [(1, long, "n"), (1, long, "n"), (None, None, "n")]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string")).collect()
    assert sorted((r.page_id or 0, r.rule or "") for r in got) == [(0, ""), (1, "net/es/"), (1, "net/es/")]


def test_rules_of_a_table(spark):
    table = spark.createDataFrame(
        [("org", "/", "block"), ("w.org", "/ok/", "allow"), ("org", "/", "block")],
        "host string, path string, verdict string"
    )
    rules = urlfilter.listed(table)
    pages = spark.createDataFrame([(1, "http://w.org/ok/1"), (2, "http://v.org/"), (3, "http://v.net/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(pages, rules).collect()} == {1: "allow", 2: "block", 3: "allow"}


# ---------------------------------------------------------------- chat


def test_chat_round_trip(spark):
    rows = [
        (1, 1, "assistant", "a[b]</s>&lt;"), (1, 0, "user", None), (1, 2, None, "x"), (2, 0, "we]ird</s>", "&amp;]"),
        (2, 0, "we]ird</s>", "&amp;]"), (3, None, "assistant", "")
    ]
    got = {r.conv_id: r for r in chat.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {-1, 1, 2, 3}
    say = lambda *turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == say(("user", ""), ("assistant", "a[b]</s>&lt;"), ("", "x"))
    assert got[1].loss_sha256 == hashlib.sha256(b"a[b]</s>&lt;").hexdigest() and got[1].loss_chars == 12
    assert got[2].n_turns == 2 and got[2].turns_sha256 == say(("we]ird</s>", "&amp;]"), ("we]ird</s>", "&amp;]"))
    assert got[3].loss_chars == 0 and got[3].n_turns == 1


def test_chat_parts(spark):
    parts = [
        ("text", "see <image:9> ", None, None), ("image", None, "s3/a.png", 2.0), ("audio", None, "b.wav", None),
        ("text", "end", None, None)
    ]
    rows = [
        (1, 0, "user", parts), (1, 1, "assistant", [("document", None, "c.pdf", 1.0), ("text", "ok", None, None)]),
        (2, 0, "user", None)
    ]
    made = {
        r.conv_id: r
        for r in chat.format_conversations(
            spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
        ).collect()
    }
    assert made[1].formatted == "[user]see &lt;image:9> <image:0><audio:1>end</s>[assistant]<document:2>ok</s>"
    assert [(a.ordinal, a.ref, a.tokens) for a in made[1].attachments] == [(0, "s3/a.png", 512), (1, "b.wav", 25), (2, "c.pdf", 400)]
    assert made[1].expanded_tokens == 937 and made[2].formatted == "[user]</s>"
    s = made[1].loss_spans[0]
    assert made[1].formatted[s.start : s.start + s.length] == "<document:2>ok"


def test_chat_parts_are_read_back(spark):
    parts = [(None, "a<image:0>", None, None), ("text", "b", None, None), ("image", None, "x", None), ("text", "<", None, None)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [("audio", "unused", None, 0.0)]), (1, 2, "user", [])]
    made = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}"))
    got = made.select(chat.read_parts(F.col("formatted")).alias("t")).first().t
    assert [(t.role, [tuple(p) for p in t.parts]) for t in got] == [
        ("user", [("text", "a<image:0>b", None), ("image", None, 0), ("text", "<", None)]),
        ("assistant", [("audio", None, 1)]),
        ("user", []),
    ]


def test_chat_of_a_long_conversation(spark):
    r, turns, shown, spans, files = random.Random(3), [], "", [], 0
    for i in range(3000):
        role, parts = r.choice(["user", "assistant"]), []
        opening = f"[{role}]"
        content = ""
        for _ in range(r.randint(0, 3)):
            if r.random() < 0.5:
                parts.append(("image", None, f"ref{files}", 1.0))
                content += f"<image:{files}>"
                files += 1
            else:
                parts.append(("text", f"é{i}", None, None))
                content += f"é{i}"
        turns.append((1, i, role, parts, "user"))
        if role == "assistant":
            spans.append((len(shown) + len(opening), len(content)))
        shown += f"{opening}{content}</s>"
    r.shuffle(turns)
    got = chat.format_conversations(
        spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts {chat.PARTS}, begin string")
    ).first()
    assert got.formatted == shown and [tuple(s) for s in got.loss_spans] == spans
    assert [(a.ordinal, a.ref) for a in got.attachments] == [(k, f"ref{k}") for k in range(files)] and got.expanded_tokens == 256 * files


def test_chat_of_empty_and_odd_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.report(none).collect()] == [-1]
    assert chat.format_conversations(none.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))).count() == 0
    odd = spark.createDataFrame(
        [(None, None, None, None, 1, "x"), (5, 1, "assistant", "y" * 300_000, 2, "z")],
        "conv_id long, turn long, role string, text string, at int, rows string"
    )
    got = {r.conv_id: r for r in chat.report(odd).collect()}
    assert set(got) == {-1, None, 5} and got[None].n_turns == 1 and got[5].loss_chars == 300_000


# ---------------------------------------------------------------- personal data


def brute_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0

    found = lambda p: re.finditer(p, text)
    return {
        "email": [m.span() for m in found(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")],
        "ip": [m.span() for m in found(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in found(r"[0-9]([\x20-]?[0-9])+") if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in found(r"\+[0-9][\x20().0-9-]+[0-9]") if 9 <= len(digits(m)) <= 15],
    }


def test_pii(spark):
    r = random.Random(1)
    bits = [
        "a@b.c", "_d@e.f", ".", "@", "x-y", "1.2.3.4", "255", "300", "0001", "+1 (555) 123-4567", "+49",
        "4111 1111 1111 1111", "-", " ", "é", "\x01", "\x02", "😀", "id ", "9", "12", "my card ", "(", ")", "AB12345"
    ]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 30)))) for i in range(600)]
    rows += [(9000, None), (9001, ""), (9002, "1" * 20_000), (9003, " ".join(["1.2.3.4"] * 1000)), (9005, "+1 " + "(" * 20_000)]
    texts = dict(rows)
    docs = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, ctx string")
    for g in pii.find(docs).collect():
        expected = brute_pii(texts[g.doc_id] or "")
        for k in pii.KINDS:
            assert [tuple(s) for s in g[k]] == expected[k], (k, texts[g.doc_id])


def test_contexts_find_unseen_identifiers(spark):
    rows = [
        (i, f"please call us at +1 (555) 123-45{i:02d} today") for i in range(12)
    ] + [(20, "please call us at AB-12345 today"), (21, "a lone AB-99999 here")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20] == "ctx:18:26" and got[21] == "" and got[0].startswith("phone:18:")


def brute_belief(rows):
    """Accepted patterns of (pattern, instance, seed) rows, in plain loops."""
    seeds = {i for _, i, s in rows if s}
    of = {p: {i for q, i, _ in rows if q == p} for p in {p for p, _, _ in rows}}
    of = {p: i for p, i in of.items() if len(i) >= pii.SUPPORT}
    belief, accepted = {i: float(i in seeds) for _, i, _ in rows}, {}
    for _ in range(pii.ROUNDS):
        accepted = {}
        for p, instances in of.items():
            b = sum(belief[i] for i in instances)
            score = b / len(instances) * b / (b + 1)
            if score >= pii.CONFIDENCE and sum(belief[i] >= pii.BELIEVED for i in instances) >= pii.SUPPORT:
                accepted[p] = score
        for i in belief:
            doubt = 1.0
            for p, score in accepted.items():
                doubt *= 1 - score if i in of[p] else 1.0
            belief[i] = 1.0 if i in seeds else 1 - doubt
    return accepted


def bootstrap_rows():
    rows = [(i, f"please call us at +1 (555) 123-4{i:03d} today") for i in range(60)]
    rows += [(100 + i, f"please call us at AB-1000{i} today") for i in range(6)]
    rows += [(200 + i, f"the badge reads AB-1000{i} clearly") for i in range(6)]
    return rows + [
        (300, "the badge reads AB-77777 clearly"), (301, "nothing near AB-88888 here"),
        (302, "the badge reads AB-77777 clearly")
    ]


def test_discovered_instances_support_new_patterns(spark):
    docs = spark.createDataFrame(bootstrap_rows(), "doc_id long, text string")
    graph = pii.edges(pii.base_spans(docs))
    expected = brute_belief([(r.pattern, r.instance, r.seed) for r in graph.collect()])
    got = {r.pattern: r.score for r in pii.patterns(graph).collect()}
    assert got.keys() == expected.keys() and all(abs(got[p] - expected[p]) < 1e-9 for p in got)
    assert "badge reads _" in got  # none of its instances is a seed
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert spans[300] == spans[302] == "ctx:16:24" and spans[301] == ""


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("write to @some_one now", "@some_one"), ("name: José Ruiz, here", "José Ruiz"), ("code AB12345.", "AB12345"),
        ("a.b@c.de", None), ("plain: words", None)
    ]
)
def test_typed_candidates(spark, text, found):
    spans = pii.base_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().ctx
    assert [text[s.start : s.end] for s in spans] == ([found] if found else [])


def test_pii_of_an_empty_table(spark):
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---------------------------------------------------------------- trained operators


def toxic_docs(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(500):
        words = [f"w{r.randrange(300)}" for _ in range(r.randint(5, 60))]
        words = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in words]
        bad = i % 5 == 0
        if bad:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(["zorgly", "blatk", "vexon" + r.choice("abc")]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(bad), int(i % 2)))
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "x" * 200_000, "fr")]
    labels += [(1000, None, 1), (None, 1, 1), (3, 0, 1)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, score string"
    ), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_docs(spark)
    got = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    assert len(got) == 503 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [r for i, r in got.items() if r.held_out and i < 500]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert got[1000].score == got[1001].score < 0.5
    kept = toxicity.remove_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id >= 1000").count() == 3


def test_grammar_modes():
    m = toxicity.Model({"zorg": 1.0})
    top = lambda t: dict(zip(toxicity.MODES, m.modes(t), strict=False))
    assert top("a zorg.")["bare"] == 1 and top("you zorg.")["aimed"] == 1 and top("he said zorg.")["reported"] == 1
    assert top("not a zorg.")["negated"] == 1 and top("not at all so very zorg")["bare"] == 1
    for threat in ("I will kill you", "kill them all", "you I will kill", "beat you up"):
        assert top(threat)["threat"] == 1, threat
    for none in ("kill time", "I will not kill you", "he said I will kill you", "beat the egg. up you go"):
        assert top(none)["threat"] == 0, none
    assert top("zorg, you")["aimed"] == 1 and top("zorg. you")["aimed"] == 0
    assert top("said. zorg")["bare"] == 1 and top("one zorg zorg. zorg")["bare"] == 2


def brute_modes(words, weights):
    """Largest clause weight per mode, by looking at each word of a clause by itself."""
    kind = lambda w: next((k for k, ws in toxicity.WORDS.items() if w in ws.split(" ")), "insult" if w in weights else "other")
    best = dict.fromkeys(toxicity.MODES, 0.0)
    clauses, now = [], []
    for w in words:
        if kind(w) == "end":
            clauses.append(now)
            now = []
        else:
            now.append(w)
    for clause in [*clauses, now]:
        got, kinds = dict.fromkeys(toxicity.MODES, 0.0), [kind(w) for w in clause]
        verb_free, aimed, neg = 0, "target" in kinds, 0
        for i, k in enumerate(kinds):
            if k == "particle":
                k = "threat" if verb_free else "other"
                verb_free = 0
            elif k == "verb":
                k, verb_free = "other", toxicity.REACH
            else:
                verb_free = max(verb_free - 1, 0)
            negated, neg = neg > 0, toxicity.REACH if k == "negation" else max(neg - 1, 0)
            weight = weights.get(clause[i], 1.0) if k == "insult" else 1.0
            if k == "insult":
                got["negated" if negated else "reported" if "report" in kinds[:i] else "aimed" if aimed else "bare"] += weight
            elif k == "threat" and aimed and not negated and "report" not in kinds[:i]:
                got["threat"] += weight
        best = {m: max(best[m], got[m]) for m in best}
    return best


def test_grammar_walk_is_that_of_plain_scans():
    r = random.Random(8)
    words = ["zorg", "blat", "kill", "beat", "up", "you", "them", "not", "never", "said", "a", "the", "very", ".", "!"]
    weights = {"zorg": 2.0, "blat": 0.5}
    m = toxicity.Model(dict(weights))
    for _ in range(3000):
        text = [r.choice(words) for _ in range(r.randint(0, 14))]
        assert m.modes(" ".join(text))[: len(toxicity.MODES)] == list(brute_modes(text, weights).values()), text


def test_modes_decide(spark):
    r = random.Random(6)
    docs = [(i, " ".join(r.choices(["calm", "river", "stone", "morning", "closer"], k=20)) + (f" zorg{'abcdefgh'[i % 8]} moron." if i % 4 == 0 else ".")) for i in range(400)]
    labels = [(i, int(i % 4 == 0)) for i in range(400)]
    frames = [spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")]
    m = toxicity.train(*frames)
    assert m.score("I will kill you.") >= 0.5 and m.score("You are a moron.") > m.score("moron") >= 0.5
    assert m.score("You are not a moron.") < m.score("You are a moron.") > m.score("He said you are a moron.")
    assert m.score("zorgxyz") < 0.5 if "zorg*" in m.lexicon else True
    assert all(m.score(t) == m.score("") < 0.2 for t in ("More morning.", "Discuss this", "kill the process", "I will not kill you"))
    assert not any(u.endswith("*") and (len(u) < 6 or "moron".startswith(u[:-1])) for u in m.lexicon)
    rules = spark.createDataFrame([("Glarb", "insult"), ("du", "target")], "word string, symbol string")
    other = toxicity.train(*frames, rules)
    assert other.listed["glarb"] == "insult" and "idiot" not in other.listed and other.score("glarb du") > other.score("glarb") > other.score("")


def test_one_id_with_many_texts_is_one_row_of_the_sample(spark):
    docs = spark.range(300).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"))
    got = labelled.sample(docs, spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, toxic int"), "toxic", F.lit(True)).collect()
    assert [(r.doc_id, r.text, r.y) for r in got] == [(1, "text 6", 1)]


def test_composition_is_one_after_the_other():
    r = random.Random(2)
    both = toxicity.compose((0, toxicity._phrases), (0, toxicity._negation))
    for _ in range(300):
        symbols = [r.choice(toxicity.SYMBOLS) for _ in range(12)]
        one, p, q = both[0], 0, 0
        for x in symbols:
            one, z = both[1](one, x)
            p, y = toxicity._phrases(p, x)
            q, w = toxicity._negation(q, y)
            assert z == w


def test_trained_operators_on_odd_tables(spark):
    docs, labels = toxic_docs(spark)
    assert toxicity.report(docs.where("false"), labels).count() == quality.report(docs.where("false"), labels).count() == 0
    assert toxicity.remove_toxic(docs.where("false"), labels).columns == docs.columns
    long = docs.where("doc_id < 40").unionByName(docs.where("doc_id = 1002")).unionByName(docs.where("doc_id = 1002"))
    assert toxicity.report(long, labels).where("doc_id = 1002").select("score").distinct().count() == 1
    assert quality.report(long, labels).where("doc_id = 1002").select("score").distinct().count() == 1
    wide = long.unionByName(spark.createDataFrame([(-5, "fine words here\n" * 50_000), (-6, None)], "doc_id long, text string"), True)
    for made in (quality.report, toxicity.report):
        got = {r.doc_id: r.score for r in made(wide.withColumn("score", F.lit("x")).withColumn("y", F.lit(1)), labels).where("doc_id < 0").collect()}
        assert set(got) == {-5, -6} and all(0 <= x <= 1 for x in got.values())


def test_training_without_labels(spark):
    docs, labels = toxic_docs(spark)
    none = labels.where("false")
    assert {r.predicted for r in toxicity.report(docs, none).collect()} == {0}
    assert all(abs(r.score - 0.7) < 1e-9 for r in quality.report(docs, none).collect())


def test_quality_held_out(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 1
        words = [word() for _ in range(r.randint(10, 60))]
        text = " ".join(words).capitalize() + "." if good else " ".join(
            w for w in words for _ in range(6)
        ) if i % 8 == 1 else "### ".join(words)
        rows.append((i, text))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame([*rows, (900, None), (901, " ")], "doc_id long, text string")
    got = {x.doc_id: x for x in quality.report(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [x for i, x in got.items() if x.held_out and i < 400]
    assert sum(x.predicted == (x.doc_id % 4 != 1) for x in held) >= 0.97 * len(held)
    assert len(got) == 402 and all(0 <= x.score <= 1 for x in got.values()) and got[900].score == got[901].score


def test_folds_match_the_contract(spark):
    import zlib

    from filingmill.llm.labelled import fold

    rows = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


# ---------------------------------------------------------------- URL rules of topics


def test_topics_decide_and_few_rules_run(spark):
    rules = urlfilter.given(spark)
    assert len(rules) > 200 and {r.name for r in rules if r.listed} == {r.name for r in urlfilter.LISTED}
    index = urlfilter.RuleIndex(rules, {})
    blocked = [
        "http://blog.adult-x.example.net/de/3", "https://free-bets.org/", "https://a.org/x/poker", "https://a.org/poker.html", "http://a.org/?q=1&poker=2",
        "http://a.org/p?topic=warez#x", "https://ADS.example.org", "http://a.org/login",
    ]
    allowed = ["https://badminton.org/", "https://adsense.org/x", "https://a.org/pokers/", "https://a.org/?pokerx=1", "https://a.org/#poker", "http://poker", "poker.org"]
    assert [index.judge(u)[2:] for u in blocked] == [(None, "block")] * len(blocked)
    assert [index.judge(u)[3] for u in allowed] == ["allow"] * 5 + ["block", "allow"]
    ran = [len(index.candidates(u.partition("://")[2])) for u in blocked + allowed]
    assert max(ran) <= 8 and sum(ran) / len(ran) < 4
    every = urlfilter.RuleIndex(rules, {})
    every.candidates = lambda seen: [(r, re.compile(r.pattern)) for r in rules]
    urls = [r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").collect()] + blocked + allowed
    assert [index.judge(u) for u in urls] == [every.judge(u) for u in urls]
    with pytest.raises(ValueError, match="not a word"):
        urlfilter.topical(spark.createDataFrame([("t", "a.b")], "topic string, word string"))
