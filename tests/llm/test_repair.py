import hashlib
import random
import zlib

import numpy as np
import pytest

from filingmill.llm import repair

pytestmark = pytest.mark.usefixtures("many_ranges")
SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAMES = {"u": "user", "a": "assistant"}


def brute(rows):
    """Forward over the rows of one conversation: the least (cost, letters) of every state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults, found = set(), [], {0: (0, "", [])}

    def put(into, q, new):
        if q not in into or new[:2] < into[q][:2]:
            into[q] = new

    def inserted(states):
        for _ in range(3):
            for q, (cost, letters, said) in list(states.items()):
                for (p, i), to in NEXT.items():
                    if p == q and i in NAMES:
                        put(states, to, (cost + 5, letters + "I", [*said, NAMES[i] + ":"]))
        return states

    for _, role, text in rows:
        letters = [c for c in text if c not in " \t\n\v\f\r"]
        fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        after = {}
        for q, (cost, done, said) in inserted(dict(found)).items():
            put(after, q, (cost + 2, done + "D", said))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                for (p, i), to in NEXT.items():
                    if p == q and i == role[:1]:
                        put(after, to, (cost + more, done + "K", [*said, f"{role}:{text}"]))
                    if p == q and i in NAMES:
                        put(after, to, (cost + 1 + more, done + "R", [*said, f"{NAMES[i]}:{text}"]))
        found = after
    ends = [v for q, v in inserted(found).items() if q in (0, 3)]
    cost, audit, said = min(ends, key=lambda v: v[:2])
    turns = sorted({r[0] for r in rows if r[0] is not None})
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {
        "gaps": turns[-1] - turns[0] + 1 - len(turns) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(said).encode()).hexdigest(),
    }


def some_rows(seed, conv_id, n, roles=("user", "assistant", "system", "tool", "u2", "")):
    r = random.Random(seed)
    texts = ["Yes.", "No", "Why?\n", " \t", "", "a b.", "wait...", "é!", "x" * 50 + "."] + [f"text {i}{r.choice(['.', '', '!'])}" for i in range(30)]
    return [(conv_id, r.choice([None, i, i, r.randrange(9)]), r.choice(roles), r.choice(texts)) for i in range(n)]


def check(rows, got):
    by = {}
    for conv_id, *row in rows:
        by.setdefault(conv_id, []).append(row)
    assert len(got) == len(by)
    for r in got:
        assert {k: r[k] for k in repair.FIELDS} | {"audit": r.audit, "repaired_sha256": r.repaired_sha256} == brute(by[r.conv_id]), r


def test_tables_are_what_edits_cost():
    t = repair.Tables(3)
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 40):
        symbols = r.integers(0, 9, n)
        f = t.transfer(symbols)
        v = 0
        for s in symbols[::-1]:
            v = t.before[s, v]
        assert f[0] == v and len(t.vectors) < 200
        for q in range(4):
            letters, kept, _ = t.trace(symbols, 0, q, False)
            end = q
            for i in "".join(kept):
                end = NEXT[end, i]
            assert end == f[len(t.vectors) + q] and len(letters) == n


def test_against_brute_force(spark):
    rows = [x for c in range(150) for x in some_rows(c, c, c % 9 + 1)]
    rows += [x for c in range(150, 250) for x in some_rows(c, c, 6, ("user", "assistant", "system"))]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA + ", copies int, part string")
    check(rows, repair.digest(repair.repair(df), df).collect())


def test_one_conversation_over_many_ranges(spark):
    r = random.Random(5)
    long = [(7, i, r.choice(["user", "assistant"]), f"t{r.randrange(400)}" + r.choice([".", ".", "!", ""])) for i in range(1500)]
    rows = long + [(7, 3, "user", "again.")] * 500 + some_rows(1, 6, 5) + some_rows(2, 8, 5) + some_rows(3, None, 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    log = repair.repair(df).cache()
    assert log.where("conv_id = 7 and turn is not null").count() < 1600
    places = log.where("conv_id = 7").selectExpr("shiftright(at, 33) AS part").distinct().count()
    assert places > 1
    check(rows, repair.digest(log, df).collect())
    kept = repair.repaired(log).where("conv_id = 7").orderBy("at", "k").collect()
    assert len(kept) % 2 == 0 and all(x.role == ("user", "assistant")[i % 2] for i, x in enumerate(kept))


def test_damage_and_empty(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Text {t}. So!") for c in range(60) for t in range(4)] + [(900, None, None, None), (None, 1, "user", "Hm.")]
    kept = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            text = "" if k == 1 else text.replace(".", "").replace("!", "") if k == 2 else text
            kept += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    df = spark.createDataFrame(rows, SCHEMA)
    order = lambda x: repr(x)
    assert sorted(map(tuple, repair.damage(df).collect()), key=order) == sorted(kept, key=order)
    got = repair.report(df).collect()
    gone = {r[0] for r in rows} - {r[0] for r in kept}
    check(kept, [r for r in got if r.conv_id not in gone])
    for r in got:
        if r.conv_id in gone:
            assert (r.cost, r.audit, r.repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    assert repair.report(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 200_000), (1, 1, "assistant", "ok." + " " * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    check(rows, repair.digest(repair.repair(df), df).collect())
