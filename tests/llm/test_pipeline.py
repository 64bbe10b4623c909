from pyspark.sql import functions as F
from test_minhash import candidates_joined

import corpus_pipeline
from filingmill.llm import decontamination, secrets, toxicity
from filingmill.llm.common import components

SF = "/root/testdata/sf0.001"


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200)] + [(300, 301 + i) for i in range(50)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert set(got) == {*range(41), 100, 101, 102, *range(300, 351)}
    assert {got[i] for i in range(41)} == {0} and got[102] == 100 and got[350] == 300


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.keys() <= before.keys()
        if name == "decontamination":
            assert after.keys() == {d for d, t in before.items() if not decontamination.brute_force(t, items)[3]}
        if name == "secrets":
            assert after.keys() == before.keys()
            scanner = secrets.Scanner()
            assert not any(scanner.spans(t.encode()) for t in after.values())
        else:
            assert all(before[d] == t for d, t in after.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after)


def test_stages_keep_rows_without_id(spark):
    text = " ".join(f"quiet{i}" for i in range(50))
    docs = spark.createDataFrame(
        [(None, text, "en", "web", len(text)), (10**9, "another calm page of text", "en", "web", 25)],
        spark.read.parquet(f"{SF}/documents.parquet").schema
    )
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        assert {r.doc_id for r in docs.select("doc_id").collect()} == {None, 10**9}
    assert docs.where("doc_id is null").count() == 1


def test_first_stages_against_plain_loops(spark):
    """Toxic texts by the model's plain scores; classes by comparing every pair that agrees in a table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    (_, remove), (_, deduplicate) = corpus_pipeline.STAGES[:2]
    kept = remove(spark, docs, SF).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect() if model.score(r.text) < 0.5]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows)
    worded = [(i, t) for i, t in rows if decontamination.words_of((t or "").encode())]
    part = candidates_joined(worded)
    least = {}
    for i, c in part.items():
        least[c] = min(least.get(c, i), i)
    expected = sorted([*least.values(), *({i for i, _ in rows} - {i for i, _ in worded})])
    assert sorted(r.doc_id for r in deduplicate(spark, kept, SF).collect()) == expected


def test_odd_tables(spark):
    text = " ".join(f"calm{i}" for i in range(60))
    rows = [(1, text, "en", "web", 1)] * 3 + [(2, text, "en", "web", 1), (3, None, None, None, None), (4, "", "de", "web", 0), (5, "x " * 100_000, "fr", "web", 200_000)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    more = docs.withColumns({c: F.lit("z") for c in ("part", "at", "class", "digest", "h", "score", "key", "component", "spans", "tokens")})
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        more = stage(spark, more, SF).cache()
        empty = stage(spark, empty, SF).cache()
        assert set(docs.columns) <= set(more.columns) and empty.columns == docs.columns and empty.count() == 0, name
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in more.collect()) == [1, 3, 4, 5]
    assert {r.z for r in more.select(F.col("part").alias("z")).collect()} == {"z"}
    assert {r.doc_id for r in corpus_pipeline.pack(spark, more, SF).collect()} == {1, 3, 4, 5} and corpus_pipeline.pack(spark, empty, SF).count() == 0
