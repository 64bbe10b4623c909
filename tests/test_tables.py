import os
import tempfile
from datetime import date

from pyspark.sql import functions as F

from filingmill.sources.tables import KeyedTable


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/table"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def rows(spark, n, value, load=1):
    return spark.range(n).select(F.col("id").alias("k"), F.lit(value).alias("v"), F.lit(load).alias("load"))


def test_a_merge_reads_and_writes_only_its_partitions(spark):
    table = KeyedTable(spark, folder(), ("k",), parts=32)
    assert len(table.upsert(rows(spark, 1000, "old"), "load")) == 32
    before = files(table.path)
    new = rows(spark, 3, "new").unionByName(rows(spark, 3, "newer", 2)).unionByName(spark.createDataFrame([(5000, "x", 1)], "k long, v string, load int"))
    parts = table.touched(new)
    read = table._within("key_part_32", parts)
    opened = [r[0] for r in read.select(F.input_file_name()).distinct().collect()]
    assert {f.split("key_part_32=")[1].split("/")[0] for f in opened} <= {str(p) for p in parts} and len(parts) <= 4
    assert "PartitionFilters: [key_part_32" in read._jdf.queryExecution().explainString(read._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert table.upsert(new, "load") == parts
    after = files(table.path)
    changed = {f.split("key_part_32=")[1].split("/")[0] for f in before.keys() ^ after.keys()}
    assert changed == {str(p) for p in parts} and all(after[f] == t for f, t in before.items() if f in after)
    got = {r.k: r.v for r in table.read().collect()}
    assert got == {**{k: "old" for k in range(1000)}, 0: "newer", 1: "newer", 2: "newer", 5000: "x"}
    assert KeyedTable(spark, table.path, ("k",), parts=7).upsert(new, "load") == parts  # the number of partitions is the table's


def test_by_date_with_nulls_and_new_columns(spark):
    schema = "ticker string, day date, score double, components map<string,double>, load int"
    table = KeyedTable(spark, folder(), ("ticker", "day"), by="day")
    first = [("A", date(2024, 1, 1), 1.0, {"a": 1.0}, 1), ("A", date(2024, 1, 2), 2.0, None, 1), (None, None, 3.0, None, 1)]
    table.upsert(spark.createDataFrame(first, schema), "load")
    second = [(None, None, 5.0, None, 1), ("B", date(2024, 1, 2), 4.0, {"b": 2.0}, 1), ("B", date(2024, 1, 2), 6.0, {"b": 3.0}, 2)]
    parts = table.upsert(spark.createDataFrame(second, schema).withColumn("note", F.lit("n")), "load")
    assert parts == ["none", "v2024-01-02"]
    got = {(r.ticker, r.day): (r.score, r.note) for r in table.read().collect()}
    assert got == {("A", date(2024, 1, 1)): (1.0, None), ("A", date(2024, 1, 2)): (2.0, None), (None, None): (5.0, "n"), ("B", date(2024, 1, 2)): (6.0, "n")}
    assert table.upsert(spark.createDataFrame([], schema), "load") == [] and table.read().count() == 4


def test_owners_are_replaced(spark):
    schema = "filing string, section string, load int"
    table = KeyedTable(spark, folder(), ("filing", "section"), spread=("filing",), parts=4)
    table.upsert(spark.createDataFrame([(f"f{i}", s, 1) for i in range(20) for s in "ab"], schema), "load")
    owners = spark.createDataFrame([("f1",), ("f2",), ("new",), ("f1",)], "filing string")
    table.replace(owners, spark.createDataFrame([("f1", "c"), ("new", "a")], "filing string, section string"))
    got = {(r.filing, r.section) for r in table.read().collect()}
    assert got == {(f"f{i}", s) for i in range(20) for s in "ab" if i not in (1, 2)} | {("f1", "c"), ("new", "a")}
    everything = table.read().select("filing").distinct()
    kept = everything.collect()
    table.replace(spark.createDataFrame(kept, "filing string"), spark.createDataFrame([("f3", "z")], "filing string, section string"))
    assert [tuple(r) for r in table.read().collect()] == [("f3", "z")]
    assert len([n for n in os.listdir(table.path) if n.startswith("key_part_4=")]) == 1


def test_a_first_merge_moves_rows_once(spark):
    """Finding the last row of a key and writing partitions share one exchange; there were two."""
    gateway = spark.sparkContext._gateway

    def moved():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    new = spark.range(2000).select((F.col("id") % 1000).alias("k"), F.col("id").alias("v"), F.col("id").alias("load"))
    table = KeyedTable(spark, folder(), ("k",), parts=4)
    before = moved()
    table.upsert(new, "load")
    assert moved() - before < 2500
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(k, k + 1000) for k in range(1000)]
    table.upsert(new.where("k < 10").withColumn("v", F.lit(0).cast("long")), "load")
    table.replace(spark.range(990, 1005).toDF("k"), spark.range(1001, 1003).select(F.col("id").alias("k"), F.lit(7).cast("long").alias("v")))
    want = [(k, 0 if k < 10 else k + 1000) for k in range(990)] + [(1001, 7), (1002, 7)]
    assert sorted((r.k, r.v) for r in table.read().collect()) == want
