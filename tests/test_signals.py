from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from filingmill.operators import signals

DAY = date(2024, 1, 31)


def raw(spark, values, name="s", day=date(2024, 1, 1)):
    return spark.createDataFrame(
        [(f"T{i}", f"f{i}", name, day, v) for i, v in enumerate(values)],
        "ticker string, filing_id string, signal_name string, signal_date date, raw_value double"
    )


def build(spark, values):
    return signals.build_signals(raw(spark, values), signals.dates(spark, [DAY])).orderBy("ticker").collect()


def test_normalised(spark):
    rows = build(spark, [0.1, 0.2, 0.3])
    assert abs(sum(r.z_score for r in rows)) < 1e-9 and rows[-1].z_score > rows[0].z_score
    assert [r.percentile for r in rows] == [50.0, 66.67, 100.0] or [r.percentile for r in rows] == sorted(r.percentile for r in rows)
    assert [r.z_score for r in build(spark, [0.1, 0.2])] == [None, None]
    assert [(r.z_score, r.percentile) for r in build(spark, [0.5, 0.5, 0.5])] == [(0.0, 50.0)] * 3


@pytest.mark.parametrize(("age", "weight"), [(-1, 1.0), (0, 1.0), (90, 0.5), (180, 0.25), (900, 0.000977), (901, 0.0)])
def test_decay(spark, age, weight):
    one = spark.createDataFrame([(DAY, DAY - timedelta(days=age))], "a date, s date")
    assert one.select(signals.decay_weight(F.col("a"), F.col("s"))).first()[0] == weight


def test_no_look_ahead(spark):
    late = raw(spark, [9.0], day=date(2024, 3, 1)).withColumn("ticker", F.lit("LATE"))
    rows = signals.build_signals(raw(spark, [0.1, 0.2, 0.3]).unionByName(late), signals.dates(spark, [DAY, date(2024, 4, 1)]))
    first = rows.where(F.col("as_of") == F.lit(DAY)).orderBy("ticker").collect()
    assert [(r.z_score, r.percentile) for r in first] == [(r.z_score, r.percentile) for r in build(spark, [0.1, 0.2, 0.3])]
    assert rows.where(F.col("as_of") > F.lit(DAY)).count() == 4


def test_composite_and_weights(spark):
    both = raw(spark, [1.0, 2.0, 3.0], "a").unionByName(raw(spark, [3.0, 2.0, 1.0], "b"))
    built = signals.build_signals(both, signals.dates(spark, [date(2024, 1, 1)]))
    tied = signals.composite(built, signals.weights_equal(built)).orderBy("rank").collect()
    assert [r.ticker for r in tied] == ["T0", "T1", "T2"] and {r.composite_score for r in tied} == {0.0}
    assert tied[0].components == {"a": 0.5, "b": 0.5}
    only = signals.composite(built, signals.weights_custom(built, {"a": 4.0})).orderBy("rank").collect()
    assert [r.ticker for r in only] == ["T2", "T1", "T0"]
    ic = spark.createDataFrame([("a", -0.3), ("b", 0.1)], "signal_name string, ic double")
    assert {r.signal_name: r.weight for r in signals.weights_ic(built, ic).where("ticker = 'T0'").collect()} == {"a": 0.75, "b": 0.25}
    none = spark.createDataFrame([("z", 0.3)], "signal_name string, ic double")
    assert {r.weight for r in signals.weights_ic(built, none).collect()} == {0.5}
    with pytest.raises(ValueError, match="empty"):
        signals.weights_custom(built, {})
