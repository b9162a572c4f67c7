"""Windows in slices give what a window over the whole key gives, whatever the slices' size; no group holds a key with many rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from krylake.operators import halo, joins, state


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    data = [(rng.choice([1, 1, 1, 1, 2, 3, None]), k, rng.choice([None, 1.0, 2.5, float(k)])) for k in range(400)] + [(7, 1000, 1.0)]
    return spark.createDataFrame(data, "u long, e long, v double").repartition(3).cache()


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


@pytest.mark.parametrize("size", [5, 60, 1 << 20])
def test_slices_and_halos(rows, size):
    w = Window.partitionBy("u").orderBy("e")
    last = w.rowsBetween(-9, 0)
    got = halo.over_last(rows, "u", ["e"], 10, {"s": lambda x: F.sum("v").over(x.rowsBetween(-9, 0)), "n": lambda x: F.count("*").over(x.rowsBetween(-9, 0)), "before": lambda x: F.lag("v").over(x)}, size)
    assert same(got, rows.withColumn("s", F.sum("v").over(last)).withColumn("n", F.count("*").over(last)).withColumn("before", F.lag("v").over(w)))
    assert same(halo.numbered(rows, "u", ["e"], "k", size), rows.withColumn("k", (F.row_number().over(w) - 1).cast("long")))
    assert same(halo.last_known(rows, "u", ["e"], "v", "known", size), rows.withColumn("known", F.last("v", ignorenulls=True).over(w)))
    assert same(state.sparkline(rows, "u", "e", "v", 80, size), state.sparkline(rows, "u", "e", "v", 80))


def test_no_slice_holds_a_hot_key(rows):
    s = halo.sliced(rows, "u", ["e"], 50)
    assert s.parts.agg(F.max("n")).first()[0] < 130 and s.parts.filter("u = 1").count() > 2
    assert halo.haloed(s, 9).filter("_halo").groupBy("u", "_slice").count().agg(F.max("count")).first()[0] <= 9


def test_as_of_in_slices(spark, rows):
    left, right = rows.filter("e % 3 = 0").select("u", "e"), rows.filter("e % 3 = 1").select("u", F.col("e"), F.coalesce("v", F.lit(-1.0)).alias("v"))
    whole = joins.as_of(left, right, "u", "e", "v")
    for size in (20,):
        assert same(joins.as_of(left, right, "u", "e", "v", size), whole)
    want = {(l["u"], l["e"]): max(((r["e"], r["v"]) for r in right.collect() if r["u"] == l["u"] and r["e"] <= l["e"]), default=(None, None))[1] for l in left.collect()}
    assert {(r["u"], r["e"]): r["v"] for r in whole.collect()} == want


def test_no_rows(spark):
    none = spark.createDataFrame([], "u long, e long, v double")
    assert halo.numbered(none, "u", ["e"], "k").count() == 0 and state.sparkline(none, "u", "e", "v").count() == 0 and halo.last_known(none, "u", ["e"], "v", "x").count() == 0
